"""Word shingles of whole texts as 64-bit hashes, vectorised over many texts."""

from __future__ import annotations

import numpy as np

from corpusloom.llm.pretokens import Lane, chunks

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.Generator(np.random.PCG64(77))
LANES = [Lane(_RNG, 256) for _ in range(2)]
STEP = [int(_RNG.integers(0, 2**62)) * 2 + 1 for _ in range(64)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text two independent 64-bit hashes of each of its words, in order."""
    first: list[list[np.ndarray]] = [[] for _ in texts]
    second: list[list[np.ndarray]] = [[] for _ in texts]
    for part, owner in chunks(texts):
        raw = [p.encode() for p in part]
        octets = np.frombuffer(b"\n".join(raw), np.uint8)
        if not len(octets):
            continue
        space = SPACES[octets]
        start = np.append(True, space[1:] != space[:-1])
        at = np.flatnonzero(start)
        word = ~space[at]
        marks = [mixed(lane.marks(octets, at)[word]) for lane in LANES]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        cut = np.searchsorted(at[word], ends[:-1])
        for k, a, b in zip(owner, np.split(marks[0], cut), np.split(marks[1], cut), strict=True):
            first[k].append(a)
            second[k].append(b)
    none = np.empty(0, np.uint64)
    return [np.concatenate([none, *x]) for x in first], [np.concatenate([none, *x]) for x in second]


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` words; a text of fewer words is one run, one of none has none."""
    if not len(words):
        return words
    m = min(n, len(words))
    total = np.zeros(len(words) - m + 1, np.uint64)
    for j in range(m):
        total += words[j : len(words) - m + 1 + j] * np.uint64(STEP[j])
    return mixed(total + np.uint64(m))


def sequence_mark(first: np.ndarray, second: np.ndarray) -> bytes | None:
    """16 bytes that tell word sequences apart; none for a text without words."""
    if not len(first):
        return None
    from hashlib import blake2b

    return blake2b(first.tobytes() + second.tobytes(), digest_size=16).digest()

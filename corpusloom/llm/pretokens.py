"""Vectorised pre-tokenisation: many texts to distinct lower-case pre-tokens and their order.

A chunk of texts is one array of code points.  Character classes come from a table that is filled by
asking the tokenizer file's own normalizer and pre-tokenizer about each code point of a plain range
(Latin, Cyrillic, general punctuation).  Texts with any other code point, or with what may be a special
token, are "odd" and take the library's own path; so the results are the library's for every text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

LETTER, NUMBER, OTHER, SPACE, ODD = range(5)
TOP = 0x2060
#: Code points whose normal form and case do not depend on their neighbours.
PLAIN = [*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0x80, 0x250), *range(0x400, 0x460), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]
#: Characters held in arrays at a time; about 60 bytes of memory each.
CHUNK_CHARS = 500_000
#: In ASCII, what the classes leave out.
CONTROLS = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
#: Contractions that are pre-tokens of their own when an apostrophe begins them.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def tokenizer_file(name: str) -> str:
    """``name`` if it is a path that exists here, else that file of the installed public tokenizers."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(name))


def load_tokenizer(name: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file(name))


@dataclass
class Pieces:
    """Distinct pre-tokens of a chunk, and for each pre-token in order which one it is and its text."""

    words: list[str]
    which: np.ndarray
    doc: np.ndarray


class Pretokenizer:
    def __init__(self, tokenizer) -> None:
        self.cls = np.full(TOP + 1, ODD, np.uint8)
        self.low = np.arange(TOP + 1, dtype=np.uint16)
        norm, pre = tokenizer.normalizer, tokenizer.pre_tokenizer
        for c in PLAIN:
            ch = chr(c)
            low = norm.normalize_str(ch)
            if len(low) != 1 or ord(low) > TOP:
                continue
            n = len(pre.pre_tokenize_str(norm.normalize_str(f"a{ch}b")))
            two = len(pre.pre_tokenize_str(norm.normalize_str(ch + ch)))
            kind = {1: LETTER, 2: SPACE, 3: NUMBER if two == 2 else OTHER}.get(n, ODD)
            self.cls[c], self.low[c] = kind, c if kind == SPACE else ord(low)
        rng = np.random.Generator(np.random.PCG64(20240607))
        self.lanes = [Lane(rng, TOP + 1) for _ in range(2)]
        self.specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def odd(self, text: str) -> bool:
        if any(s in text for s in self.specials):
            return True
        if text.isascii():
            return CONTROLS.search(text) is not None
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return bool((self.cls[np.minimum(codes, TOP)] == ODD).any())

    def split(self, texts: list[str]) -> Pieces:
        """Pre-tokens of ``texts``, none of which is odd."""
        joined = "\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-16-le"), np.uint16)
        if not len(codes):
            return Pieces([], np.empty(0, np.int64), np.empty(0, np.int64))
        cls, low = self.cls[codes], self.low[codes]
        start = np.empty(len(codes), bool)
        start[0] = True
        np.not_equal(cls[1:], cls[:-1], out=start[1:])
        start |= cls == NUMBER
        self._contractions(codes, low, cls, start)
        at = np.flatnonzero(start)
        marks = [lane.marks(low, at) for lane in self.lanes]
        size = np.diff(at, append=len(codes))
        keep = cls[at] != SPACE
        at, size = at[keep], size[keep]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        doc = np.searchsorted(np.cumsum(lengths), at, "right")
        lowered = low.tobytes().decode("utf-16-le")
        first, which = distinct(*(m[keep] for m in marks), lowered, at, size)
        words = [lowered[a : a + n] for a, n in zip(at[first].tolist(), size[first].tolist(), strict=True)]
        return Pieces(words, which, doc)

    def _contractions(self, codes, low, cls, start) -> None:
        """An apostrophe alone before s, t, re, ve, m, ll or d goes with these letters.

        The patterns are of lower-case letters, matched after lower-casing.
        """
        spots = np.flatnonzero(codes == 39)
        spots = spots[start[spots] & (spots + 1 < len(codes))]
        spots = spots[cls[np.minimum(spots + 1, len(codes) - 1)] == LETTER]
        if not len(spots):
            return
        done = np.zeros(len(spots), bool)
        for tail in CONTRACTIONS:
            hit = ~done & (spots + len(tail) < len(codes))
            for k, ch in enumerate(tail):
                hit &= low[np.minimum(spots + 1 + k, len(codes) - 1)] == ord(ch)
            p, after = spots[hit], spots[hit] + 1 + len(tail)
            start[p + 1] = False
            inside = after[after < len(codes)]
            start[inside[cls[inside] == LETTER]] = True
            done |= hit


class Lane:
    """A 64-bit hash of stretches of an array: sum of by_char[c] * base**place, brought to place 0."""

    def __init__(self, rng: np.random.Generator, n: int) -> None:
        self.by_char = rng.integers(0, 2**64, n, np.uint64)
        self.base = int(rng.integers(0, 2**62)) * 4 + 3
        self.up = self.down = np.empty(0, np.uint64)

    def marks(self, low: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(self.up) < len(low):
            size = max(len(low), CHUNK_CHARS + CHUNK_CHARS // 8)
            self.up, self.down = (powers(b, size) for b in (self.base, pow(self.base, -1, 2**64)))
        values = self.by_char[low]
        values *= self.up[: len(low)]
        return np.add.reduceat(values, at) * self.down[at]


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1), modulo 2**64."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        np.multiply(out[:more], np.uint64(pow(base, done, 2**64)), out=out[done : done + more])
        done += more
    return out


def distinct(mark: np.ndarray, other: np.ndarray, text: str, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first position of each distinct stretch, and which each is.

    Stretches are told apart by two independent 64-bit hashes and their length; where these disagree
    with the first hash, by their characters.
    """
    which, _ = pd.factorize(mark)
    first = np.empty(int(which.max()) + 1 if len(which) else 0, np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    if not ((other[first][which] == other) & (size[first][which] == size)).all():
        seen: dict[str, int] = {}
        which = np.array([seen.setdefault(text[a : a + n], len(seen)) for a, n in zip(at.tolist(), size.tolist(), strict=True)])
        first = np.unique(which, return_index=True)[1]
    return first, which


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[list[str], list[int]]]:
    """Texts in groups of about ``limit`` characters, with the index of each.

    A longer text comes in parts cut at white space, which no pre-token crosses.
    """
    part: list[str] = []
    owner: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        for piece in [text] if len(text) <= limit else parts(text, limit):
            if held and held + len(piece) > limit:
                yield part, owner
                part, owner, held = [], [], 0
            part.append(piece)
            owner.append(i)
            held += len(piece)
    if part:
        yield part, owner


def parts(text: str, limit: int) -> Iterator[str]:
    """Cut a text at the first blank after each ``limit`` characters; the blank goes."""
    at = 0
    while at < len(text):
        cut = text.find(" ", at + limit)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut]
        at = cut + 1

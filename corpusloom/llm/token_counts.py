"""Token counts by rank-synchronous merging of arrays.

The distinct pre-tokens of a chunk of texts are held as one ragged array of symbols.  Each round looks
up the rank of every neighbouring pair, finds each pre-token's lowest rank, and joins that pair in all
pre-tokens at once; pre-tokens with no pair left drop out.  What survives is counted, and a document's
count is the sum over its pre-tokens.  Counts of pre-tokens met before are kept in a bounded store.

Texts with characters outside the plain range are normalised and cut by the tokenizer file's own
normalizer and pre-tokenizer, then merged alike; special strings inside a text count one each, as the
library takes them by default.  A null text has no bytes and no tokens; so has an empty one.  Every row
gives a row, repeated ones too, and an empty table none; other columns are ignored.  Texts of any length are
counted whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.arrow_rows import batch, slices, small_batches
from corpusloom.llm.pretokens import Pretokenizer, chunks, load_tokenizer, tokenizer_file
from corpusloom.llm.token_ids import TokenIds

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Pre-tokens whose counts a worker keeps; beyond it the store starts anew.  It bounds memory, not results.
KEPT_WORDS = 200_000
NEVER = np.iinfo(np.int32).max


class Merges:
    """The merge table as sorted pair keys with rank and result, and the symbols that stand for bytes."""

    def __init__(self, name: str) -> None:
        with open(tokenizer_file(name), encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int32)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        alphabet = TokenIds.byte_alphabet()
        self.inner = np.array([vocab.get(alphabet.get(b), -1) for b in range(256)], np.int64)
        self.final = np.array([vocab.get(alphabet.get(b, "") + suffix, -1) for b in range(256)], np.int64)

    def count(self, words: list[str]) -> np.ndarray:
        """Symbols that survive in each word."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        octets = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[octets]
        ends = np.cumsum(size) - 1
        symbols[ends] = self.final[octets[ends]]
        counts = size.copy()
        word = np.repeat(np.arange(len(raw)), size)
        while len(symbols) > 1:
            joined = word[1:] == word[:-1]
            key = np.where(joined, (symbols[:-1] << 32) | symbols[1:], -1)
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            rank = np.where(self.key[at] == key, self.rank[at], NEVER)
            rank = np.append(rank, NEVER)
            head = np.flatnonzero(np.append(True, ~joined))
            best = np.minimum.reduceat(rank, head)
            length = np.diff(head, append=len(symbols))
            left = (rank == np.repeat(best, length)) & (rank != NEVER)
            left = every_other(left)
            symbols[left] = self.result[rank[left]]
            keep = ~np.append(False, left[:-1])
            alive = np.repeat(best != NEVER, length)
            counts -= np.bincount(word[left], minlength=len(counts))
            keep &= alive
            symbols, word = symbols[keep], word[keep]
        return counts


def every_other(left: np.ndarray) -> np.ndarray:
    """Of each run of true values the first, third and so on: pairs that share a symbol join left to right."""
    spots = np.flatnonzero(left)
    if not len(spots):
        return left
    begins = np.append(True, np.diff(spots) > 1)
    run_start = np.maximum.accumulate(np.where(begins, spots, 0))
    out = np.zeros_like(left)
    out[spots[(spots - run_start) % 2 == 0]] = True
    return out


class TokenCounts:
    def __init__(self, name: str) -> None:
        self.tokenizer = load_tokenizer(name)
        self.pre = Pretokenizer(self.tokenizer)
        self.merges = Merges(name)
        self.back = {ch: b for b, ch in TokenIds.byte_alphabet().items()}
        self.kept: dict[str, int] = {}
        self.special = re.compile("|".join(map(re.escape, sorted(self.pre.specials, key=len, reverse=True))) or r"(?!)")

    def of(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        plain = []
        for i, text in enumerate(texts):
            if text and self.pre.odd(text):
                out[i] = self._odd(text)
            elif text:
                plain.append(i)
        for part, owner in chunks([texts[i] for i in plain]):
            pieces = self.pre.split(part)
            each = self._words(pieces.words)[pieces.which]
            sums = np.bincount(pieces.doc, weights=each, minlength=len(part)).astype(np.int64)
            np.add.at(out, [plain[k] for k in owner], sums)
        return out

    def _odd(self, text: str) -> int:
        between = self.special.split(text)
        words = [w for t in between for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(t))]
        # the library's pre-tokens are in the byte alphabet already
        texts = [bytes(map(self.back.__getitem__, w)).decode() for w in words]
        return len(between) - 1 + int(self._words(texts).sum())

    def _words(self, words: list[str]) -> np.ndarray:
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        new = [w for w in dict.fromkeys(words) if w not in kept]
        if new:
            kept.update(zip(new, self.merges.count(new).tolist(), strict=True))
        return np.fromiter(map(kept.__getitem__, words), np.int64, len(words))


@cache
def shared_counts(name: str) -> TokenCounts:
    """One ``TokenCounts`` for a worker, which serves task after task."""
    return TokenCounts(name)


def count(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    small_batches(docs.sparkSession)
    types = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_tokens": pa.int64(), "over_limit": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared_counts(tokenizer)
        for b in slices(batches):
            n = counts.of(b.column("text").to_pylist())
            yield batch({"doc_id": b.column("doc_id"), "n_bytes": b.column("n_bytes"), "n_tokens": n, "over_limit": n > limit}, types)
        counts.kept = {}

    sized = docs.selectExpr("doc_id", "text", "coalesce(cast(octet_length(text) as bigint), 0L) n_bytes")
    return sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

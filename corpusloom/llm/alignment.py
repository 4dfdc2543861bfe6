"""Alignment of two tokenizers over a corpus: which ids cover the same bytes, and how often pairs of ids do.

A text is encoded by A (a byte-level ``tokenizers`` file, over a space and the text) and by B (a ``sentencepiece`` model,
which puts the space itself).  The ends of both sides' tokens cut the bytes into stretches, each of which is one pair of
tokens that overlap (a link); where both end at the same byte, a group ends.

Pass 1 encodes every text once and writes, for each document, its counts and its distinct pairs as packed keys (A's id
in the high half of an int64) with their multiplicity.  Pass 2 counts documents by key: ``np.unique`` counts within each
partition, then a range-partitioned sort of the keys brings the partial counts of a key side by side, and runs are summed.  Pairs that
have the highest count of their A id are marked.  The counts are written as sorted shards of at most ``SHARD_PAIRS`` pairs, which
Spark ships as files to each executor; there they are memory-mapped, and pass 3 looks up every document's keys by binary
search.  The number of different pairs is bounded by the vocabularies, not by the corpus.  No document is shuffled.

Null and empty texts have no tokens, nor have texts whose bytes do not come back from the tokens of A or of B (such as
characters that B normalises): their counts are zeros and their digest is empty.  Rows that repeat are documents each, and
count each.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow_rows import batch, slices, small_batches
from corpusloom.llm.pretokens import load_tokenizer, tokenizer_file
from corpusloom.llm.token_ids import TokenIds
from corpusloom.workdir import materialize, scratch_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Keys that a task holds before it hands their counts on, and pairs of a shard.
HELD_KEYS, SHARD_PAIRS = 4_000_000, 1 << 20
#: Bytes of text that are encoded and aligned together.
PART_BYTES = 2 * 1024 * 1024
#: The longest run of blanks or of one class that the fast encoder takes; texts with longer ones take the library's path.
PLAIN_RUN = 20_000

FACTS = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(),
    "keys": pa.binary(), "times": pa.binary()}
FACTS_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary"


class ByteLevel:
    """Ids and byte lengths of a byte-level file's tokens."""

    def __init__(self, name: str) -> None:
        self.tokenizer = load_tokenizer(name)
        self.tokenizer.encode_special_tokens = True
        alphabet = {c: b for b, c in TokenIds.byte_alphabet().items()}
        alphabet |= {chr(b): b for b in range(256) if b not in alphabet.values()}  # no text has these bytes; they stand as themselves
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes: list[bytes] = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.bytes[i] = bytes(map(alphabet.__getitem__, token)) if all(c in alphabet for c in token) else token.encode()
        self.fast = self._ranked(name)
        self.long = re.compile(rf"\s{{{PLAIN_RUN}}}|\w{{{PLAIN_RUN}}}|[^\s\w]{{{PLAIN_RUN}}}")

    def _ranked(self, name: str):
        """The same merges in the library for ranked vocabularies, which is several times as fast; only where the ids of merged
        tokens rise with their merges' order, and the file cuts words by its library's standard pattern, so that both are one rule."""
        import public_tokenizers
        import tiktoken

        with open(tokenizer_file(name), encoding="utf-8") as f:
            held = json.load(f)
        vocab, merges = held["model"]["vocab"], held["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        made = [vocab[a + b] for a, b in pairs]
        cut = held.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not held.get("normalizer")
        special = {t["id"] for t in held.get("added_tokens", ())}
        ranks = {self.bytes[i]: i for i in vocab.values() if i not in special}
        if not plain or made != sorted(made) or len(ranks) != 256 + len(made) or held["model"].get("ignore_merges"):
            return None
        return tiktoken.Encoding(os.path.basename(name), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return [self.tokenizer.encode(t, add_special_tokens=False).ids if len(t) >= PLAIN_RUN and self.long.search(t) else self.fast.encode_ordinary(t)
            for t in texts]


class Pieces:
    """Ids and byte lengths of a sentencepiece model's pieces."""

    def __init__(self, name: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(name))
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@cache
def encoders(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    """One pair for a worker, which serves task after task."""
    return ByteLevel(a), Pieces(b)


@cache
def decimals(size: int, marks: str) -> np.ndarray:
    """Each id in decimal digits with a mark behind it, as rows of bytes with zeros behind: all ids with the first mark, then with the
    second."""
    held = np.array([f"{i}{mark}".encode() for mark in marks for i in range(size)])
    return held.view(np.uint8).reshape(len(held), held.dtype.itemsize)


class Side:
    """Tokens of several texts on end: ids, how many of each text, and the byte at which each ends."""

    def __init__(self, ids: list[list[int]], table: Table) -> None:
        self.per_text = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids = np.fromiter(chain.from_iterable(ids), np.int64, int(self.per_text.sum()))
        self.ends = np.cumsum(table.length[self.ids])
        self.bytes = np.diff(np.append(0, np.append(0, self.ends)[np.cumsum(self.per_text)]))  # of each text

    def only(self, texts: np.ndarray, table: Table) -> Side:
        """The tokens of the texts that are marked."""
        held = object.__new__(Side)
        held.ids, held.per_text, held.bytes = self.ids[np.repeat(texts, self.per_text)], self.per_text[texts], self.bytes[texts]
        held.ends = np.cumsum(table.length[held.ids])
        return held


class Table:
    """Bytes of all tokens of a tokenizer, on end."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.length) - self.length
        self.octets = np.frombuffer(b"".join(tokens), np.uint8)

    def spelled(self, side: Side) -> np.ndarray:
        """The bytes that the tokens stand for."""
        n = self.length[side.ids]
        return self.octets[np.repeat(self.start[side.ids] - (side.ends - n), n) + np.arange(int(n.sum()))]


class Aligner:
    """Facts of documents from both sides' tokens, by array operations over several texts."""

    def __init__(self, a: str = A, b: str = B) -> None:
        self.a, self.b = encoders(a, b)
        self.tables = [Table(side.bytes) for side in (self.a, self.b)]

    def facts(self, texts: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, keys, times) of each text."""
        out: list[tuple] = [(0, 0, 0, 0, "", b"", b"")] * len(texts)
        some = [i for i, t in enumerate(texts) if t]
        if not some:
            return out
        wanted = [b" " + texts[i].encode() for i in some]
        sides = [Side(self.a.encode([" " + texts[i] for i in some]), self.tables[0]), Side(self.b.encode([texts[i] for i in some]), self.tables[1])]
        same = self._spelled(wanted, sides[0], self.tables[0]) & self._spelled(wanted, sides[1], self.tables[1])
        if not same.all():
            sides = [side.only(same, table) for side, table in zip(sides, self.tables, strict=True)]
        for i, found in zip(np.array(some)[same].tolist(), self._aligned(*sides), strict=True):
            out[i] = found
        return out

    @staticmethod
    def _spelled(wanted: list[bytes], side: Side, table: Table) -> np.ndarray:
        """Which texts' tokens give the texts' bytes."""
        size = np.fromiter(map(len, wanted), np.int64, len(wanted))
        same = side.bytes == size
        if same.any():
            got = table.spelled(side.only(same, table))
            odd = got != np.frombuffer(b"".join(w for w, s in zip(wanted, same.tolist(), strict=True) if s), np.uint8)
            same[np.flatnonzero(same)] = np.add.reduceat(odd, np.cumsum(size[same]) - size[same]) == 0
        return same

    def _aligned(self, x: Side, y: Side) -> Iterator[tuple]:
        if not len(x.ids):
            return
        # bytes at which tokens end; a stretch that ends at one of either side is one token of each
        at_a, at_b = np.zeros(int(x.ends[-1]) + 1, bool), np.zeros(int(y.ends[-1]) + 1, bool)
        at_a[x.ends] = at_b[y.ends] = True
        ends = np.flatnonzero(at_a | at_b)
        which_a, which_b = np.cumsum(at_a)[ends - 1], np.cumsum(at_b)[ends - 1]
        close_a, close_b = at_b[x.ends], at_a[y.ends]
        groups_a, groups_b = np.cumsum(close_a), np.cumsum(close_b)
        last_a, last_b = np.cumsum(x.per_text) - 1, np.cumsum(y.per_text) - 1
        n_groups = np.diff(np.append(0, groups_a[last_a]))
        n_links = np.diff(np.append(0, np.searchsorted(ends, x.ends[last_a], "right")))
        text = np.repeat(np.arange(len(n_links)), n_links)
        wide = len(self.a.bytes), len(self.b.bytes)
        found, times = runs(np.sort((text * wide[0] + x.ids[which_a]) * wide[1] + y.ids[which_b]))
        text_a, ids_b = np.divmod(found, wide[1])
        text, ids_a = np.divmod(text_a, wide[0])
        cuts = np.searchsorted(text, np.arange(len(n_links) + 1))
        keys, times = ((ids_a << 32) | ids_b).astype("<i8"), times.astype("<i4")
        # tokens of a group in order, A's before B's: how many of the other side stand before each
        open_a, open_b = np.flatnonzero(close_a) + 1, np.append(0, np.flatnonzero(close_b) + 1)
        place_a = np.arange(len(x.ids)) + open_b[groups_a - close_a]
        place_b = np.arange(len(y.ids)) + open_a[groups_b - close_b]
        tables = decimals(wide[0], ",|"), decimals(wide[1], ",;")
        rows = np.zeros((len(x.ids) + len(y.ids), max(t.shape[1] for t in tables)), np.uint8)
        rows[place_a, : tables[0].shape[1]] = tables[0][x.ids + wide[0] * close_a]
        rows[place_b, : tables[1].shape[1]] = tables[1][y.ids + wide[1] * close_b]
        at = 0
        for i, (n_a, n_b) in enumerate(zip(x.per_text.tolist(), y.per_text.tolist(), strict=True)):
            said = rows[at : at + n_a + n_b].ravel()
            at += n_a + n_b
            digest = hashlib.sha256(said[said != 0].tobytes()[:-1]).hexdigest()
            few = slice(cuts[i], cuts[i + 1])
            yield n_a, n_b, int(n_groups[i]), int(n_links[i]), digest, keys[few].tobytes(), times[few].tobytes()


def facts(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """What each document has by itself; its keys as little-endian int64 in ascending order, with their multiplicity."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a, b)
        for some in slices(batches, most=PART_BYTES):
            found = aligner.facts(some.column("text").to_pylist())
            columns = list(zip(*found, strict=True)) if found else [[]] * (len(FACTS) - 1)
            yield batch(dict(zip(FACTS, [some.column("doc_id"), *columns], strict=True)), FACTS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FACTS_SCHEMA)


def partial_counts(known: DataFrame) -> DataFrame:
    """(key, n): documents by key, within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        counted = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in slices(batches):
            held += [np.frombuffer(k, "<i8") for k in b.column("keys").to_pylist()]
            if sum(map(len, held)) >= HELD_KEYS:
                counted, held = summed(*counted, held), []
            if len(counted[0]) >= HELD_KEYS:
                yield batch(dict(zip(("key", "n"), counted, strict=True)), {"key": pa.int64(), "n": pa.int64()})
                counted = np.empty(0, np.int64), np.empty(0, np.int64)
        counted = summed(*counted, held)
        yield batch(dict(zip(("key", "n"), counted, strict=True)), {"key": pa.int64(), "n": pa.int64()})

    return known.select("keys").mapInArrow(run, "key long, n long")


def summed(keys: np.ndarray, n: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by key, and one more for each time a key is in ``held``."""
    more, times = np.unique(np.concatenate([np.empty(0, np.int64), *held]), return_counts=True)
    keys, n = np.concatenate([keys, more]), np.concatenate([n, times])
    order = np.argsort(keys, kind="stable")
    return runs(keys[order], n[order])


def runs(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of sorted keys, and the sum of n over each one's run, or the run's length."""
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    if n is None:
        return keys[head], np.diff(head, append=len(keys))
    return keys[head], np.add.reduceat(n, head) if len(keys) else n


def counts(partial: DataFrame) -> DataFrame:
    """(key, n) over the corpus, sorted by key over all partitions; a key's partial counts, one a task at most, are side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_n = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            keys, n = runs(np.append(open_key, b.column("key").to_numpy()), np.append(open_n, b.column("n").to_numpy()))
            if len(keys):  # the last run may go on in the next batch
                yield batch({"key": keys[:-1], "n": n[:-1]}, {"key": pa.int64(), "n": pa.int64()})
                open_key, open_n = keys[-1:], n[-1:]
        yield batch({"key": open_key, "n": open_n}, {"key": pa.int64(), "n": pa.int64()})

    return partial.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, "key long, n long")


class Shards:
    """Written counts: sorted files of (key, n, best), which Spark ships to every executor."""

    def __init__(self, counted: DataFrame, shard_pairs: int = SHARD_PAIRS) -> None:
        spark = counted.sparkSession
        # a row for each id of A at most
        most = counted.groupBy(F.shiftright("key", 32).alias("a")).agg(F.max("n").alias("most"))
        marked = counted.join(F.broadcast(most), F.shiftright("key", 32) == F.col("a")).select("key", "n", (F.col("n") == F.col("most")).alias("best"))
        path = scratch_path(spark, "pair-counts")
        # file names are told apart by the folder's, since shipped files lie in one folder
        marked.repartitionByRange("key").sortWithinPartitions("key").write.option("maxRecordsPerFile", shard_pairs).option("compression", "none").parquet(path)
        listed = spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
        self.ranges = []
        for r in listed.orderBy("lo").collect():  # a row for each file of a million pairs
            spark.sparkContext.addFile(r["file"])
            self.ranges.append((r["lo"], r["hi"], r["file"].rsplit("/", 1)[1]))

    def __iter__(self) -> Iterator[tuple[int, int, str]]:
        return iter(self.ranges)


@cache
def mapped(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, counts and marks of a shipped shard, memory-mapped; workers of an executor share the pages.

    The arrays lie beside the shipped file, in the folder that Spark makes for an executor and removes with it."""
    out = []
    for column in ("key", "n", "best"):
        place = SparkFiles.get(f"{name}.{column}.npy")
        if not os.path.exists(place):
            part = f"{place}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                np.save(f, pq.read_table(SparkFiles.get(name), columns=[column]).column(column).to_numpy())
            os.replace(part, place)
        out.append(np.load(place, mmap_mode="r"))
    return tuple(out)


def looked_up(known: DataFrame, shards: Shards) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum)."""
    ranges = list(shards)
    types = {k: FACTS[k] for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")} | {"n_best": pa.int64(), "count_sum": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys = [np.frombuffer(k, "<i8") for k in b.column("keys").to_pylist()]
            owner = np.repeat(np.arange(len(keys)), list(map(len, keys)))
            flat = np.concatenate([np.empty(0, np.int64), *keys])
            times = np.frombuffer(b"".join(b.column("times").to_pylist()), "<i4").astype(np.int64)
            asked, at = np.unique(flat, return_inverse=True)
            n, best = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
            for lo, hi, name in ranges:
                a, z = np.searchsorted(asked, lo), np.searchsorted(asked, hi, "right")
                if a < z:
                    held = mapped(name)
                    spot = np.searchsorted(held[0], asked[a:z])
                    n[a:z], best[a:z] = held[1][spot], held[2][spot]
            sums = [np.zeros(len(keys), np.int64) for _ in range(2)]
            np.add.at(sums[0], owner, best[at] * times)
            np.add.at(sums[1], owner, n[at] * times)
            yield batch({k: b.column(k) for k in list(types)[:6]} | {"n_best": sums[0], "count_sum": sums[1]}, types)

    return known.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def align(docs: DataFrame, a: str = A, b: str = B, shard_pairs: int = SHARD_PAIRS) -> DataFrame:
    """One row for each document; see ``looked_up``."""
    known = materialize(facts(docs, a, b), "alignment")
    return looked_up(known, Shards(materialize(counts(materialize(partial_counts(known), "pair-counts")), "pair-counts"), shard_pairs))


def pairs(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """(a_id, b_id, n_documents): the table of linked pairs by itself."""
    found = counts(partial_counts(facts(docs, a, b)))
    return found.select(F.shiftright("key", 32).alias("a_id"), F.col("key").bitwiseAND(0xFFFFFFFF).alias("b_id"), F.col("n").alias("n_documents"))

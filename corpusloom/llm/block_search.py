"""Ranked lexical search by Block-Max WAND over written shards of posting blocks.

Building: one pass counts documents and terms.  A second cuts every text into terms and gathers the documents of a
task into shards of about ``SHARD_POSTINGS`` postings.  A shard's postings are sorted by term and document and cut into blocks
of ``BLOCK`` postings; a block is one row with its first and last document, the largest impact in it, and its documents and
frequencies compressed.  The shard's own documents (identifiers and length norms) are the row of the empty term.  Nothing
is shuffled; document frequencies are sums over the rows of a term.

Searching: the blocks of the queries' terms are brought together by shard, which bounds what a task holds at a time.  In a
shard every query moves through the documents in order.  The edges of blocks cut the documents into stretches, and the sum
of largest impacts of the blocks over a stretch bounds every score in it.  The pivot is the next stretch whose bound can
enter the best ``k``; all before it are passed over by moving the cursors through block edges alone (shallow moves), and only
the blocks over pivots are decompressed and scored (deep moves).  A term of one block is opened at once, so that its cursor
stands on documents.  Pivots are taken in runs that grow, which keeps the work in array operations; the threshold rises after
each run and goes along from shard to shard of a task.  The best of the tasks are ranked once more.

All scores are integers and exact.  A stretch whose bound equals the threshold is opened, since ties go by identifier.

Null and empty texts, and texts without a term, are no documents.  Rows that repeat are documents each, and take ranks each.  A
null identifier comes after all others.  Items that repeat identifier and text are one; different texts under one identifier
are searched each, and ranked within their text.  Items without terms give no rows; so does an empty table.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.arrow_rows import batch, slices, small_batches
from corpusloom.llm.words import PATTERN, words_of
from corpusloom.workdir import materialize

#: Postings of a block and, at least, of a shard; a shard ends with the batch that reaches it.
BLOCK, SHARD_POSTINGS = 64, 2_000_000
#: Bytes of query texts that are searched in one pass; more go in several.
PASS_BYTES = 4 * 1024 * 1024
#: Stretches that are opened in the first run of a query in a shard; each next run is twice as long.
FIRST_RUN = 32
#: Rows of a shard that are handed to Spark at a time.
ROWS = 20_000
#: Impacts of terms are counted in these parts.
UNIT = 1_000_000_000

ROW = {"shard": pa.int64(), "term": pa.binary(), "first": pa.int32(), "last": pa.int32(), "n": pa.int32(), "peak": pa.int32(), "data": pa.binary()}
SCHEMA = "shard long, term binary, first int, last int, n int, peak int, data binary"
HEAD = b""
WIDTHS = (1, 2, 4)


@dataclass(frozen=True)
class Index:
    """``blocks`` as in ``SCHEMA``; ``documents`` have a term, ``terms`` counts all with repeats."""

    blocks: DataFrame
    documents: int
    terms: int


def norm(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Length norms of documents of n terms, in hundredths."""
    return 75 + (25 * n.astype(np.int64) * documents) // max(1, terms)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return UNIT * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 12 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


# ---- blocks


def width_of(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def pack(head: np.ndarray, gaps: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of blocks that begin at ``head``, on end, and where each begins: a byte of widths, gaps, frequencies."""
    n = np.diff(head, append=len(gaps))
    lanes = [(values, width_of(np.maximum.reduceat(values, head))) for values in (gaps, tf)]
    size = 1 + n * (lanes[0][1] + lanes[1][1])
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]), np.uint8)
    out[ends - size] = lanes[0][1] * 16 + lanes[1][1]
    at = ends - size + 1
    rank = np.arange(len(gaps)) - np.repeat(head, n)
    for values, width in lanes:
        wide, begin = np.repeat(width, n), np.repeat(at, n)
        for w in WIDTHS:
            here = np.flatnonzero(wide == w)
            for k in range(w):
                out[begin[here] + rank[here] * w + k] = values[here] >> (8 * k) & 255
        at = at + n * width
    return out, np.append(0, ends)


def unpack(first: int, n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Documents and frequencies of a block."""
    a, b = data[0] >> 4, data[0] & 15
    gaps = np.frombuffer(data, f"<u{a}", n, 1)
    return first + np.cumsum(gaps, dtype=np.int64), np.frombuffer(data, f"<u{b}", n, 1 + n * a)


@dataclass
class Gathered:
    """Postings of a shard that is being filled, batch by batch."""

    documents: int
    terms: int
    words: list[pa.Array] = field(default_factory=list)
    codes: list[np.ndarray] = field(default_factory=list)
    owner: list[np.ndarray] = field(default_factory=list)
    tf: list[np.ndarray] = field(default_factory=list)
    ids: list[pa.Array] = field(default_factory=list)
    sizes: list[np.ndarray] = field(default_factory=list)
    held: int = 0
    places: int = 0
    distinct: int = 0

    def add(self, ids: pa.Array, column: pa.Array) -> None:
        found = words_of(column)
        if not len(found.values):
            return
        some = np.flatnonzero(found.per_text)
        coded = found.values.dictionary_encode()
        each = np.repeat(np.arange(len(some)), found.per_text[some])
        key, tf = np.unique(each * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
        owner, code = np.divmod(key, len(coded.dictionary))
        self.words.append(coded.dictionary)
        self.codes.append((code + self.distinct).astype(np.int32))
        self.owner.append((owner + self.places).astype(np.int32))
        self.tf.append(tf.astype(np.int32))
        self.ids.append(ids.take(pa.array(some)))
        self.sizes.append(found.per_text[some])
        self.held += len(key)
        self.places += len(some)
        self.distinct += len(coded.dictionary)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The shard: its head and its blocks, by term."""
        if not self.places:
            return
        m = norm(np.concatenate(self.sizes), self.documents, self.terms)
        yield batch({"shard": [shard], "term": [HEAD], "first": [0], "last": [self.places - 1], "n": [self.places], "peak": [0],
            "data": [head_bytes(pa.concat_arrays(self.ids), m)]}, ROW)
        coded = pa.concat_arrays(self.words).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term = place[coded.indices.to_numpy()][np.concatenate(self.codes)]
        names = coded.dictionary.take(pa.array(order))
        owner, tf = np.concatenate(self.owner), np.concatenate(self.tf)
        by = np.argsort(term * self.places + owner)
        term, owner, tf = term[by], owner[by], tf[by]
        fresh = np.flatnonzero(np.append(True, np.diff(term) > 0))
        rank = np.arange(len(term)) - np.repeat(fresh, np.diff(fresh, append=len(term)))
        head = np.flatnonzero(rank % BLOCK == 0)
        gaps = np.diff(owner, prepend=0)
        gaps[head] = 0
        peak = np.maximum.reduceat(impact(tf, m[owner]), head)
        n = np.diff(head, append=len(term))
        for at in range(0, len(head), ROWS):
            few = slice(at, at + ROWS)
            lo, hi = head[at], head[at] + int(n[few].sum())
            body, ends = pack(head[few] - lo, gaps[lo:hi], tf[lo:hi])
            data = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(body)])
            yield batch({"shard": np.full(len(ends) - 1, shard), "term": names.take(pa.array(term[head[few]])), "first": owner[head[few]],
                "last": owner[head[few] + n[few] - 1], "n": n[few], "peak": peak[few], "data": data}, ROW)


def head_bytes(ids: pa.Array, m: np.ndarray) -> bytes:
    """Identifiers, which of them are null, and norms."""
    return np.asarray(pc.fill_null(ids, 0), "<i8").tobytes() + np.asarray(pc.is_null(ids), np.uint8).tobytes() + m.astype("<i8").tobytes()


def build(docs: DataFrame, shard_postings: int = SHARD_POSTINGS) -> Index:
    """The written index of (doc_id, text)."""
    counted = docs.select(F.coalesce(F.regexp_count("text", F.lit(PATTERN)), F.lit(0)).cast("long").alias("n"))
    documents, terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, filled = TaskContext.get().partitionId() << 32, Gathered(documents, terms)
        for b in slices(batches):
            filled.add(b.column("doc_id"), b.column("text"))
            if filled.held >= shard_postings:
                yield from filled.rows(shard)
                shard, filled = shard + 1, Gathered(documents, terms)
        yield from filled.rows(shard)

    blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
    return Index(materialize(blocks, "blocks"), documents, terms)


# ---- search


@dataclass
class Best:
    """The best of one query so far: scores, identifiers and which of these are null, in order."""

    k: int
    score: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    doc: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    null: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint8))

    @property
    def threshold(self) -> int:
        """What a score must reach to enter."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = (np.concatenate(p) for p in ((self.score, score), (self.doc, doc), (self.null, null)))
        first = np.lexsort((doc, null, -score))[: self.k]
        self.score, self.doc, self.null = score[first], doc[first], null[first]


class Shard:
    """The rows of one shard that the queries need, in order of term and first document."""

    def __init__(self, rows: pa.Table) -> None:
        head = rows.slice(0, 1).to_pylist()[0]
        if head["term"] != HEAD:
            raise ValueError(f"shard {head['shard']} has no head")
        n = head["n"]
        self.ids = np.frombuffer(head["data"], "<i8", n)
        self.null = np.frombuffer(head["data"], np.uint8, n, 8 * n)
        self.norm = np.frombuffer(head["data"], "<i8", n, 9 * n)
        rows = rows.slice(1)
        self.first, self.last, self.n, self.peak = (rows.column(c).to_numpy().astype(np.int64) for c in ("first", "last", "n", "peak"))
        self.data = rows.column("data").to_pylist()
        terms = rows.column("term").combine_chunks().dictionary_encode()
        code = terms.indices.to_numpy()
        names = terms.dictionary.to_pylist()
        self.spans = {names[c]: (int(a), int(z)) for c, a, z in zip(range(len(names)), np.searchsorted(code, range(len(names))),
            np.searchsorted(code, range(len(names)), "right"), strict=True)}
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def open(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of block k, decompressed at most once."""
        got = self.opened.get(k)
        if got is None:
            docs, tf = unpack(int(self.first[k]), int(self.n[k]), self.data[k])
            got = self.opened[k] = (docs, impact(tf, self.norm[docs]))
        return got

    def search(self, query: list[tuple[bytes, int]], best: Best) -> None:
        """Bring the documents of this shard to ``best``; ``query`` has terms and weights, of repeats summed."""
        held = [(*self.spans[t], w) for t, w in query if t in self.spans]
        if not held:
            return
        points = [(self.open(a), w) for a, z, w in held if z - a == 1]
        many = [(a, z, w) for a, z, w in held if z - a > 1]
        docs = np.concatenate([d for (d, _), _ in points]) if points else np.empty(0, np.int64)
        gains = np.concatenate([i * w for (_, i), w in points]) if points else np.empty(0, np.int64)
        block = np.concatenate([np.arange(a, z) for a, z, _ in many]) if many else np.empty(0, np.int64)
        factor = np.repeat([w for *_, w in many], [z - a for a, z, _ in many]) if many else np.empty(0, np.int64)
        begin, end = np.concatenate([docs, self.first[block]]), np.concatenate([docs, self.last[block]]) + 1
        most = np.concatenate([gains, self.peak[block] * factor])
        edges = np.unique(np.concatenate([begin, end]))
        lo, hi = np.searchsorted(edges, begin), np.searchsorted(edges, end)
        change = np.zeros(len(edges), np.int64)
        np.add.at(change, lo, most)
        np.subtract.at(change, hi, most)
        bound = np.cumsum(change)
        lo, hi = lo[len(docs) :], hi[len(docs) :]
        at, run = 0, FIRST_RUN
        while True:
            pivots = np.flatnonzero(bound[at:] >= best.threshold)[:run] + at
            if not len(pivots):
                return
            at, run = int(pivots[-1]) + 1, run * 2
            over = np.zeros(len(edges) + 1, np.int64)
            over[pivots + 1] = 1
            seen = np.cumsum(over)
            deep = np.flatnonzero(seen[hi] > seen[lo])
            score = np.zeros(len(self.ids), np.int64)
            np.add.at(score, docs, gains)
            for k, w in zip(block[deep].tolist(), factor[deep].tolist(), strict=True):
                d, i = self.open(k)
                score[d] += i * w  # a block has a document once
            hits = np.flatnonzero(score >= best.threshold)
            hits = hits[over[np.searchsorted(edges, hits, "right")] == 1]  # scores elsewhere are not whole
            best.add(score[hits], self.ids[hits], self.null[hits])


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Shards of rows that are sorted by shard, one at a time."""
    parts: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        number = b.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if parts and number[a] != now:
                yield Shard(pa.Table.from_batches(parts))
                parts = []
            now = number[a]
            parts.append(b.slice(a, z - a))
    if parts:
        yield Shard(pa.Table.from_batches(parts))


def search(index: Index, items: DataFrame, k: int = 20, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 of each item, from rank 1."""
    spark = items.sparkSession
    asked = items.select("item_id", "text", F.xxhash64("text").alias("mark")).where("text is not null").dropDuplicates(["item_id", "mark"])
    passes = 1 + (asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // pass_bytes
    found = None
    for i in range(passes):
        part = asked.where(F.pmod(F.xxhash64("item_id", "mark"), F.lit(passes)) == i).collect()  # some pass_bytes of text
        some = _pass(index, [(r["item_id"], r["mark"], r["text"]) for r in part], k, spark)
        found = some if found is None else found.unionByName(some)
    best = Window.partitionBy("item", "mark").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    kind = items.schema["item_id"].dataType
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("item").cast(kind).alias("item_id"), "rank",
        "doc_id", "score")


def _pass(index: Index, part: list[tuple], k: int, spark) -> DataFrame:
    found = words_of(pa.array([t for *_, t in part], pa.string()))
    words, ends = found.values.to_pylist(), np.cumsum(found.per_text)
    counts = [Counter(words[e - n : e]) for e, n in zip(ends.tolist(), found.per_text.tolist(), strict=True)]
    wanted = sorted(set(words))
    terms = spark.createDataFrame([(bytearray(t),) for t in wanted], "term binary")
    near = index.blocks.join(F.broadcast(terms), "term", "left_semi")  # terms of one pass
    df = {bytes(r["term"]): r["df"] for r in near.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row for each of them
    w = {t: weight(index.documents, n) for t, n in df.items()}
    queries = [(str(item) if item is not None else None, mark, [(t, n * w[t]) for t, n in c.items() if w.get(t)])
        for (item, mark, _), c in zip(part, counts, strict=True)]
    queries = [q for q in queries if q[2]]
    head = index.blocks.where(F.length("term") == 0)
    rows = near.select(*ROW).unionByName(head.select(*ROW)) if queries else head.where("false").select(*ROW)
    types = {"item": pa.string(), "mark": pa.int64(), "doc_id": pa.int64(), "score": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]
        for shard in by_shard(batches):
            for b, (*_, query) in zip(best, queries, strict=True):
                shard.search(query, b)
        for b, (item, mark, _) in zip(best, queries, strict=True):
            if len(b.score):
                yield batch({"item": [item] * len(b.score), "mark": [mark] * len(b.score), "doc_id": pa.array(b.doc, mask=b.null == 1),
                    "score": b.score}, types)

    dealt = rows.repartition("shard").sortWithinPartitions("shard", "term", "first")
    return dealt.mapInArrow(run, "item string, mark long, doc_id long, score long")

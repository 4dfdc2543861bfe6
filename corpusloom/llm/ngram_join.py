"""Similarity join of texts by the Jaccard coefficient of their word shingles, with Bayesian pruning.

Texts with equal word sequences are one class with a count, known by its least identifier; where an identifier
stands on different texts, each of their classes is known by a hash of identifier and words.  Each class has a MinHash signature; classes
that agree on all values of a band fall into a bucket.  Buckets of equal members are one.  A bucket is
dealt into chunks and two chunks meet in a tile, so a bucket of any size is compared in bounded tasks.
In a tile the signatures are compared incrementally: after each stretch of values the posterior
probability (uniform prior) that a pair reaches the threshold is a binomial tail, and the pair is dropped
when it falls below the tolerance.  A pair belongs to the first band on which it agrees, so it is
decided once although it meets in several buckets.  Tiles hold signatures only; of each tile the classes that have
a pair left meet again with their texts, and their pairs are verified by whole shingle sets.  Each time a tile gives
each of its classes one row at most, so no pairs are written.

With 25 bands of 5 values a pair of similarity 0.8 meets with probability 1 - 5e-5, a more similar one
nearly surely; nothing caps buckets or partners.  Words are runs without ASCII white space, as they are;
a text of fewer than five words is one shingle.  Null texts and texts without words link with nothing
and are their own class, and so are rows without an identifier.  Rows that repeat an identifier take part each
with its own text.  Very long texts take part with all their shingles.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow_rows import batch, slices, small_batches
from corpusloom.llm.components import components
from corpusloom.llm.shingles import mixed, sequence_mark, shingle_hashes, word_hashes
from corpusloom.llm.vector_dedup import join as join_sets
from corpusloom.workdir import materialize

WORDS = 5
#: The threshold as a fraction, so that the comparison is exact.
OVER, UNDER = 4, 5
BANDS, ROWS = 25, 5
VALUES = BANDS * ROWS
#: Values compared before each look at the posterior, and the tolerance.
LOOKS, TOLERANCE = (15, 35, 65, 125), 1e-6
CHUNK_ROWS = 512
#: Identifiers that may be broadcast to fetch texts; beyond it they are joined.
BROADCAST_ROWS = 1_000_000
#: Shingles hashed at a time, so that they stay in a core's cache.
AT_A_TIME = 32_768

_RNG = np.random.Generator(np.random.PCG64(5))
FACTOR = _RNG.integers(0, 2**31, VALUES, np.uint32) * np.uint32(2) + np.uint32(1)
OFFSET = _RNG.integers(0, 2**32, VALUES, np.uint32)
BAND_FACTOR = _RNG.integers(0, 2**63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)

SIGNED = {"doc_id": pa.int64(), "text_mark": pa.int64(), "mark": pa.binary(), "sig": pa.binary()}
LEFT = {"tile": pa.int64(), "band": pa.int32(), "chunk": pa.int32(), "rep": pa.int64()}
FOUND = {"rep": pa.int64(), "n": pa.int64(), "least": pa.int64()}


@cache
def least_matches(compared: int, tolerance: float = TOLERANCE) -> int:
    """Fewest agreeing values of ``compared`` with which a pair may still reach the threshold.

    Under a uniform prior the similarity is Beta(m + 1, k - m + 1) after m of k; its mass above t is the
    chance of at most m successes in k + 1 trials of t.
    """
    t, tail = OVER / UNDER, 0.0
    for m in range(compared + 1):
        tail += comb(compared + 1, m) * t**m * (1 - t) ** (compared + 1 - m)
        if tail >= tolerance:
            return m
    return compared


def signatures(shingles: list[np.ndarray]) -> np.ndarray:
    """(n, VALUES) least hashes of each set; sets are not empty."""
    out = np.full((len(shingles), VALUES), 0xFFFFFFFF, np.uint32)
    at = 0
    while at < len(shingles):
        end, size = at, 0
        while end < len(shingles) and (end == at or size + len(shingles[end]) <= AT_A_TIME):
            size += len(shingles[end])
            end += 1
        group = [s >> np.uint64(32) for s in shingles[at:end]]
        sizes = [len(g) for g in group]
        flat = np.concatenate(group).astype(np.uint32)
        for low in range(0, len(flat), AT_A_TIME) if end == at + 1 else [0]:
            x = flat[low : low + AT_A_TIME] if end == at + 1 else flat
            heads = np.zeros(1, np.int64) if end == at + 1 else np.cumsum(sizes) - sizes
            held = np.empty_like(x)
            for k in range(VALUES):
                np.multiply(x, FACTOR[k], out=held)
                held += OFFSET[k]
                least = np.minimum.reduceat(held, heads)
                np.minimum(out[at:end, k], least, out=out[at:end, k])
        at = end
    return out


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, text_mark, mark, sig) of every row; ``text_mark`` tells texts of one identifier apart, mark and sig
    are null without words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            first, second = word_hashes([t or "" for t in b.column("text").to_pylist()])
            some = [i for i, w in enumerate(first) if len(w)]
            sigs = dict(zip(some, signatures([shingle_hashes(first[i], WORDS) for i in some]), strict=True))
            marks = [sequence_mark(*w) for w in zip(first, second, strict=True)]
            yield batch({k: b.column(k) for k in ("doc_id", "text_mark")} | {"mark": marks,
                "sig": [sigs[i].tobytes() if i in sigs else None for i in range(len(first))]}, SIGNED)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_mark")).mapInArrow(run,
        "doc_id long, text_mark long, mark binary, sig binary")


def bucket_entries(classes: DataFrame) -> DataFrame:
    """(bucket, rep) for every band of every class; the band is in the bucket's last five bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            marks = mixed((sig * BAND_FACTOR).sum(axis=2) + np.arange(BANDS, dtype=np.uint64))
            bucket = ((marks & ~np.uint64(31)) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            yield batch({"bucket": bucket.ravel(), "rep": np.repeat(b.column("rep").to_numpy(), BANDS)}, {"bucket": pa.int64(), "rep": pa.int64()})

    return classes.select("rep", "sig").mapInArrow(run, "bucket long, rep long")


class Tile:
    """Classes of one or two chunks of a bucket."""

    def __init__(self, held: list[pa.RecordBatch]) -> None:
        """From batches of one tile's rows, with tile, band, chunk, rep, sig and perhaps more columns."""
        names = held[0].schema.names
        self.tile, self.band = held[0].column("tile")[0].as_py(), held[0].column("band")[0].as_py()
        self.col = {k: np.concatenate([h.column(k).to_numpy(zero_copy_only=False) for h in held]) for k in names if k not in ("tile", "band")}
        order = np.lexsort((self.col["rep"], self.col["chunk"]))
        self.col = {k: v[order] for k, v in self.col.items()}
        self.rep, self.sig = self.col["rep"], np.frombuffer(b"".join(self.col["sig"]), np.uint32).reshape(-1, VALUES)
        self.cut = int(np.searchsorted(self.col["chunk"], self.col["chunk"][0], "right"))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that the posterior leaves and that belong to this band."""
        n, cut = len(self.rep), self.cut
        own = cut == n
        a, b = self.sig[:cut], self.sig if own else self.sig[cut:]
        r = c = None
        agree = np.zeros((len(a), len(b)), np.int16)
        done = 0
        for look in LOOKS:
            if r is None:
                for k in range(done, look):
                    agree += a[:, k, None] == b[None, :, k]
                able = agree >= least_matches(look)
                if own:
                    able = np.triu(able, 1)
                r, c = np.nonzero(able)
                agree = agree[r, c]
            else:
                for at in range(0, len(r), 50_000):
                    s = slice(at, at + 50_000)
                    agree[s] += (a[r[s], done:look] == b[c[s], done:look]).sum(axis=1).astype(np.int16)
                able = agree >= least_matches(look)
                r, c, agree = r[able], c[able], agree[able]
            done = look
        mine = np.empty(len(r), bool)
        for at in range(0, len(r), 20_000):
            s = slice(at, at + 20_000)
            same = (a[r[s]] == b[c[s]]).reshape(-1, BANDS, ROWS).all(axis=2)
            mine[s] = same[:, self.band] & ~same[:, : self.band].any(axis=1)
        return r[mine], c[mine] + (0 if own else cut)

    def verified(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Which pairs reach the threshold by their shingle sets."""
        if not len(r):
            return np.zeros(0, bool)
        used = np.unique(np.concatenate([r, c]))
        words, _ = word_hashes([self.col["text"][i] for i in used])
        sets = [np.unique(shingle_hashes(w, WORDS)) for w in words]
        size = np.array([len(s) for s in sets])
        r, c = np.searchsorted(used, r), np.searchsorted(used, c)
        if len(r) <= 4 * len(used):
            shared = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(r.tolist(), c.tolist(), strict=True)])
        else:
            shared = shared_counts(sets)[r, c]
        return shared * UNDER >= OVER * (size[r] + size[c] - shared)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices over the shingles that two sets hold."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    twice = n > 1
    number = np.cumsum(twice) - 1
    keep = twice[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    width = 4096
    for low in range(0, int(twice.sum()), width):
        a, z = np.searchsorted(column, [low, low + width])
        held = np.zeros((len(sets), width), np.float32)
        held[owner[a:z], column[a:z] - low] = 1
        out += held @ held.T
    return out.astype(np.int64)


def by_tile(rows: DataFrame, solve: Callable[[Tile], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``solve`` gives of each tile of ``rows``; a task holds one tile at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            tiles = b.column("tile").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(tiles)) + 1).tolist(), len(tiles)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a == z:
                    continue
                if held and tiles[a] != last:
                    yield from solve(Tile(held))
                    held = []
                last = tiles[a]
                held.append(b.slice(a, z - a))
        if held:
            yield from solve(Tile(held))

    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(run, schema)


def left_over(rows: DataFrame) -> DataFrame:
    """(tile, band, chunk, rep) of the classes that have a pair left; rows has tile, band, chunk, rep, sig."""

    def solve(tile: Tile) -> Iterator[pa.RecordBatch]:
        used = np.unique(np.concatenate(tile.pairs()))
        if len(used):
            yield batch({"tile": np.full(len(used), tile.tile), "band": np.full(len(used), tile.band), "chunk": tile.col["chunk"][used],
                "rep": tile.rep[used]}, LEFT)

    return by_tile(rows, solve, "tile long, band int, chunk int, rep long")


def compare(rows: DataFrame) -> DataFrame:
    """(rep, n, least) for each linked class of each tile; rows has tile, band, chunk, rep, times, sig, text."""

    def solve(tile: Tile) -> Iterator[pa.RecordBatch]:
        r, c = tile.pairs()
        good = tile.verified(r, c)
        r, c = r[good], c[good]
        if not len(r):
            return
        n, times = len(tile.rep), tile.col["times"]
        links = np.bincount(r, weights=times[c], minlength=n) + np.bincount(c, weights=times[r], minlength=n)
        sets = np.arange(n)
        join_sets(sets, r, c)
        low = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(low, sets, tile.rep)
        got = links > 0
        yield batch({"rep": tile.rep[got], "n": links[got].astype(np.int64), "least": low[sets][got]}, FOUND)

    return by_tile(rows, solve, "rep long, n long, least long")


def fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, text) of the classes in ``wanted`` (rep, id, id_mark); they are broadcast where they are few enough."""
    few = wanted.count() <= BROADCAST_ROWS
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("id_mark"), "text").where("text is not null")
    held = texts.join(F.broadcast(wanted) if few else wanted, ["id", "id_mark"])
    return held.groupBy("rep").agg(F.min("text").alias("text"))


def classes_of(signed: DataFrame) -> DataFrame:
    """(rep, id, id_mark, mark, times, sig): the classes of equal word sequences, each known by ``rep``."""
    first = F.min(F.struct("doc_id", "text_mark"))
    grouped = signed.where("able").groupBy("mark").agg(first.alias("r"), F.count("*").alias("times"), F.first("sig").alias("sig"))
    held = materialize(grouped.select(F.col("r.doc_id").alias("id"), F.col("r.text_mark").alias("id_mark"), "mark", "times", "sig"), "classes")
    again = held.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("again"))
    if again.isEmpty():
        return held.withColumn("rep", F.col("id"))
    return materialize(held.join(again, "id", "left").withColumn("rep",
        F.when(F.col("again"), F.xxhash64("id", "mark")).otherwise(F.col("id"))).drop("again"), "classes")


def link(docs: DataFrame) -> DataFrame:
    """(doc_id, text_mark, group, class_id, n_links, kept) of every row.

    ``class_id`` is the least identifier reachable by links, ``n_links`` how many other rows are linked
    directly, and ``kept`` marks rows whose identifier is the class's.  ``group`` tells classes apart, also where
    an identifier stands on different texts; it is null for rows that link with nothing by rule.
    """
    signed = materialize(sign(docs), "signatures").withColumn("able", F.expr("mark is not null and doc_id is not null"))
    classes = classes_of(signed)
    entries = bucket_entries(classes)
    buckets = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("y")).where("n > 1")
    # of buckets with equal members the one of the first band stays, to which all their pairs belong
    first = buckets.groupBy("n", "x", "y").agg(F.min(F.struct(F.col("bucket").bitwiseAND(31).alias("band"), "bucket")).alias("b"))
    chunk_count = F.ceil(F.col("n") / CHUNK_ROWS).cast("int")
    first = first.select("b.bucket", F.col("b.band").cast("int").alias("band"), chunk_count.alias("chunks"))
    members = materialize(entries.join(first, "bucket"), "buckets")
    chunk = F.pmod(F.xxhash64(F.lit(2), "rep"), F.col("chunks")).cast("int")
    dealt = members.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select(F.xxhash64("bucket", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("tile"), "band", "chunk", "rep")
    left = materialize(left_over(dealt.join(classes.select("rep", "sig"), "rep").select("tile", "band", "chunk", "rep", "sig")), "left-over")
    wanted = materialize(classes.select("rep", "id", "id_mark").join(left.select("rep").distinct(), "rep", "left_semi"), "left-over")
    facts = classes.select("rep", "times", "sig").join(fetch(docs, wanted), "rep")
    found = materialize(compare(left.join(facts, "rep").select("tile", "band", "chunk", "rep", "times", "sig", "text")), "links")
    groups = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "rep")
    ids = groups.join(classes.select("rep", "id"), "rep").groupBy("component").agg(F.min("id").alias("class_id"))
    groups = groups.join(ids, "component")
    others = found.groupBy("rep").agg(F.sum("n").alias("n"))
    named = classes.select("mark", "rep", "id", "times").join(others, "rep", "left").join(groups, "rep", "left")
    named = named.select("mark", F.coalesce("component", "rep").alias("group"), F.coalesce("class_id", "id").alias("class_id"),
        (F.col("times") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    out = signed.where("able").select("doc_id", "text_mark", "mark").join(named, "mark").select("doc_id", "text_mark", "group", "class_id", "n_links")
    alone = signed.where("not able").select("doc_id", "text_mark", F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("class_id"),
        F.lit(0).cast("long").alias("n_links"))
    return out.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))

"""Postings in ranges of units, with bounds: the best k by BM25 without moving postings, and without opening ranges that can't matter.

A file holds all postings of a range of units, in order of (length, unit), sorted by term and in one row group, so one
task reads a file whole and ranks its units by itself; k rows leave it.  Beside the files lies, by term, what a term's block in
each range holds: its number of units, how often the term stands in one at most, and the least length of one.  The two bound
the block's share of a score under any mean length, and closely, since a range's lengths are much alike.  A search opens
ranges from the greatest sum of these bounds downwards, in rounds that grow, until the k-th score found is above the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import model
from corpusloom.functions import scoring

#: Postings of a range: some tens of megabytes.
RANGE_POSTINGS = 2_000_000
#: A file is one row group, which no two tasks share, whatever the size of splits.
ROW_GROUP = 2_000_000_000
#: Ranges of the first round, and how much larger each next one is.
FIRST, GROWTH = 32, 4
#: Scores are compared at so many digits.
DIGITS = 6


@dataclass
class Read:
    """How much a search opened."""

    ranges: int = 0
    total: int = 0
    rounds: int = 0


def write(postings: DataFrame, path: str, unit: str = "unit", range_postings: int = RANGE_POSTINGS) -> None:
    """Write (term, unit, dl, tf, positions) in ranges, and the bounds of their blocks.  ``postings`` should be a written table."""
    spark = postings.sparkSession
    n = max(1, ceil(postings.count() / range_postings))
    dealt = postings.repartitionByRange(n, "dl", unit).sortWithinPartitions("term", unit)
    dealt.write.mode("overwrite").option("parquet.block.size", str(ROW_GROUP)).option("maxRecordsPerFile", 0).parquet(path)
    held = spark.read.schema(postings.schema).parquet(path)
    blocks = held.groupBy("term", F.substring_index(F.input_file_name(), "/", -1).alias("file")).agg(F.count("*").alias("n"), F.max("tf").alias("most"),
        F.min("dl").alias("least"))
    blocks.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/_bounds")


class Ranged:
    """The postings of several such tables; ``key`` is the unit's column in them."""

    def __init__(self, spark: SparkSession, paths: list[str], schema: str, key: str = "unit") -> None:
        self.spark, self.paths, self.schema, self.key = spark, paths, schema, key

    def all(self) -> DataFrame:
        held = self.spark.read.schema(self.schema).parquet(*self.paths) if self.paths else self.spark.createDataFrame([], self.schema)
        return held.withColumnRenamed(self.key, "unit")

    def blocks(self, terms: list[str]) -> DataFrame | None:
        """(file, term, n, most, least) of the terms' blocks."""
        out = None
        for path in self.paths:
            held = self.spark.read.parquet(f"{path}/_bounds").where(F.col("term").isin(terms)).withColumn("file", F.concat(F.lit(f"{path}/"), "file"))
            out = held if out is None else out.unionByName(held)
        return out

    def rows(self, files: list[str], terms: list[str], positions: bool) -> DataFrame:
        held = self.spark.read.schema(self.schema).parquet(*files).where(F.col("term").isin(terms)).withColumnRenamed(self.key, "unit")
        return held.select("term", "unit", "dl", "tf", *["positions"] * positions)

    def best(
        self, phrases: list[list[str]], limit: int, total: int, mean_dl: float, among: Callable[[DataFrame], DataFrame] | None = None,
        dead: DataFrame | None = None, read: Read | None = None
    ) -> DataFrame:
        """(unit, score, rank0) of the best ``limit`` hits; ``among`` narrows the hits, ``dead`` (unit) counts nowhere.

        The same rows as ``lexical.ranked(indexed.scores(…))``, ties by unit.
        """
        unit_type = self.all().schema["unit"].dataType.simpleString()
        shape = f"unit {unit_type}, score double"
        terms = sorted({t for p in phrases for t in p})
        none = self.spark.createDataFrame([], f"{shape}, rank0 int")
        if not terms or not self.paths or limit < 1:
            return none
        blocks = self.blocks(terms)
        df = self._frequencies(phrases, terms, blocks, dead)
        idf = [max(model.LEAST_IDF, float(np.log((total - n + 0.5) / (n + 0.5)))) for n in df]
        bounds = self._bounds(phrases, idf, blocks, mean_dl)
        if read is not None:
            read.total = bounds.count()
        order = [F.round("score", DIGITS).desc(), F.col("unit").asc()]
        best, last, step = [], None, FIRST
        while True:
            rest = bounds if last is None else bounds.where((F.col("bound") < last[0]) | ((F.col("bound") == last[0]) & (F.col("file") > last[1])))
            if len(best) == limit:  # what can't reach the last score is not opened
                rest = rest.where(F.col("bound") >= best[-1]["score"] - 10.0**-DIGITS)
            some = rest.orderBy(F.col("bound").desc(), "file").limit(step).collect()
            if some:
                hits = self._hits([r["file"] for r in some], phrases, terms, idf, mean_dl, limit if among is None and dead is None else None, shape)
                hits = hits if dead is None else hits.join(dead, "unit", "left_anti")
                hits = hits if among is None else among(hits)
                hits = hits.unionByName(self.spark.createDataFrame(best, shape)) if best else hits
                best = hits.orderBy(*order).limit(limit).collect()  # as many as asked for
                last = (some[-1]["bound"], some[-1]["file"])
            if read is not None:
                read.ranges, read.rounds = read.ranges + len(some), read.rounds + 1
            if len(some) < step:
                return self.spark.createDataFrame([(*r, i) for i, r in enumerate(best)], none.schema)
            step *= GROWTH

    def _bounds(self, phrases: list[list[str]], idf: list[float], blocks: DataFrame, mean_dl: float) -> DataFrame:
        """(file, bound): what the best unit of a range may score at most; ranges that hold no phrase are left out."""
        part = scoring.bm25_term(F.col("most"), F.col("least"), F.lit(mean_dl), F.lit(1.0))
        terms = sorted({t for p in phrases for t in p})
        at = {t: f"b{i}" for i, t in enumerate(terms)}
        wide = blocks.groupBy("file").agg(*(F.max(F.when(F.col("term") == t, part)).alias(c) for t, c in at.items()))
        bound = F.lit(0.0)
        for p, w in zip(phrases, idf, strict=True):
            # a phrase stands no more often than its rarest word
            held = [F.coalesce(at[t], F.lit(0.0)) for t in dict.fromkeys(p)]
            bound = bound + w * (held[0] if len(held) == 1 else F.least(*held))
        return wide.select("file", (bound * (1 + 1e-12)).alias("bound")).where("bound > 0")

    def _frequencies(self, phrases: list[list[str]], terms: list[str], blocks: DataFrame, dead: DataFrame | None) -> list[int]:
        """In how many units each phrase stands: by the blocks' counts; for phrases of several words, and where units are
        dead, by the postings of the ranges that hold all words of one."""
        counts = {r["term"]: r["n"] for r in blocks.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # the query's terms
        asked = [list(p) for p in {tuple(p): None for p in phrases if len(p) > 1 or dead is not None}]
        met = dict.fromkeys(map(tuple, asked), 0)
        if asked:
            has = blocks.groupBy("file").agg(F.collect_set("term").alias("has"))  # terms of the query
            holds = F.lit(False)
            for p in asked:
                holds = holds | F.forall(F.array(*(F.lit(t) for t in p)), lambda t: F.array_contains("has", t))
            files = [r["file"] for r in has.where(holds).select("file").collect()]
            if files:
                rows = self.rows(files, sorted({t for p in asked for t in p}), any(len(p) > 1 for p in asked))
                # where Spark shuffles for this join, it does so by unit: a unit's rows stay together
                rows = rows if dead is None else rows.join(dead, "unit", "left_anti")

                def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                    for held in whole(batches):
                        n = [int((tf > 0).sum()) for tf in times(held, asked)[1]]
                        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(n)), pa.int32()), "n": pa.array(n, pa.int64())})

                for r in rows.mapInArrow(count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
                    met[tuple(asked[r["i"]])] = r["n"]
        return [met[tuple(p)] if tuple(p) in met else counts.get(p[0], 0) for p in phrases]

    def _hits(self, files: list[str], phrases: list[list[str]], terms: list[str], idf: list[float], mean_dl: float, limit: int | None,
        shape: str) -> DataFrame:
        """(unit, score) of the files' hits; with a limit only the best of each task."""
        k1, b = model.BM25_K1, model.BM25_B

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held in whole(batches):
                units, tfs, dl = times(held, phrases)
                score = np.zeros(len(units))
                for tf, w in zip(tfs, idf, strict=True):
                    score += w * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean_dl))
                hit = np.flatnonzero(np.any([tf > 0 for tf in tfs], axis=0))
                if limit is not None and len(hit) > limit:
                    value = np.floor(score[hit] * 10.0**DIGITS + 0.5)
                    least = -np.partition(-value, limit - 1)[limit - 1]
                    above, level = hit[value > least], hit[value == least]
                    # of those level with the last, the first by unit
                    order = pc.sort_indices(units.take(pa.array(level))).to_numpy()[: limit - len(above)]
                    hit = np.concatenate([above, level[order]])
                yield pa.RecordBatch.from_arrays([units.take(pa.array(hit)), pa.array(score[hit])], ["unit", "score"])

        return self.rows(files, terms, any(len(p) > 1 for p in phrases)).mapInArrow(rank, shape)


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A task's rows, if it has any: what a few words have in the ranges of one split."""
    if held := [b for b in batches if b.num_rows]:
        yield pa.Table.from_batches(held)


def times(held: pa.Table, phrases: list[list[str]]) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    """Units, how often each phrase stands in each, and their lengths."""
    coded = held["unit"].combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    unit, n = coded.indices.to_numpy(), len(coded.dictionary)
    term = held["term"].combine_chunks()
    dl, tf = np.zeros(n), held["tf"].to_numpy()
    dl[unit] = held["dl"].to_numpy()
    at = {t: np.flatnonzero(pc.equal(term, t).to_numpy(zero_copy_only=False)) for t in {t for p in phrases for t in p}}
    span, keys = 0, {}
    if any(len(p) > 1 for p in phrases):
        lists = held["positions"].combine_chunks()
        for t in {t for p in phrases if len(p) > 1 for t in p}:
            own = lists.take(pa.array(at[t]))
            size = pc.list_value_length(own).to_numpy()
            keys[t] = (np.repeat(unit[at[t]].astype(np.int64), size), own.flatten().to_numpy().astype(np.int64))
        span = 1 + max(max((int(p.max()) for _, p in keys.values() if len(p)), default=0), max(map(len, phrases)))
    out = []
    for p in phrases:
        if len(p) == 1:
            got = np.zeros(n)
            got[unit[at[p[0]]]] = tf[at[p[0]]]
        else:
            # places of the first word behind which the others stand
            met = None
            for k, t in enumerate(p):
                own, place = keys[t]
                start = (own * span + place - k)[place >= k]
                met = start if met is None else np.intersect1d(met, start, assume_unique=True)
            got = np.bincount(met // span, minlength=n).astype(float)
        out.append(got)
    return coded.dictionary, out, dl

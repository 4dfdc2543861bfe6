"""Exact nearest neighbours without reading all vectors: clusters with centre and radius.

Vectors are written sorted by the cluster of their nearest centre, with the list of files by cluster (see ``keyed``) and a small table
of clusters: centre, radius (the largest distance of a member from it) and size.  By the triangle inequality no member is nearer to a query
than its distance from the centre less the radius.  A query reads the clusters of least bound first, and goes on until no
other cluster's bound reaches the last of the best: the result is that of a scan.

Centres come from a bounded sample, drawn by hash; they decide how much is read, never what is found.  Vectors that are null, of
another length than most, or hold null or non-finite values are a cluster without centre, which every query reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import inf, isnan, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.batching import slices, small_batches
from corpusloom.functions import scoring
from corpusloom.operators import keyed

#: Clusters of a table at most, vectors of the sample for each of them, and rounds in which centres move.
MOST, SAMPLED, ROUNDS = 1024, 8, 6
#: A cluster without centre.
LOOSE = -1
#: What rounding of distances can hide.
SLACK = 2e-6
CENTRES = "cluster int, centre array<double>, radius double, n long"


def centres_of(rows: DataFrame, key: str) -> np.ndarray:
    """Centres of a sample of at most MOST * SAMPLED vectors, which is brought to the driver."""
    good = F.expr("embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    size = rows.where(good).groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if size is None:
        return np.empty((0, 0))
    k = min(MOST, max(1, isqrt(size["n"])))
    drawn = rows.where(good & (F.size("embedding") == size["d"])).orderBy(F.xxhash64(key)).limit(k * SAMPLED).select("embedding").collect()
    x = np.array([r["embedding"] for r in drawn], np.float64)
    centres = x[:k].copy()
    for _ in range(ROUNDS):
        near = assigned(x, centres)[0]
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def assigned(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centre and its distance from it."""
    square = (centres * centres).sum(1)
    near = np.argmin(square - 2 * (x @ centres.T), axis=1)
    return near, np.sqrt(((x - centres[near]) ** 2).sum(1))


def write(rows: DataFrame, path: str, key: str, file_rows: int = keyed.FILE_ROWS) -> None:
    """Write rows (key, embedding and others) by cluster, and the table of clusters."""
    spark = rows.sparkSession
    small_batches(spark)
    centres = centres_of(rows, key)
    dims = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            held = b.column("embedding").to_pylist()
            able = [v is not None and len(v) == dims > 0 and None not in v for v in held]
            x = np.array([v for v, ok in zip(held, able, strict=True) if ok], np.float64).reshape(sum(able), dims)
            sound = np.isfinite(x).all(1)
            cluster, away = np.full(len(held), LOOSE, np.int32), np.zeros(len(held))
            spot = np.flatnonzero(able)[sound]
            if len(spot):
                cluster[spot], away[spot] = assigned(x[sound], centres)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cluster), pa.array(away)], [*b.schema.names, "cluster", "away"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    keyed.write(rows.mapInArrow(run, f"{schema}, cluster int, away double"), path, "cluster", file_rows)
    held = spark.read.parquet(path).groupBy("cluster").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()  # a row for each cluster
    named = [(r["cluster"], [] if r["cluster"] == LOOSE else centres[r["cluster"]].tolist(), r["radius"], r["n"]) for r in held]
    spark.createDataFrame(named, CENTRES).coalesce(1).write.mode("overwrite").parquet(f"{path}/_centres")


@dataclass
class Read:
    """What a query has read: vectors, of how many, in how many rounds."""

    vectors: int = 0
    total: int = 0
    rounds: int = 0


@dataclass
class Clustered:
    """Vectors of several such tables; ``schema`` is that of the rows they were written from."""

    spark: SparkSession
    paths: list[str]
    schema: str
    key: str
    _tables: list[tuple[keyed.Keyed, list]] | None = field(default=None, repr=False)

    def tables(self) -> list[tuple[keyed.Keyed, list]]:
        if self._tables is None:
            self._tables = [(keyed.Keyed(self.spark, [p], f"{self.schema}, cluster int, away double", "cluster"),
                self.spark.read.schema(CENTRES).parquet(f"{p}/_centres").collect()) for p in self.paths]  # MOST rows each
        return self._tables

    def bounds(self, query: list[float]) -> list[tuple[float, int, int, int]]:
        """(least distance, table, cluster, vectors) of every cluster, nearest first."""
        q, out = np.array(query, np.float64), []
        for t, (_, held) in enumerate(self.tables()):
            for r in held:
                loose = r["cluster"] == LOOSE or len(r["centre"]) != len(q)
                bound = 0.0 if loose else max(0.0, float(np.sqrt(((q - np.array(r["centre"])) ** 2).sum())) - r["radius"] - SLACK)
                out.append((bound, t, r["cluster"], r["n"]))
        return sorted(out)

    def nearest(self, query: list[float], limit: int, among=None, digits: int = 6, read: Read | None = None) -> DataFrame:
        """(key, distance, rank0) of the nearest, ties by key; ``among`` takes the rows that are read to those that count."""
        left = self.bounds(query)
        read = read or Read()
        read.total += sum(n for *_, n in left)
        best: list[tuple] = []
        wanted = 4 * limit
        while left and (len(best) < limit or left[0][0] <= best[-1][0] + SLACK):
            # as many of the nearest as should hold the best; each next round twice as many, but none that the best rule out
            taken, n = 0, 0
            while taken < len(left) and (n < wanted or taken == 0) and (len(best) < limit or left[taken][0] <= best[-1][0] + SLACK):
                n += left[taken][3]
                taken += 1
            now, left, wanted = left[:taken], left[taken:], wanted * 2
            read.vectors, read.rounds = read.vectors + n, read.rounds + 1
            best = self._best(now, query, limit, among, digits, best)
        kind = {f.split()[0]: f.split()[1] for f in self.schema.split(", ")}[self.key]
        return self.spark.createDataFrame([(k, d, i) for i, (_, k, d) in enumerate(best)], f"{self.key} {kind}, distance double, rank0 int")

    def _best(self, now: list[tuple], query: list[float], limit: int, among, digits: int, best: list[tuple]) -> list[tuple]:
        rows = None
        for t, (table, _) in enumerate(self.tables()):
            if mine := [c for _, of, c, _ in now if of == t]:
                part = table.rows(mine)
                rows = part if rows is None else rows.unionByName(part)
        rows = rows if among is None else among(rows)
        measured = rows.select(self.key, scoring.l2(F.col("embedding"), query).alias("distance")).withColumn("near", F.round("distance", digits))
        found = measured.where("distance is not null").orderBy("near", self.key).limit(limit).collect()
        # a distance that is no number comes after all others
        return sorted([*best, *((inf if isnan(r["near"]) else r["near"], r[self.key], r["distance"]) for r in found)])[:limit]

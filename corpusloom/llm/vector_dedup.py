"""Near duplicates among vectors by PCA-ordered tiled comparison.

Every pair at or above the cosine is found, and none below it.  Unit vectors are turned into the basis
of their principal directions (of the second moments of all vectors), where most of a product lies in
the leading coordinates.  Vectors are dealt into blocks along the first direction and within each stretch of it
along the second; two blocks meet in a
tile unless the ranges of their leading coordinates and their residual norms rule it out.  Which do is found
by tasks over blocks; the driver holds one row of ranges for each block, never a row for a pair.  Within a
tile the products of the leading coordinates are summed first, the rest is bounded by the product of
suffix norms, and pairs that cannot reach the cosine stop there; the others go on over the next
coordinates.  Pairs within rounding of the cosine are decided by the vectors as given.

Equal vectors are compared once, with how often they occur.  A tile gives each of its vectors one row
at most: how many it is linked to and the least vector it is joined with there; so a group of near
copies costs comparisons but no rows by pair.  Vectors of different lengths link with nothing of the
other length.  Vectors that are null or empty, zero, hold null or non-finite components, or have no
identifier link with nothing.  Rows that repeat are vectors of their own.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.arrow_rows import batch, small_batches
from corpusloom.llm.components import components
from corpusloom.workdir import materialize

COSINE = 0.9
#: A block of this size holds 8192 vectors of 64 coordinates; a task holds two blocks at a time.  Fewer vectors still
#: make so many blocks, so that their tiles are many tasks.
BLOCK_BYTES, LEAST_BLOCKS = 4 * 1024 * 1024, 8
#: Blocks compared with all others by one task.
BLOCKS_AT_A_TIME = 256
#: Rows of each side compared at once, and coordinates added at once.
PATCH_ROWS, LEAD = 1024, 16
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def vectors_of(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def second_moments(distinct: DataFrame, dim: int) -> np.ndarray:
    types = {"i": pa.int32(), "j": pa.int32(), "v": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            x = unit(vectors_of(b.column("raw"), dim))
            total += x.T @ x
        i, j = np.triu_indices(dim)
        yield batch({"i": i, "j": j, "v": total[i, j]}, types)

    out = np.zeros((dim, dim))
    for i, j, v in distinct.select("raw").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = out[j, i] = v
    return out


class Tile:
    """Links among the vectors of one or two blocks."""

    def __init__(self, raw: np.ndarray, turn: np.ndarray, times: np.ndarray, cosine: float) -> None:
        self.raw, self.times, self.cosine = raw, times, cosine
        self.x = unit(raw) @ turn
        dim = raw.shape[1]
        self.steps = [*range(0, dim, LEAD), dim]
        squares = self.x * self.x
        self.suffix = [np.sqrt(squares[:, s:].sum(axis=1)) for s in self.steps]
        self.links = np.zeros(len(raw), np.int64)
        self.least = np.arange(len(raw))

    def compare(self, a: slice, b: slice) -> None:
        r, c, dots = self._survivors(a, b)
        near = np.abs(dots - self.cosine) <= SLACK
        if near.any():
            u, v = unit(self.raw[r[near]]), unit(self.raw[c[near]])
            dots[near] = (u * v).sum(axis=1)
        linked = dots >= self.cosine
        r, c = r[linked], c[linked]
        if len(r):
            n = len(self.links)
            self.links += np.bincount(r, weights=self.times[c], minlength=n).astype(np.int64) + np.bincount(c, weights=self.times[r],
                minlength=n).astype(np.int64)
            join(self.least, r, c)

    def _survivors(self, a: slice, b: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        least = self.cosine - SLACK
        head = slice(0, self.steps[1])
        dots = self.x[a, head] @ self.x[b, head].T
        able = dots + np.outer(self.suffix[1][a], self.suffix[1][b]) >= least
        if a == b:
            able = np.triu(able, 1)
        r, c = np.nonzero(able)
        dots = dots[r, c]
        r, c = r + a.start, c + b.start
        for k in range(1, len(self.steps) - 1):
            part = slice(self.steps[k], self.steps[k + 1])
            for at in range(0, len(r), 100_000):
                s = slice(at, at + 100_000)
                dots[s] += np.einsum("ij,ij->i", self.x[r[s], part], self.x[c[s], part])
            able = dots + self.suffix[k + 1][r] * self.suffix[k + 1][c] >= least
            r, c, dots = r[able], c[able], dots[able]
        return r, c, dots


def join(least: np.ndarray, r: np.ndarray, c: np.ndarray) -> None:
    """Merge the sets of r[i] and c[i]; ``least`` holds for each member the least of its set."""
    while True:
        a, b = least[r], least[c]
        if (a == b).all():
            return
        low = np.minimum(a, b)
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        while True:
            up = least[least]
            if (up == least).all():
                break
            least[:] = up


FOUND = {"rep": pa.int64(), "n": pa.int64(), "least": pa.int64()}


def compare_tiles(rows: DataFrame, dim: int, turn: np.ndarray, cosine: float) -> DataFrame:
    """(rep, n, least) for each linked vector of each tile; ``rows`` has tile, block, rep, times, raw."""

    def solve(rows: list[dict[str, list]]) -> Iterator[pa.RecordBatch]:
        rep = np.concatenate([x["rep"] for x in rows])
        block = np.concatenate([x["block"] for x in rows])
        order = np.lexsort((rep, block))
        rep, block = rep[order], block[order]
        raw = np.frombuffer(b"".join(b"".join(x["raw"]) for x in rows), "<f8").reshape(-1, dim)[order]
        tile = Tile(raw, turn, np.concatenate([x["times"] for x in rows])[order], cosine)
        cut = int(np.searchsorted(block, block[0], "right"))
        left = [slice(i, min(i + PATCH_ROWS, cut)) for i in range(0, cut, PATCH_ROWS)]
        right = [slice(i, min(i + PATCH_ROWS, len(rep))) for i in range(cut, len(rep), PATCH_ROWS)]
        # a tile of one block compares it with itself, a tile of two only one with the other
        for i, a in enumerate(left):
            for b in right or left[i:]:
                tile.compare(a, b)
        got = tile.links > 0
        # members of a set agree on one of them; which is told by identifier
        low = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(low, tile.least, rep)
        yield batch({"rep": rep[got], "n": tile.links[got], "least": low[tile.least][got]}, FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        last = None
        for b in batches:
            tiles = b.column("tile").to_numpy()
            for at in [0, *(np.flatnonzero(np.diff(tiles)) + 1)] if len(tiles) else []:
                if last is not None and tiles[at] != last:
                    yield from solve(held)
                    held = []
                last = tiles[at]
                n = int(np.searchsorted(tiles[at:], last, "right"))
                part = b.slice(at, n)
                held.append({k: part.column(k).to_numpy(zero_copy_only=False) for k in ("rep", "block", "times", "raw")})
        if held:
            yield from solve(held)

    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(run, "rep long, n long, least long")


class Grid:
    """Blocks of vectors: stretches of the first coordinate, each cut along the second, overfull ones split by a hash."""

    def __init__(self, first: list[float], second: list[list[float]]) -> None:
        self.first, self.second = np.array(first), [np.array(c) for c in second]
        self.cells = np.cumsum([0, *(len(c) + 1 for c in second)])
        self.many = np.ones(self.cells[-1], np.int64)

    def of(self, rep: np.ndarray, lead: np.ndarray) -> np.ndarray:
        along = np.searchsorted(self.first, lead[:, 0])
        cell = self.cells[along]
        for k in np.unique(along):
            here = along == k
            cell[here] += np.searchsorted(self.second[k], lead[here, -1 if lead.shape[1] < 2 else 1])
        x = rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (np.cumsum(self.many) - self.many)[cell] + ((x >> np.uint64(33)) % self.many[cell].astype(np.uint64)).astype(np.int64)


def blocked(placed: DataFrame, grid: Grid) -> DataFrame:
    """``placed`` with the block of each row."""
    names = placed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lead = b.column("lead")
            if len(lead):
                block = grid.of(b.column("rep").to_numpy(), np.asarray(lead.flatten()).reshape(len(lead), -1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block, pa.int32())], [*names, "block"])

    return placed.mapInArrow(run, "rep long, times long, raw binary, lead array<double>, tail double, block int")


def grid_of(placed: DataFrame, total: int, block_rows: int) -> Grid:
    """About equal blocks of ``block_rows``: as many stretches along the first coordinate as cuts along the second."""
    wanted = max(1, -(-total // block_rows))
    slabs = max(1, round(wanted**0.5))
    each = -(-wanted // slabs)

    def quantiles(column: Column, n: int) -> Column:
        return F.percentile_approx(column, [k / n for k in range(1, n)], max(10_000, 20 * n))

    first = sorted(set(placed.agg(quantiles(placed.lead[0], slabs)).first()[0])) if slabs > 1 else []
    second: list[list[float]] = [[] for _ in range(len(first) + 1)]
    if each > 1:
        coordinate = F.element_at("lead", 2) if len(placed.first()["lead"]) > 1 else F.element_at("lead", 1)
        slab = blocked(placed, Grid(first, second)).groupBy("block").agg(quantiles(coordinate, each))
        for k, cuts in slab.collect():
            second[k] = sorted(set(cuts))
    grid = Grid(first, second)
    # equal coordinates can overfill a block, which a hash then splits
    for k, n in blocked(placed, grid).groupBy("block").count().collect():
        grid.many[k] = -(-n // block_rows) if n > 1.5 * block_rows else 1
    return grid


def linked(distinct: DataFrame, dim: int, cosine: float, block_rows: int | None) -> DataFrame:
    """(rep, n, least) over all tiles; ``distinct`` has rep, times, raw."""
    moments = second_moments(distinct, dim)
    values, turn = np.linalg.eigh(moments)
    turn = turn[:, np.argsort(values)[::-1]]
    lead = min(8, dim)
    types = {"rep": pa.int64(), "times": pa.int64(), "raw": pa.binary(), "lead": pa.list_(pa.float64()), "tail": pa.float64()}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(vectors_of(b.column("raw"), dim)) @ turn
            yield batch({k: b.column(k) for k in ("rep", "times", "raw")} | {"lead": list(x[:, :lead]),
                "tail": np.sqrt((x[:, lead:] ** 2).sum(axis=1))}, types)

    placed = materialize(distinct.select("rep", "times", "raw").mapInArrow(project,
        "rep long, times long, raw binary, lead array<double>, tail double"), "vectors")
    total = placed.count()
    most = max(PATCH_ROWS, min(BLOCK_BYTES // (8 * dim), -(-total // LEAST_BLOCKS)))
    placed = blocked(placed, grid_of(placed, total, block_rows or most))
    bounds = [F.min(placed.lead[i]) for i in range(lead)] + [F.max(placed.lead[i]) for i in range(lead)]
    stats = {r[0]: np.array(r[1:]) for r in placed.groupBy("block").agg(*bounds, F.max("tail")).collect()}
    tiles = pairs_of_blocks(distinct.sparkSession, stats, lead, cosine)
    rows = placed.join(tiles, placed.block == tiles.in_block).select("tile", "block", "rep", "times", "raw")
    return compare_tiles(rows, dim, turn, cosine)


def pairs_of_blocks(spark: SparkSession, stats: dict[int, np.ndarray], lead: int, cosine: float) -> DataFrame:
    """(tile, in_block) of every pair of blocks that could hold a link, from ranges and residual norms."""
    names = np.array(sorted(stats))
    low, high, tail = (np.array([stats[k][p] for k in names.tolist()]) for p in (slice(0, lead), slice(lead, 2 * lead), 2 * lead))
    types = {"tile": pa.int64(), "in_block": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column("id").to_pylist():
                products = np.maximum.reduce([low[i] * low[i:], low[i] * high[i:], high[i] * low[i:], high[i] * high[i:]])
                met = np.flatnonzero(products.sum(axis=1) + tail[i] * tail[i:] >= cosine - SLACK) + i
                tile = i * len(names) + met
                other = met != i
                yield batch({"tile": np.concatenate([tile, tile[other]]),
                    "in_block": np.concatenate([np.full(len(met), names[i]), names[met[other]]])}, types)

    tasks = -(-len(names) // BLOCKS_AT_A_TIME)
    return spark.range(0, len(names), 1, tasks).mapInArrow(run, "tile long, in_block int")


def dedup(vectors: DataFrame, cosine: float = COSINE, block_rows: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    good = "vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    rows = rows.withColumn("good", F.coalesce(F.expr(good), F.lit(False)))
    # negative zeros equal zeros
    rows = rows.withColumn("v", F.when(F.col("good"), F.transform("v", lambda x: x + F.lit(0.0))))
    grouped = rows.where("good").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.asarray(v, "<f8").tobytes() for v in b.column("v").to_numpy(zero_copy_only=False)]
            yield batch({"rep": b.column("rep"), "times": b.column("times"), "dim": [len(r) // 8 for r in raw], "raw": raw},
                {"rep": pa.int64(), "times": pa.int64(), "dim": pa.int32(), "raw": pa.binary()})

    distinct = materialize(grouped.mapInArrow(pack, "rep long, times long, dim int, raw binary"), "vectors")
    found = None
    for (dim,) in sorted(distinct.select("dim").distinct().collect()):
        part = linked(distinct.where(F.col("dim") == dim), dim, cosine, block_rows)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialize(found, "links")
    groups = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    others = found.groupBy("rep").agg(F.sum("n").alias("n"))
    facts = distinct.select("rep", "times").join(others, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    facts = facts.select("rep", (F.col("times") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"))
    named = grouped.select("v", "rep").join(facts, "rep").drop("rep")
    single = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where("good").join(named, "v").select("vec_id", "n_links", "component_id").union(single)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

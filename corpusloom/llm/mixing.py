"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents are dealt into blocks by a seeded hash; a source's target in words becomes an
exact quota of block draws: each whole pass over the source draws every block once, in a permutation of its
own, and the rest draws some blocks once more.  The tree splits the quotas of all sources between two halves
of the output shards, then each half between its halves, by one multivariate-hypergeometric draw a node,
until every shard has its own exact count of draws of every source.  A shard draws its blocks as one
stretch of the source's permuted passes, so stretches of different shards are disjoint and copies of a
document lie a pass apart; within a shard rows are ordered by a seeded hash of the row, its copy and the
shard, so that copies which meet in one shard don't stand together.

The last block of a source is taken in part.  It is dealt into blocks again, of which one is taken in part:
document by document in permuted order, the last one for as many words as the quota still lacks, so that
taken words meet the target to a word.

Only sums by source and block reach the driver: ``BLOCKS`` in all and one for each source.  A source with a
third of all rows has a third of the blocks; no source's rows meet in one task.  Shards follow the size of
the mix, ``SHARD_WORDS`` each, down to ``LEAST_DRAWS`` draws a shard.  The seed and the rows alone decide
the result, so reruns agree.

Null texts have no words and are taken zero times; a null source is a source, the last.  A source
without words has target 0.  Repeated rows are dealt each, with or without an identifier.  An empty table
gives no rows; other columns of the input stay unless the names are those returned.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.workdir import materialize

# Weights of the sources in order, and how often a source may be repeated.
WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Blocks of all sources together (besides one for each), rows of a block at least, and the seed of every draw.
BLOCKS, LEAST_ROWS, SEED = 65_536, 4, 20240607
#: Words of an output shard, and the draws it has at least.
SHARD_WORDS, LEAST_DRAWS = 2_000_000, 4
#: Facts of blocks that may be broadcast, of some 60 bytes each; beyond it rows are joined to them.
BROADCAST_FACTS = 200_000

Name = str | None


def targets(sizes: dict[Name, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> dict[Name, float]:
    """Words each source should give.

    Sources in code-point order, null last, weigh ``weights`` in turn and share all words; a share stops
    at ``most`` times the source's words and the excess is shared by weight among those below.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out = dict.fromkeys(names, 0.0)
    left, open_ = float(sum(sizes.values())), set(names)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > most * sizes[s]}
        for s in over or open_:
            out[s] = float(most * sizes[s]) if over else share * weight[s]
        if not over:
            break
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards x sources) counts of draws whose columns sum to ``quotas`` and whose rows differ by one at most."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def deal(counts: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[low] = counts
            return
        middle = (low + high) // 2
        total = int(counts.sum())
        share = total * (middle - low) // (high - low)
        # each node has a generator of its own, so its draw doesn't hang on the order of the walk
        rng = np.random.Generator(np.random.PCG64([seed, low, high]))
        left = rng.multivariate_hypergeometric(counts, share, method="marginals") if total else counts
        deal(left, low, middle)
        deal(counts - left, middle, high)

    deal(np.asarray(quotas, np.int64), 0, shards)
    return out


@dataclass
class Block:
    """A block's words, the shards that draw it whole, and what one more draw takes of it in part."""

    words: int
    shards: list[int]
    more: int = 0
    more_shard: int = 0


def permuted(names: list[int], seed: int, *path: int) -> list[int]:
    rng = np.random.Generator(np.random.PCG64([seed, *path]))
    return [names[i] for i in rng.permutation(len(names))]


def plan(words: dict[Name, dict[int, int]], goal: dict[Name, float], seed: int, shards: int | None = None) -> dict[tuple[Name, int], Block]:
    """Which shards draw each block, from the words of every block of every source."""
    drawn: list[list[tuple[int, int]]] = []
    for k, source in enumerate(goal):
        held = words[source]
        left, draws = round(goal[source]), []
        size = sum(held.values())
        for number in range(left // size + 1 if size else 0):
            for block in permuted(sorted(held), seed, k, number):
                if left and held[block]:
                    draws.append((block, min(left, held[block])))
                    left -= draws[-1][1]
        drawn.append(draws)
    if shards is None:
        shards = max(1, min(-(-sum(n for d in drawn for _, n in d) // SHARD_WORDS), sum(map(len, drawn)) // LEAST_DRAWS))
    cuts = split_tree(np.array([len(d) for d in drawn], np.int64), shards, seed) if drawn else np.zeros((shards, 0), np.int64)
    out = {(source, block): Block(n, []) for source in goal for block, n in words[source].items()}
    for k, source in enumerate(goal):
        of = np.searchsorted(np.cumsum(cuts[:, k]), np.arange(len(drawn[k])), "right").tolist()
        for shard, (block, n) in zip(of, drawn[k], strict=True):
            b = out[source, block]
            if n == b.words:
                b.shards.append(shard)
            else:
                b.more, b.more_shard = n, shard
    return out


def marked(docs: DataFrame, seed: int, *columns: Column) -> DataFrame:
    """``columns`` with each row's source as a name that is never null, and a seeded hash of the row."""
    of = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select(*columns, of.alias("of"), F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")).alias("mark"))


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def name_of(of: str) -> Name:
    return of[1:] if of else None


class Mix:
    """The plan of a mix: facts about sources, blocks and parts of blocks, that any pass over the rows can use."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, blocks: int = BLOCKS, shards: int | None = None,
        seed: int = SEED) -> None:
        self.spark, self.seed = docs.sparkSession, seed
        #: doc_id, source, size, of, mark of every row
        self.rows = materialize(marked(docs, seed, F.col("doc_id"), F.col("source").cast("string").alias("source"),
            size_of(F.col("text")).alias("size")), "mixing")
        sums = {r[0]: (r[1], r[2]) for r in self.rows.groupBy("of").agg(F.count("*"), F.sum("size")).collect()}
        share = max(LEAST_ROWS, sum(n for n, _ in sums.values()) / blocks)
        sizes = {name_of(of): words for of, (_, words) in sums.items()}
        goal = targets(sizes, weights, most)
        facts = [(of, -int(-n // share), words, goal[name_of(of)]) for of, (n, words) in sums.items()]
        self.sources = self._frame(facts, "of string, blocks int, source_size long, target double")
        words: dict[Name, dict[int, int]] = defaultdict(dict)
        for of, block, n in self._numbered(self.rows).groupBy("of", "block").agg(F.sum("size")).collect():
            words[name_of(of)][block] = n
        drawn = plan(words, goal, seed, shards)
        self.shards = 1 + max((s for b in drawn.values() for s in [*b.shards, b.more_shard]), default=0)
        rows = [(self._of(s), k, b.shards, b.more > 0, b.more_shard) for (s, k), b in drawn.items()]
        self.blocks = self._frame(rows, "of string, block int, shards array<int>, cut boolean, more_shard int")
        more = {s: b.more for (s, _), b in drawn.items() if b.more}
        self.parts = self._frame(self._cut_parts(more), "of string, part int, rest long, whole boolean")

    @staticmethod
    def _of(name: Name) -> str:
        return "" if name is None else f"={name}"

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        frame = self.spark.createDataFrame(rows, schema)
        return F.broadcast(frame) if len(rows) <= BROADCAST_FACTS else frame

    def _numbered(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the facts of their source, their block, and their part of it."""
        block = F.pmod("mark", F.col("blocks").cast("long")).cast("int")
        part = F.pmod(F.xxhash64(F.lit(self.seed), "mark"), F.col("blocks").cast("long")).cast("int")
        return rows.join(self.sources, "of").withColumns({"block": block, "part": part})

    def _cut_parts(self, more: dict[Name, int]) -> list[tuple]:
        """What is taken of each part of the blocks that are taken in part, one of which is cut itself."""
        cut = self._numbered(self.rows).join(self.blocks.where("cut"), ["of", "block"])
        held: dict[Name, dict[int, int]] = defaultdict(dict)
        for of, part, n in cut.groupBy("of", "part").agg(F.sum("size")).collect() if more else []:
            held[name_of(of)][part] = n
        out = []
        for source in held:
            left = more[source]
            for part in permuted(sorted(held[source]), self.seed, zlib.crc32(self._of(source).encode())):
                n = min(left, held[source][part])
                out.append((self._of(source), part, n, n == held[source][part]))
                left -= n
        return out

    def dealt(self, rows: DataFrame, size: Column) -> DataFrame:
        """``rows`` (with of, mark) with size, source_size, target, and ``draws``: an array of (shard, copy, words)."""
        every = self._numbered(rows).join(self.blocks, ["of", "block"])
        every = every.join(self.parts, ["of", "part"], "left").withColumn("rest", F.when(F.col("cut"), F.col("rest")))
        inside = F.col("cut") & F.coalesce(~F.col("whole"), F.lit(False)) & (F.col("rest") > 0)
        # only the rows of the one part of a source that is cut meet, in permuted order
        before = F.sum("size").over(Window.partitionBy("of").orderBy("mark", "size").rowsBetween(Window.unboundedPreceding, -1))
        cut = every.where(inside).withColumn("size", size).withColumn("more",
            F.greatest(F.lit(0), F.least("size", F.col("rest") - F.coalesce(before, F.lit(0)))))
        others = every.where(~inside).withColumn("size", size).withColumn("more",
            F.when(F.col("cut") & F.coalesce("whole", F.lit(False)), F.col("size")).otherwise(0))
        both = cut.unionByName(others)
        draws = F.transform("shards", lambda s, k: F.struct(s.alias("shard"), k.alias("copy"), F.col("size").alias("words")))
        last = F.struct(F.col("more_shard").alias("shard"), F.size("shards").alias("copy"), F.col("more").cast("long").alias("words"))
        draws = F.filter(F.concat(draws, F.array(last)), lambda d: d["words"] > 0)
        return both.withColumn("draws", draws).drop("block", "blocks", "part", "shards", "cut", "more_shard", "rest", "whole", "more", "of")


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, draws) of every row.

    ``taken`` is in words, repeats counted; ``draws`` holds the shard, the number of the copy and the words of each.
    """
    made = Mix(docs, **options)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return made.dealt(made.rows, F.col("size")).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "draws")


def draw(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, the last copy cut to the words taken.

    One partition for each shard, in order; rows of a shard are in the order of a hash of row, copy and shard.
    """
    made = Mix(docs, **options)
    # the input's columns travel as one, so that none can clash with ours
    rows = made.dealt(marked(docs, made.seed, F.struct(*docs.columns).alias("row")), size_of(F.col("row.text")))
    copies = rows.select("row", "mark", "size", F.explode("draws").alias("d")).select("row", "mark", "size", "d.*")
    whole = F.col("words") == F.col("size")
    text = F.when(whole, F.col("row.text")).otherwise(first_words(F.col("row.text"), F.col("words")))
    place = F.xxhash64(F.lit(made.seed), "mark", "copy", "shard")
    placed = copies.select("row", "size", "words", "shard", place.alias("place"), text.alias("text"))
    placed = placed.repartitionById(made.shards, F.col("shard")).sortWithinPartitions("shard", "place", "words")
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return placed.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words of a text, joined by one blank."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), 0), 1, n.cast("int")), " ")

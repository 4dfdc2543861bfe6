"""Quality rules: plain counts of a text, and robust multivariate outliers within its language and source.

Everything is DataFrame functions.  Each text gives counts in one pass over its own words and lines; rows
carry numbers only from then on.  Texts that pass the base rules are described by four transformed
statistics (logarithm of the mean word length; square roots of symbols by character, of repeated lines
by line and of words in repeated triples by word).  For each language and source the minimum-covariance-
determinant estimate has two starts, medians with median deviations and with interquartile ranges.  From each it
takes concentration steps, in which the half of the rows that is nearest gives the next mean and covariance, until
the determinant settles; the core of least determinant counts, so that junk must hold about half of a group
to move the estimate.  The rows within ``INNER`` of that core give the last mean and covariance.  The covariance has a floor on
its diagonal, so that statistics that hardly vary in clean text don't reject small deviations, and is
scaled so that the median distance is that of a normal sample (it is never shrunk).  A text is rejected when its squared
Mahalanobis distance exceeds ``CUTOFF``.

Estimates are made from cells: rows of a group whose statistics fall on the same point of a grid of 1 / ``GRID``, so that a value
moves by a fortieth of the least floor at most.  Every row counts, and a step costs as much as there are cells, whatever the number
of rows.  Distances of rows are from their own statistics.

Groups are aggregates, combined before the shuffle; a group with a third of all rows is no larger
there than any other.  Null languages and sources are groups of their own.  Groups with fewer than
``LEAST_ROWS`` passing rows are judged by the estimate of all rows of their language, and languages with
fewer by that of all rows, so every row that passes the base rules has a distance.  Null and empty texts have no words and fail
the base rules.  Texts of any length are counted whole; repeated rows get equal verdicts.  An
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.workdir import materialize

# Words, symbols and limits of the base rules.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS, MOST_REPEATED = 50, 50

STATISTICS = ("word_length", "symbols", "dup_lines", "repeats")
#: Standard deviations that a statistic is taken to have at least.
FLOORS = (0.06, 0.05, 0.12, 0.10)
NEAREST, LEAST_ROWS = 0.5, 50
#: A core has settled when its determinant's logarithm falls by no more than this; floors bound it from below.
SETTLED = 1e-3
#: Squared distance of the outermost one in 10**7 of a normal sample in four dimensions, and its median.
CUTOFF, MEDIAN = 38.2, 3.357
#: Squared distance within which a row counts in the last estimate: that of 97.5 % of a normal sample.
INNER = 11.143
#: Points of a statistic's grid by unit, and of a distance's logarithm, from which quantiles are taken.
GRID, SPOTS = 400, 256
#: Groups whose estimates may be broadcast, of some 200 bytes each; beyond it they are joined.
BROADCAST_GROUPS = 100_000


def counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    rows = rows.select("doc_id", "lang", "source", "text", F.regexp_extract_all("text", F.lit(WORD), 0).alias("words"))
    # triples in order of their hash, so that equal ones are neighbours
    triple = F.expr("transform(slice(words, 1, greatest(size(words) - 2, 0)), (w, i) -> struct(xxhash64(w, words[i + 1], words[i + 2]) as h, i as i))")
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD))
    rows = rows.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"), F.sort_array(triple).alias("triples"),
    )
    again = F.expr("filter(triples, (t, k) -> (k > 0 and triples[k - 1].h = t.h) or (k < size(triples) - 1 and triples[k + 1].h = t.h))")
    rows = rows.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(again, lambda t: t["i"])).alias("starts"),
    )
    covered = F.expr("aggregate(transform(starts, (s, k) -> if(k = 0, 3, least(3, s - starts[k - 1]))), 0L, (a, x) -> a + x)")
    return rows.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"))


def statistics(counted: DataFrame) -> DataFrame:
    """``counted`` with base_failed and the transformed statistics."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    part = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.lit(1), F.col(b)))
    return counted.withColumns({
        "base_failed": failed,
        "word_length": F.log(F.greatest(F.lit(1), F.col("word_chars")) / F.greatest(F.lit(1), F.col("n_words"))),
        "symbols": part("n_symbols", "word_chars"),
        "dup_lines": part("n_dup_lines", "n_lines"),
        "repeats": part("n_repeat_words", "n_words"),
    })


def factored(groups: DataFrame) -> DataFrame:
    """Means m0.., the lower triangle l00.. of the covariance's root and its size (log determinant), from m0.. and c00..; floors added."""
    n = len(STATISTICS)
    for i in range(n):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            root = F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2))) if i == j else rest / F.col(f"l{j}{j}")
            groups = groups.withColumn(f"l{i}{j}", root)
    groups = groups.withColumn("size", 2 * sum((F.log(f"l{i}{i}") for i in range(1, n)), F.log("l00")))
    return groups.select("key", "start", "size", *(f"m{i}" for i in range(n)), *(f"l{i}{j}" for i in range(n) for j in range(i + 1)))


def distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    solved: list[Column] = []
    for i, name in enumerate(STATISTICS):
        rest = F.col(name) - F.col(f"m{i}")
        for j, y in enumerate(solved):
            rest = rest - F.col(f"l{i}{j}") * y
        solved.append(rest / F.col(f"l{i}{i}"))
    return sum((y * y for y in solved[1:]), solved[0] * solved[0])


def levels(rows: DataFrame) -> DataFrame:
    """(g_lang, g_source, own, feeds) of each group: the key of the estimate that judges it, and of those its rows enter."""
    sizes = materialize(rows.groupBy("lang", "source").agg(F.count("*").alias("n")), "groups")
    langs = sizes.groupBy(F.col("lang").alias("g_lang")).agg(F.sum("n").alias("n_lang"), F.min("n").alias("least"))
    held = sizes.join(langs, F.col("lang").eqNullSafe(F.col("g_lang"))).crossJoin(langs.agg(F.min("n_lang").alias("least_lang")))
    # a null name leaves its field out, so it differs from every other name
    keys = [F.to_json(F.struct(F.lit(k).alias("level"), *names)) for k, names in enumerate((("lang", "source"), ("lang",), ()))]
    own = F.when(F.col("n") >= LEAST_ROWS, keys[0]).when(F.col("n_lang") >= LEAST_ROWS, keys[1]).otherwise(keys[2])
    needed = (F.col("n") >= LEAST_ROWS, (F.col("n_lang") >= LEAST_ROWS) & (F.col("least") < LEAST_ROWS), F.col("least_lang") < LEAST_ROWS)
    feeds = F.array_compact(F.array(*(F.when(c, k) for c, k in zip(needed, keys, strict=True))))
    return materialize(held.select("g_lang", F.col("source").alias("g_source"), own.alias("own"), feeds.alias("feeds")), "groups")


def hinted(groups: DataFrame, n: int) -> DataFrame:
    return F.broadcast(groups) if n <= BROADCAST_GROUPS else groups


def with_level(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    return rows.join(groups, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), how)


def cells(rows: DataFrame) -> DataFrame:
    """(key, the statistics on their grid, n): how many rows of a key fall on each point."""
    return rows.groupBy("key", *((F.round(F.col(s) * GRID) / GRID).alias(s) for s in STATISTICS)).agg(F.count("*").alias("n"))


def moments(held: DataFrame) -> DataFrame:
    """Means m0.. and covariances c00.. of the rows in the cells of each key and start."""
    k = len(STATISTICS)
    lower = [(i, j) for i in range(k) for j in range(i + 1)]
    sums = [F.sum(F.col("n") * F.col(s)).alias(f"s{i}") for i, s in enumerate(STATISTICS)]
    products = [F.sum(F.col("n") * F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"p{i}{j}") for i, j in lower]
    added = held.groupBy("key", "start").agg(F.sum("n").alias("n"), *sums, *products)
    means = added.select("*", *((F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(k)))
    return means.select("key", "start", *(f"m{i}" for i in range(k)),
        *((F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"c{i}{j}") for i, j in lower))


def starts(held: DataFrame) -> DataFrame:
    """Medians, with squared normalised median deviations and interquartile ranges as diagonal covariances."""
    k = len(STATISTICS)
    # values lie on the grid, so a quantile's table of values is small
    middle = held.groupBy("key").agg(*(F.percentile(s, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias(f"q{i}") for i,
        s in enumerate(STATISTICS)))
    middle = materialize(middle, "groups")
    off = [F.percentile(F.abs(F.col(s) - F.col(f"q{i}")[1]), 0.5, F.col("n")).alias(f"a{i}") for i, s in enumerate(STATISTICS)]
    both = materialize(middle.join(held.join(hinted(middle, middle.count()), "key").groupBy("key").agg(*off), "key"), "groups")
    wide = ([1.4826 * F.col(f"a{i}") for i in range(k)], [(F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349 for i in range(k)])
    means = {f"m{i}": F.col(f"q{i}")[1] for i in range(k)}
    out = [both.withColumns({"start": F.lit(at)} | means | {f"c{i}{j}": F.pow(w[i],
        2) if i == j else F.lit(0.0) for i in range(k) for j in range(i + 1)}) for at, w in enumerate(wide)]
    return factored(out[0].unionByName(out[1]))


def spot() -> Column:
    """The distance on its logarithmic grid."""
    return F.round(SPOTS * F.log1p("d"))


def scaled(held: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """``groups`` with the scale that makes the median distance of the cells' rows that of a normal sample, 1 at least."""
    middle = held.join(hinted(groups, n), "key").withColumn("d", distance()).groupBy("key").agg(F.percentile(spot(), 0.5, F.col("n")).alias("q"))
    return materialize(groups.join(middle, "key").withColumn("scale", F.greatest(F.lit(1.0), F.expm1(F.col("q") / SPOTS) / MEDIAN)).drop("q"),
        "groups")


def robust(held: DataFrame) -> DataFrame:
    """The estimate of each key from its cells: location, root of the covariance, and the scale of distances."""
    now, cores = materialize(starts(held).withColumn("size", F.lit(math.inf)), "groups"), None
    while n := now.count():
        far = held.join(hinted(now, n), "key").select("key", "start", "n", F.col("size").alias("before"), *STATISTICS, distance().alias("d"))
        near = far.groupBy("key", "start").agg(F.percentile(spot(), NEAREST, F.col("n")).alias("q"))
        inside = far.join(hinted(near, n), ["key", "start"]).where(spot() <= F.col("q"))
        core = factored(moments(inside)).join(now.select("key", "start", F.col("size").alias("before")), ["key", "start"])
        core = materialize(core, "groups")
        cores = core if cores is None else cores.union(core)
        now = core.where(F.col("before") - F.col("size") > SETTLED).drop("before")
    if cores is None:
        return now.withColumn("scale", F.lit(1.0))
    least = cores.groupBy("key").agg(F.min_by(F.struct(*(c for c in cores.columns if c != "key")), F.struct("size", "start")).alias("core"))
    least = materialize(least.select("key", "core.*"), "groups")
    n = least.count()
    best = scaled(held, least, n)
    inner = held.join(hinted(best, n), "key").withColumn("d", distance() / F.col("scale")).where(F.col("d") <= INNER)
    return scaled(inner.select("key", "n", *STATISTICS), materialize(factored(moments(inner)), "groups"), n)


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, counts, base_failed, distance, kept) of every row; distance is null where the base rules fail."""
    rows = materialize(statistics(counts(docs)), "quality")
    passed = rows.where("not base_failed")
    groups = levels(passed)
    groups = hinted(groups, groups.count())
    held = materialize(cells(with_level(passed, groups).select(F.explode("feeds").alias("key"), *STATISTICS)), "cells")
    found = robust(held)
    joined = with_level(rows, groups, "left").join(hinted(found, found.count()), F.col("own") == F.col("key"), "left")
    out = joined.withColumn("distance", F.when(~F.col("base_failed"), distance() / F.col("scale")))
    kept = ~F.col("base_failed") & (F.col("distance") <= cutoff)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))

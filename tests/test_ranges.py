"""Ranking from ranges of postings: the rows of the plain ranking, and how many ranges are opened."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import indexed, lexical, ranges

SCHEMA = "term string, unit string, dl int, tf int, positions array<int>"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Texts of a few words, in two tables; one text stands many times, and one word is rare and dense in short texts."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(30)], k=rng.randint(1, 120))) for _ in range(1200)]
    texts = [f"{t} dense" if t.count(" ") > 80 else t for t in texts] + ["dense dense w9"] * 12
    texts += ["w0 w1 w0"] * 60 + ["", "needle needle", "w1 needle w2"] + [None]
    units = spark.createDataFrame([(f"u{i:05d}", t) for i, t in enumerate(texts)], "unit string, text string")
    paths = []
    for part in range(2):
        path = f"file://{tmp_path_factory.mktemp('ranges')}/p"
        mine = units.where(F.pmod(F.xxhash64("unit"), F.lit(2)) == part)
        ranges.write(indexed.postings(mine), path, range_postings=2500)
        paths.append(path)
    held = ranges.Ranged(spark, paths, SCHEMA)
    sizes = held.all().agg(F.sum("tf").alias("n")).first()
    return held, len(texts), sizes["n"] / len(texts)


def plain(made, phrases, limit, among=None, dead=None):
    held, total, mean = made
    rows = held.all() if dead is None else held.all().join(dead, "unit", "left_anti")
    got = lexical.ranked(indexed.scores(indexed.Index(None, rows, None, total, mean), phrases, among), limit, "unit")
    return [(r["unit"], round(r["score"], 6), r["rank0"]) for r in got.orderBy("rank0").collect()]


@pytest.mark.parametrize("phrases", [[["w0"], ["w0"], ["w9"]], [["w1", "w0"], ["w2"]], [["w0", "w0", "w1"]], [["nowhere", "w0"], ["w25"]], []])
def test_best_is_the_plain_ranking(made, phrases):
    held, total, mean = made
    for limit in (20, 2000):
        got = held.best(phrases, limit, total, mean).orderBy("rank0").collect()
        assert [(r["unit"], round(r["score"], 6), r["rank0"]) for r in got] == plain(made, phrases, limit)
    assert held.best(phrases, 0, total, mean).count() == 0


def test_filters_and_dead_units(spark, made):
    held, total, mean = made
    some = held.all().select("unit").distinct().where("substring(unit, 6, 1) in ('3', '4')")
    for phrases in ([["w0"], ["w5"]], [["w1", "w0"]]):
        got = held.best(phrases, 15, total, mean, lambda hits: hits.join(some, "unit", "left_semi")).orderBy("rank0").collect()
        assert [(r["unit"], round(r["score"], 6), r["rank0"]) for r in got] == plain(made, phrases, 15, among=some)
        got = held.best(phrases, 15, total, mean, dead=some).orderBy("rank0").collect()
        assert [(r["unit"], round(r["score"], 6), r["rank0"]) for r in got] == plain(made, phrases, 15, dead=some)


@pytest.mark.parametrize("changed", [0.5, 3.0])
def test_bounds_leave_ranges_unopened(made, monkeypatch, changed):
    """Also where the mean length is another than at writing."""
    held, total, mean = made
    monkeypatch.setattr(ranges, "FIRST", 2)
    read = ranges.Read()
    got = held.best([["dense"]], 5, total, mean * changed, read=read).orderBy("rank0").collect()
    assert [(r["unit"], round(r["score"], 6), r["rank0"]) for r in got] == plain((held, total, mean * changed), [["dense"]], 5)
    assert read.ranges <= 4 < read.total
    read = ranges.Read()
    assert [r["unit"] for r in held.best([["needle"]], 5, total, mean, read=read).orderBy("rank0").collect()] == ["u01273", "u01274"]
    assert read.ranges <= 2


def test_postings_are_not_shuffled(made):
    held, total, mean = made
    files = [f for f in held.all().inputFiles() if "/_" not in f]
    plan = held._hits(files, [["w0"]], ["w0"], [1.0], mean, 5, "unit string, score double")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,w0)]" in plan.replace("In(term, [w0])", "IsNotNull(term), EqualTo(term,w0)")
    # a unit is in one file
    per = held.all().select("unit", F.input_file_name().alias("f")).distinct().groupBy("unit").count().where("count > 1")
    assert per.count() == 0


def test_no_postings(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    ranges.write(spark.createDataFrame([], SCHEMA), path)
    held = ranges.Ranged(spark, [path], SCHEMA)
    assert held.best([["a"]], 5, 0, 0.0).count() == 0 and ranges.Ranged(spark, [], SCHEMA).best([["a"]], 5, 0, 0.0).count() == 0

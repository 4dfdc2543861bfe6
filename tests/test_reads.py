"""Reads by key and by cluster: what they find, and how much they open."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import clusters, indexed, keyed
from corpusloom.operators.filters import Filters
from corpusloom.plans import ingest
from corpusloom.plans.snapshot import Store


@pytest.mark.parametrize("listed", [100_000, 3])
def test_keys_name_their_files(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(keyed, "LISTED", listed)
    rows = spark.range(4000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), "id")
    paths = [f"file://{tmp_path}/{i}" for i in range(2)]
    for i, path in enumerate(paths):
        keyed.write(rows.where(F.col("id") % 2 == i), path, "k", file_rows=20)
    table = keyed.Keyed(spark, paths, "k string, id long", "k", "unit")
    assert table._lists().count() >= 200
    rng = random.Random(2)
    wanted = rng.sample(range(4000), 50)
    keys = [r.k for r in rows.where(F.col("id").isin(wanted)).collect()] + ["0" * 64, None]
    got = table.rows(keys)
    assert sorted(r.id for r in got.collect()) == sorted(wanted) and got.columns == ["unit", "id"]
    # each key is in one file of one table, and at most in the range of one of the other
    assert len(got.inputFiles()) <= 2 * 50 + 2 and len(table.files(keys[:1])) <= 2
    assert table.rows([]).count() == 0 and table.rows(["z"]).count() == 0 and table.all().count() == 4000


def test_a_search_opens_the_files_of_its_candidates(spark, tmp_path):
    """50 candidates in 200 files of texts."""
    rows = [(f"/r/{i}.txt", "repo-doc", "p", None, f"T{i}", f"text number{i} " + ("needle " if i % 40 == 7 else "") + "common", 1.0, i) for i in range(2000)]
    docs = spark.createDataFrame(rows, "path string, source_type string, project string, doc_date string, title string, text string, mtime double, size long")
    snap = ingest.run(Store(spark, f"file://{tmp_path}/store", file_rows=10), docs, docs.select("source_type").distinct())
    files = snap.texts()._lists().count()
    assert files >= 200
    hits = indexed.find(snap.index, "needle", limit=50)
    assert sorted(int(r.path[3:-4]) for r in hits.collect()) == list(range(7, 2000, 40))
    read = [f for f in hits.inputFiles() if "/texts/" in f or "/places/" in f]
    assert 0 < len(read) <= 2 * 50 < files
    assert snap.chunks_of("/r/47.txt").first().text.startswith("text number47") and len(snap.chunks_of("/r/47.txt").inputFiles()) == 1


@pytest.fixture(scope="module")
def cloud(spark, tmp_path_factory):
    """Vectors in clumps, some odd ones, and the table of their clusters."""
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(40, 12)) * 5
    x = middle[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 12)) * 0.2
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5001, []), (5002, [1.0] * 3), (5003, [float("nan")] * 12), (5004, [None] * 12)]
    rows += [(6000 + i, rows[7][1]) for i in range(3)]
    table = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    path = f"file://{tmp_path_factory.mktemp('clusters')}/v"
    clusters.write(table, path, "id", file_rows=100)
    return rows, clusters.Clustered(spark, [path], "id long, embedding array<float>", "id")


@pytest.mark.parametrize(("limit", "odd"), [(1, False), (5, False), (25, True), (4000, True)])
def test_nearest_by_clusters_is_the_scan(cloud, limit, odd):
    rows, table = cloud
    held = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and len(v) == 12 and None not in v and np.isfinite(v).all() and (not odd or i % 2)]
    for at in (7, 500):
        query = [v + 0.05 for v in rows[at][1]]
        want = sorted((round(float(np.sqrt(((v - query) ** 2).sum())), 6), i) for i, v in held)[:limit]
        read = clusters.Read()
        got = table.nearest(query, limit, (lambda r: r.where("id % 2 = 1")) if odd else None, read=read).orderBy("rank0").collect()
        got = [r for r in got if np.isfinite(r.distance)]
        assert [r.id for r in got] == [i for _, i in want]
        assert np.allclose([r.distance for r in got], [d for d, _ in want], atol=2e-6)
        assert read.total == len(rows) and (limit > 25 or read.vectors < 0.35 * read.total)


def test_clusters_of_few_or_no_vectors(spark, tmp_path):
    for n in (0, 1, 2):
        path = f"file://{tmp_path}/{n}"
        rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(n)], "id long, embedding array<float>")
        clusters.write(rows, path, "id")
        got = clusters.Clustered(spark, [path], "id long, embedding array<float>", "id").nearest([0.0, 1.0], 5).collect()
        assert [(r.id, r.distance) for r in got] == [(i, float(i)) for i in range(n)]


def test_snapshot_searches_by_clusters(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = [(f"/r/{i}.md", "repo-doc", "p" if i % 3 else "q", None, f"T{i}", "ab" * i + " words", 1.0, i) for i in range(1, 60)]
    schema = "path string, source_type string, project string, doc_date string, title string, text string, mtime double, size long"
    docs = spark.createDataFrame(rows, schema)
    ingest.run(store, docs, docs.select("source_type").distinct(), ingest.sign_embedder)
    # a second run adds a segment, and leaves dead chunks in the first
    more = spark.createDataFrame([(*r[:5], r[5] + " changed", 2.0, r[7]) if i < 20 else r for i, r in enumerate(rows)], schema)
    snap = ingest.run(store, more, more.select("source_type").distinct(), ingest.sign_embedder)
    assert snap.meta["dead"] and len(snap.meta["segments"]["vectors"]) == 2
    vector = ingest.sign_embedder(["ababab words"])[0]
    for filters in (Filters(), Filters(projects=("q",))):
        by = indexed.vector_leg(snap.index, vector, 9, filters, True, "sign-16").orderBy("rank0").collect()
        scan = indexed.Index(snap.index.rows, snap.index.postings, snap.index.texts, 1, 1.0, snap.index.vectors, snap.index.models, snap.index.kinds)
        assert [(r.unit, round(r.distance, 6)) for r in by] == [(r.unit, round(r.distance, 6)) for r in indexed.vector_leg(scan, vector, 9, filters, True,
            "sign-16").orderBy("rank0").collect()]

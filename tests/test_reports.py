"""Discovery, reports, dashboard, probes, and the drained stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.plans import ingest, report
from corpusloom.plans.snapshot import Store
from corpusloom.sources import discovery
from corpusloom.streaming import capture


def test_discovery(spark):
    rows = [("/x/2026-01-02/a/conversations-1.json", 0.0, 1), ("/x/2026-01-02/a/conversations-2.json", 0.0, 1),
        ("/x/1700000000-b/conversations.json", 0.0, 1), ("/x/c/users.json", 0.0, 1), ("/h/sessions/2026/rollout-a.jsonl", 0.0, 1),
        ("/h/archived_sessions/rollout-b.jsonl", 0.0, 1), ("/h/other/rollout-c.jsonl", 0.0, 1), ("/h/n.TXT", 0.0, 1)]
    f = spark.createDataFrame(rows, "path string, mtime double, size long")
    got = discovery.export_batches(f).collect()
    assert [(r.batch, r.batch_date, len(r.files)) for r in got] == [("/x/1700000000-b", "2023-11-14", 1), ("/x/2026-01-02/a", "2026-01-02", 2)]
    assert {(r.path, r.archived) for r in discovery.rollouts(f).collect()} == {("/h/sessions/2026/rollout-a.jsonl", False),
        ("/h/archived_sessions/rollout-b.jsonl", True)}
    assert [r.path for r in discovery.side_files(f).collect()] == ["/h/n.TXT"]


def test_report_and_dashboard(spark, tmp_path):
    docs = spark.createDataFrame([("/a.md", "repo-doc", "raw", "2026-01-01", "alpha key sk-" + "a1" * 10),
        ("/b.md", "curated", "done", None, "beta")], "path string, source_type string, project string, doc_date string, text string")
    store = Store(spark, f"file://{tmp_path}/s")
    snap = ingest.run(store, docs, docs.select("source_type"))
    row = report.health(snap).first()
    assert (row.documents, row.pending, row.verdict, row.state, row.dangling_occurrences) == (2, 2, "DEGRADED", "amber",
        0) and report.exit_code(row) == 1
    assert report.health(snap).collect() == report.health(store.current()).collect()
    assert {(r.source_type, r.redacted) for r in report.coverage(snap).collect()} == {("repo-doc", 1), ("curated", 0)}
    assert [(r.kind, r.documents) for r in report.redaction_totals(snap).collect()] == [("openai-key", 1)]
    curated = spark.createDataFrame([("done/overview.md", "done", "# Done\n**Status:** *running*\n## Open questions\n- why\n"),
        ("done/log.md", "done", "## 2026-03-01 — me — Started\ntext\n"),
        ("done/decisions.md", "done", "## D-2026-03-01-01 — Go [active]\n- Why: x\n")], "path string, project string, text string")
    n = snap.table("occurrences").groupBy("path").agg(F.count("*").alias("n_chunks"))
    board = report.dashboard(curated, snap.table("documents"), n, "2026-03-02")
    page = report.home_page(board)
    assert "**done** 2026-03-01 running" in page and "D-2026-03-01-01 done: Go [active]" in page and "done: why" in page and "raw: 1 documents" in page
    assert "raw" in report.distill_prompt(board.backlog.first())


def test_probes(spark):
    probes = spark.createDataFrame([("a", 0.9, 9.0), ("b", 0.5, 8.0), ("c", 0.0, 0.2)], "query string, coverage double, score double")
    assert [r.state for r in report.probe_states(probes).collect()] == ["compromised", "elevated", "clean"]
    good = spark.createDataFrame([(1.0,), (2.0,)], "score double")
    assert report.golden_verdict(good, probes).first().verdict == "PASS"
    assert report.golden_verdict(good.where("false"), probes).first().verdict == "SKIP"
    c = spark.createDataFrame([("prose", "[thinking] x"), ("tool_event", "[thinking] x")], "kind string, text string")
    assert report.reasoning_leaks(c).first().leaks == 1


def test_stream_is_drained_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"n": 1}\n{"n": 2}\n')
    got = []
    handle = lambda rows, batch: got.extend(r.value for r in rows.collect())
    for _ in range(2):
        capture.drain_text(spark, str(tmp_path / "in"), str(tmp_path / "check"), handle)
    assert len(got) == 2
    (tmp_path / "in/b.jsonl").write_text('{"n": 3}\n')
    capture.drain_text(spark, str(tmp_path / "in"), str(tmp_path / "check"), handle)
    assert len(got) == 3


def test_folder_hash(spark):
    f = spark.createDataFrame([("/a/x", bytearray(b"1")), ("/a/y", bytearray(b"2")), ("/b/x", bytearray(b"1"))], "path string, content binary")
    one = {r.folder: r.digest for r in ingest.folder_hash(f).collect()}
    two = {r.folder: r.digest for r in ingest.folder_hash(f.withColumn("content",
        F.when(F.col("path") == "/a/y", F.lit(b"3")).otherwise(F.col("content")))).collect()}
    assert one["/a"] != two["/a"] and one["/b"] == two["/b"]

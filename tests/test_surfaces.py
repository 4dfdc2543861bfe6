"""All sources in one run, and what is asked of the store: service, web answers, command line, repair."""

from __future__ import annotations

import json
import os
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F
from test_sources import jsonl, put

from corpusloom.plans import gather, ingest, report
from corpusloom.plans.snapshot import Store
from corpusloom.sources import files
from corpusloom.surfaces import cli, golden, web
from corpusloom.surfaces.service import Service


@pytest.fixture
def sources(tmp_path):
    d = tmp_path
    put(d / "repos/alpha/docs/a.md", "# Alpha design\nThe parser reads tokens of the zebra kind.")
    put(d / "repos/alpha/b.md", "# Notes\nNothing here. Key sk-" + "a1" * 12)
    put(d / "repos/node_modules/x.md", "never")
    put(d / "kb/alpha/overview.md", "# Alpha\n**Status:** running\n## Open questions\n- why zebra?\n")
    put(d / "kb/alpha/decisions.md", "## D-2026-04-10-B01 — Use zebra [active]\n- Why: stripes\n")
    put(d / "kb/alpha/log.md", "## 2026-05-01 — me — Began\nfirst words\n")
    jsonl(d / "sessions/s1.jsonl", [{"type": "user", "sessionId": "S1", "cwd": str(d / "repos/alpha"), "timestamp": "2026-01-02T00:00:00",
        "message": {"role": "user", "content": "where is the zebra parser"}}])
    jsonl(d / "codex/sessions/rollout-2026-05-12T19-28-22-x.jsonl",
        [{"timestamp": "2026-05-12T19:00:00", "type": "session_meta", "payload": {"id": "R1", "cwd": str(d / "repos/alpha")}},
            {"type": "event_msg", "payload": {"type": "user_message", "message": "rollout question about giraffes"}}])
    names = jsonl(d / "index.jsonl", [{"id": "R1", "thread_name": "Giraffe thread", "updated_at": "1"}])
    node = lambda i, parent, said, at: {"id": i, "parent": parent, "message": {"author": {"role": "user"}, "create_time": at,
        "content": {"content_type": "text", "parts": said}}}
    tree = {"a": node("a", None, ["tree talk about lions"], 1.0), "b": node("b", "a",
        [{"content_type": "image_asset_pointer", "asset_pointer": "file-service://file-1"}], 2.0)}
    put(d / "tree/2026-01-01/conversations.json",
        json.dumps([{"conversation_id": "C1", "title": "Lions", "create_time": 1_700_000_000, "current_node": "b", "mapping": tree}]))
    put(d / "tree/2026-01-01/conversation_asset_file_names.json", json.dumps({"file-1.dat": "lion.png"}))
    put(d / "flat/data-1/conversations.json",
        json.dumps([{"uuid": "L", "name": "flat", "created_at": "2026-02-03T00:00:00",
            "chat_messages": [{"uuid": "1", "sender": "human", "text": "flat talk about tigers", "created_at": "1"}]}]))
    put(d / "flat/data-1/memories.json", json.dumps([{"conversations_memory": "memory of tigers"}]))
    put(d / "flat/data-1/projects/p.json", json.dumps({"uuid": "P", "name": "Pride", "description": "brief of tigers"}))
    config = files.Config({"repos": str(d / "repos")}, exclude_dirs=("node_modules",))
    return gather.Sources(config, str(d / "kb"), None, str(d / "sessions"), str(d / "codex"), names, str(d / "tree"), str(d / "flat"))


def test_all_sources_in_one_run(spark, tmp_path, sources):
    store = Store(spark, f"file://{tmp_path}/store")
    snap, found = gather.update(store, sources, ingest.sign_embedder)
    assert found.errors == 0 and len(found.states) == 6
    d = {r.path.replace(str(tmp_path), ""): r for r in snap.table("documents").collect()}
    assert {r.source_type for r in d.values()} == {"repo-doc", "curated", "transcript", "user-memory", "project-brief"} and len(d) == 11
    assert d["/sessions#session=S1"].project == "alpha" and d["/codex/sessions/rollout-2026-05-12T19-28-22-x.jsonl"].title == "Giraffe thread"
    assert d["/repos/alpha/b.md"].redactions == ["openai-key"]
    assert snap.table("chunks").where("text like '%[image: lion.png]%'").count() == 1
    # trees and rollouts that are as they were are not parsed again, and stay
    os.remove(tmp_path / "repos/alpha/b.md")
    put(tmp_path / "tree/2026-01-01/conversations.json", "{")
    again, found = gather.update(store, sources, ingest.sign_embedder)
    assert {s for _, s, _ in found.states} == {"read", "partial"} and found.errors == 1
    assert found.documents.where("source_type = 'curated' or source_type = 'repo-doc'").count() == 0 and found.unchanged.count() == 5
    left = {r.path.replace(str(tmp_path), "") for r in again.table("documents").collect()}
    # the transcripts stay although one of their sources failed; the removed file is gone
    assert left == set(d) - {"/repos/alpha/b.md"}
    hits = Service(again, ingest.sign_embedder, "sign-16").search("zebra parser", limit=3)
    assert hits[0]["source_type"] == "curated" and any(h["path"].endswith("a.md") for h in hits)
    page, code = report.text_report(again, found.states)
    assert code == 1 and "IMPORTER ERRORS" in page and "openai-key" not in page and "tree export    partial" in page


def test_service_and_web(spark, tmp_path, sources):
    snap, _ = gather.update(Store(spark, f"file://{tmp_path}/store"), sources, ingest.sign_embedder)
    table = spark.createDataFrame([("old-alpha", "alpha"), ("alpha", "alpha")], "alias string, canonical string")
    service = Service(snap, ingest.sign_embedder, "sign-16", table)
    rows = service.search("zebra", project="OLD-alpha", source_type="repo-doc", limit=99)
    assert [r["title"] for r in rows][:1] == ["Alpha design"] and all(r["project"] == "alpha" and round(r["score"], 5) == r["score"] for r in rows)
    said = service.search_text("zebra")
    assert "context to be checked" in said and "[1] " in said and "found by fts" in said
    assert "can't answer" in Service(snap, ingest.sign_embedder, "other-model").search_text("zebra")
    lonely = Service(snap).search_text("nothingatall")
    assert lonely.startswith("Nothing found") and "words alone" in lonely
    d = service.read("alpha/docs/a.md")
    assert d["title"] == "Alpha design" and "zebra kind" in d["text"] and service.read("alpha/docs/a.md", 0, 99)["chunk_count"] == 1
    talk = service.read("#session=S1")
    assert talk["is_transcript"] and talk["base_path"].endswith("/sessions") and not d["is_transcript"]
    assert [r["title"] for r in service.search("zebra", kind="tool_event")] == []
    assert service.read("no such")["error"] == "not found" and service.read(".md")["error"] == "ambiguous" and "ambiguous" in service.read_text(".md")
    curated = files.read_tree(spark, sources.curated, "kb", files.Config())
    page = service.project("old-alpha", curated)
    assert page["name"] == "alpha" and page["resolved_from"] == "old-alpha" and page["indexed_documents"] == 7
    assert page["decisions"][0]["id"] == "D-2026-04-10-B01" and page["open_questions"] == ["why zebra?"] and page["log"][0]["date"] == "2026-05-01" and len(page["files"]) == 3
    assert web.answer(service, "/api/search?q=zebra&limit=1")[1]["results"][0]["confidence"] <= 1 and web.answer(service,
        "/api/search")[0] == 400 and web.answer(service, "/api/doc?path=none")[0] == 404
    assert web.answer(service, "/api/health")[1]["documents"] == 11 and web.answer(service, "/api/project/..%2Fx",
        curated)[0] == 404 and web.answer(service, "/api/project/alpha", curated)[0] == 200
    server = web.server(service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}/api/health"
        with urllib.request.urlopen(at) as r:
            assert json.load(r)["documents"] == 11 and r.headers["X-Content-Type-Options"] == "nosniff"
        for request, status in ((urllib.request.Request(at, method="POST"), 405),
            (urllib.request.Request(at, headers={"Host": "evil.example"}), 403)):
            with pytest.raises(urllib.error.HTTPError) as error:
                urllib.request.urlopen(request)
            assert error.value.code == status
    finally:
        server.shutdown()


def test_golden_suite(spark, tmp_path, sources):
    snap, _ = gather.update(Store(spark, f"file://{tmp_path}/store"), sources, ingest.sign_embedder)
    service = Service(snap)
    checks = golden.Checks((("zebra parser", "alpha"),), ("quixotic umbrella saxophone",), ("zebra",), (("zebra", "alpha"), ("zebra", "nowhere")),
        seconds=30)
    outcomes = golden.run(service, checks)
    by = {(o.section, o.detail.split(":")[0]): o.state for o in outcomes}
    assert by["answers", "'zebra parser' finds alpha"] == "PASS" and by["small project answers", "nowhere"] == "SKIP" and by["small project answers",
        "alpha"] == "PASS"
    assert not [o for o in outcomes if o.state == "FAIL" and o.section != "crosses projects"]
    text, code = golden.summary(outcomes)
    assert "skipped" in text and code == int(any(o.state == "FAIL" for o in outcomes))
    assert golden.run(service, golden.Checks((("zebra", "no such path"),)))[2].state == "FAIL"


def test_repair_and_attribution(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = [("/a.md", "repo-doc", "p", "alpha words", "/w/x", 1.0, 1), ("/b.md", "repo-doc", None, "beta words", "/r/proj/sub", 1.0, 1)]
    docs = spark.createDataFrame(rows, "path string, source_type string, project string, text string, cwd string, mtime double, size long")
    first = ingest.run(store, docs, docs.select("source_type"), ingest.sign_embedder)
    where = f"{tmp_path}/store/0/texts"
    kept = spark.createDataFrame([tuple(r) for r in spark.read.parquet(where).where("text like 'beta%'").collect()],
        "content_hash string, text string")
    kept.write.mode("overwrite").parquet(where)
    assert report.health(first).first().dangling_occurrences == 1
    mended = ingest.repaired(store)
    row = report.health(mended).first()
    assert (row.dangling_occurrences, row.orphan_vectors, row.documents) == (0, 0,
        2) and mended.table("postings").where("term = 'alpha'").count() == 0
    again = ingest.run(store, docs, docs.select("source_type"), ingest.sign_embedder)
    assert again.table("chunks").count() == 2 and again.table("ingest_runs").orderBy(F.desc("run_id")).first().written == 1
    moved = ingest.reattributed(store, ["/r"])
    assert {r.path: r.project for r in moved.table("documents").collect()} == {"/a.md": "p", "/b.md": "proj"} and moved.table("chunks").count() == 2
    store.log("detections", {"kind": "stall", "n": 1})
    store.log("detections", {"kind": "stall", "n": 2})
    assert sorted(json.loads(r.value)["n"] for r in store.logged("detections").collect()) == [1, 2]


def test_command_line(spark, tmp_path, sources, capsys):
    store = f"file://{tmp_path}/store"
    config = put(tmp_path / "config.yaml", f"source_roots: [{tmp_path}/repos]\nexclude_dirs: [node_modules]\n")
    assert cli.main([store, "search", "x"]) == 1
    assert cli.main([store, "index", "--config", config, "--curated", sources.curated]) == 0
    capsys.readouterr()
    assert cli.main([store, "search", "zebra", "--json", "--limit", "2"]) == 0
    assert len(json.loads(capsys.readouterr().out)) == 2
    assert cli.main([store, "read", "docs/a.md"]) == 0 and "zebra kind" in capsys.readouterr().out
    put(tmp_path / "kb/INDEX.md", "## Projects\n| name | x | y | z | aliases |\n|--|--|--|--|--|\n| alpha | a | b | c | old-alpha |\n")
    assert cli.main([store, "project", "old-alpha", "--curated", sources.curated]) == 0
    assert json.loads(capsys.readouterr().out)["name"] == "alpha"
    assert cli.main([store, "project", "nobody", "--curated", sources.curated]) == 1
    capsys.readouterr()
    assert cli.main([store, "dashboard", "--curated", sources.curated, "--as-of", "2026-06-01"]) == 0
    shown = json.loads(capsys.readouterr().out)
    assert [d["id"] for d in shown["decisions"]] == ["D-2026-04-10-B01"] and [p["project"] for p in shown["projects"]] == ["alpha"]
    assert cli.main([store, "report"]) == 0 and "HEALTHY" in capsys.readouterr().out
    assert cli.main([store, "repair"]) == 0

"""Sources on generated files: trees, sessions, rollouts, exports, notes; and a store over several runs."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import querytext, text
from corpusloom.operators import aliases, chunking, indexed, reading, search
from corpusloom.operators.filters import Filters
from corpusloom.plans import ingest
from corpusloom.plans.snapshot import Store
from corpusloom.sources import agents, exports, files, notes


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def jsonl(path, rows):
    return put(path, "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def test_tree(spark, tmp_path):
    root = tmp_path / "repos"
    put(root / "alpha/docs/a.md", "# A\ntext")
    put(root / "alpha/node_modules/x/b.md", "no")
    put(root / "alpha/.secret.md", "no")
    put(root / "beta/c.MARKDOWN", "c")
    put(root / "loose.md", "caf\xe9".encode("latin-1"))
    put(root / "alpha/private/p.md", "no")
    put(root / "alpha/e.txt", "no")
    cfg = files.Config(exclude_dirs=("node_*",), exclude_files=(".*",), never_index=(f"{root}/alpha/private",))
    got = {r.path[len(str(root)) + 1 :]: r for r in files.read_tree(spark, str(root), "repos", cfg).collect()}
    assert set(got) == {"alpha/docs/a.md", "beta/c.MARKDOWN", "loose.md"}
    assert got["loose.md"].project == "_loose" and got["loose.md"].encoding_fallback and got["loose.md"].text.startswith("caf")
    assert got["alpha/docs/a.md"].project == "alpha" and got["alpha/docs/a.md"].size == 8 and not got["alpha/docs/a.md"].encoding_fallback


def test_walk_prunes_and_follows_no_links(spark, tmp_path):
    root, outside = tmp_path / "repos", tmp_path / "outside"
    put(root / "a/x.md", "x")
    put(outside / "y.md", "y")
    put(root / "secrets/z.md", "z")
    os.symlink(outside, root / "a/linked")
    os.symlink(outside / "y.md", root / "a/y.md")
    # what cannot be opened lies in a folder that isn't entered, or is a link
    os.symlink(tmp_path / "nowhere.md", root / "secrets/broken.md")
    os.symlink(tmp_path / "nowhere.md", root / "a/broken.md")
    put(root / "b[1]/odd {name}*.md", "odd")
    cfg = files.Config(exclude_dirs=("secrets",))
    got = {r.path[len(str(root)) + 1 :]: r.text for r in files.read_tree(spark, f"file://{root}", "repos", cfg).collect()}
    assert got == {"a/x.md": "x", "b[1]/odd {name}*.md": "odd"}
    assert files.read_tree(spark, str(tmp_path / "none"), "r", cfg).count() == 0
    seen = []
    files.read_tree(spark, str(root), "repos", cfg, skip=lambda found: seen.extend(found) or {f.path for f in found if f.path.endswith("x.md")})
    assert len(seen) == 2


def test_scrub(spark):
    """The rule itself: what begins at a dangerous element goes to its closing tag, or to the end."""
    cases = {
        "<p>x</p><script>alert(1)": "<p>x</p>", "a< script >b</ script >c": "ac", "a<applet code=x>b</applet>c": "ac",
        "a<STYLE>b</style>c<b>d</b>": "ac<b>d</b>", "a<meta charset=x>b": "a", "x</form>y": "xy",
        '<a onclick="f()" href="/ok">z</a>': '<a href="/ok">z</a>', "<a href='javascript:f()'>z</a>": '<a href="#">z</a>',
        "<img src=data:x>": '<img src="#">', "<p>scripted</p>": "<p>scripted</p>",
        '<a href="javascript:it(\'s\')">z</a>': '<a href="#">z</a>', "<img/onerror=f() src=x>": "<img src=x>",
        '<a href="java&#10;script:f()">z</a>': '<a href="#">z</a>', "<a href=' &#x6a;avascript:f()' >z</a>": '<a href="#" >z</a>',
        '<p title="a > b" onclick>x</p>': '<p title="a > b">x</p>', "1 < 2 <!-- <script>x</script> --> <": "1 < 2 <!--  --> <",
        "<a online='1' on='2' href='https://data:x'>z": "<a on='2' href='https://data:x'>z", "<script-x>a</script>b<br": "b<br", "<p": "<p", "": "",
    }
    df = spark.createDataFrame(list(cases.items()), "html string, want string").select("want", text.scrubbed(F.col("html")).alias("got"))
    assert [(r.got) for r in df.collect()] == [r.want for r in df.collect()]


@pytest.mark.parametrize("series", ["B01", "TM05", "AD01", "M01", "01"])
def test_decision_series(spark, series):
    n = spark.createDataFrame([("p/decisions.md", "p",
        f"## D-2026-04-10-{series} — A title; of one [active]\n- Why: x\n## D-2026-04-11-{series} — Second\n- Status: superseded by D-2026-04-10-{series} — replaced\n")], "path string, project string, text string")
    got = {r.id: r for r in notes.decisions(n).collect()}
    assert got[f"D-2026-04-10-{series}"].title == "A title; of one" and got[f"D-2026-04-10-{series}"].supersedes == [f"D-2026-04-11-{series}"]
    assert got[f"D-2026-04-11-{series}"].superseded_by == [f"D-2026-04-10-{series}"]


def test_admission(spark):
    cfg = files.Config(roots={"r": "/r"}, exclude_dirs=("node_modules",), exclude_files=(".env*",), never_index=("/r/never",))
    paths = ["/r/a/b.md", "/r//a/./b.txt", "/r/a/../../etc/x.md", "/x/a.md", "/r/node_modules/a.md", "/r/.env.md", "/r/never/a.md", "/r/private/a.md",
        "/r/a.py", "/r"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, path string")
    assert [r.i for r in df.where(files.admit(F.col("path"), cfg, ("/r/private",))).orderBy("i").collect()] == [0, 1]


def test_config():
    cfg = files.load_config("source_roots:\n  - {path: /a/projects}\n  - {path: /b/x}\n  - /c/x\nexclude_dirs: [node_modules]\nhistorical_aliases: {old: new}\n")
    assert cfg.roots == {"a-projects": "/a/projects", "x": "/b/x", "c-x": "/c/x"} and cfg.aliases == {"old": "new"}


def test_sessions(spark, tmp_path):
    d = tmp_path / "s"
    jsonl(d / "one.jsonl", [
        {"type": "user", "sessionId": "S1", "cwd": "/w/a", "timestamp": "2026-01-02T00:00:00", "message": {"role": "user", "content": "hello there"}},
        {"type": "assistant", "sessionId": "S1", "gitBranch": "main", "timestamp": "2026-01-01T00:00:00",
            "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "hi"},
                {"type": "tool_use", "name": "Bash", "input": {"command": "ls\n-l", "other": 1}},
                {"type": "tool_result", "content": "SECRET OUTPUT"}]}},
        {"type": "user", "sessionId": "S1", "toolUseResult": {"stdout": "x"}, "message": {"role": "user", "content": "TOOL OUTPUT"}},
        {"type": "user", "sessionId": "S1", "isMeta": True, "message": {"role": "user", "content": "META"}},
        "not json", "[1, 2]", {"type": "summary", "customTitle": "My title"},
    ])
    jsonl(d / "two.jsonl", [{"type": "user", "sessionId": "S1", "isSidechain": True, "message": {"role": "user", "content": "later"}}])
    jsonl(d / "alone.jsonl", [{"type": "user", "message": {"role": "user", "content": "no id"}}])
    got = {r.session: r for r in agents.session_documents(files.lines(spark, str(d))).collect()}
    assert set(got) == {"S1", "alone"}
    s = got["S1"]
    assert s.prose == "user: hello there\n\nassistant: hm\n\nassistant: hi\n\nuser: later"
    assert s.events == "[tool] Bash command=ls -l"
    assert (s.cwd, s.git_branch, s.title, s.doc_date, s.sidechain, s.skipped_meta, len(s.files)) == ("/w/a", "main", "My title", "2026-01-01", True,
        1, 2)
    assert s.path.endswith("/s#session=S1")


def test_rollouts(spark, tmp_path):
    f = jsonl(tmp_path / "r/rollout-2026-05-12T19-28-22-x.jsonl", [
        {"timestamp": "2026-05-12T19:00:00", "type": "session_meta", "payload": {"id": "R1", "cwd": "/w", "base_instructions": "LONG"}},
        {"timestamp": "2026-05-12T19:00:01", "type": "turn_context", "payload": {"model": "m1"}},
        {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "answer"}]}},
        {"type": "event_msg", "payload": {"type": "user_message", "message": "question"}},
        {"type": "response_item", "payload": {"type": "function_call_output", "output": "HUGE"}},
        {"type": "response_item", "payload": {"type": "reasoning", "summary": [{"text": "because"}]}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": "{\"a\":1}"}},
        {"type": "event_msg", "payload": {"type": "exec_command_end", "command": ["ls", "-l"], "exit_code": 2}},
        {"type": "response_item", "payload": {"type": "web_search_call", "action": {"query": "spark"}}},
    ])
    r = agents.rollout_documents(files.lines(spark, f)).collect()[0]
    assert r.prose == "assistant: answer\n\nuser: question\n\nreasoning: because"
    assert r.events == '[tool] shell {"a":1}\n[exec] ls -l (exit 2)\n[web_search] spark'
    assert (r.session, r.cwd, r.model, r.doc_date) == ("R1", "/w", "m1", "2026-05-12")
    index = jsonl(tmp_path / "session_index.jsonl", [{"id": "R1", "thread_name": "old", "updated_at": "1"},
        {"id": "R1", "thread_name": "new", "updated_at": "2"}])
    assert agents.with_titles(agents.rollout_documents(files.lines(spark, f)), files.lines(spark, index)).first().title == "new"


def node(i, parent, text_, at, **more):
    return {"id": i, "parent": parent, "message": {"author": {"role": "user"}, "create_time": at,
        "content": {"content_type": "text", "parts": [text_]} | more}}


def test_tree_export(spark, tmp_path):
    d = tmp_path / "x"
    tree = {"a": node("a", None, "root", 1.0), "b": node("b", "a", "left", 2.0), "c": node("c", "a", "right", 3.0),
        "d": node("d", "c", "", 4.0, parts=[{"content_type": "image_asset_pointer", "asset_pointer": "file-service://file-1"}])}
    odd = {"q": node("q", None, "", 1.0, content_type="strange", parts=[]),
        "t": node("t", "q", "", 2.0, content_type="thoughts", thoughts=[{"summary": "S", "content": "body"}])}
    put(d / "conversations-1.json",
        json.dumps([{"conversation_id": "C1", "title": "T", "create_time": 1_700_000_000, "update_time": 5.0, "current_node": "d", "mapping": tree},
            {"conversation_id": "C2", "current_node": "t", "mapping": odd}]))
    put(d / "deep/conversations-2.json",
        json.dumps({"conversations": [{"conversation_id": "C1", "update_time": 1.0, "current_node": "a",
            "mapping": {"a": node("a", None, "old", 1.0)}}]}))
    put(d / "bad.json", "{")
    put(d / "assets.json", json.dumps({"file-1.dat": "cat.png", "file-2": None}))
    good, bad = exports.json_items(spark, [f"{d}/conversations-1.json", f"{d}/deep/conversations-2.json", f"{d}/bad.json"])
    assert [(r.path.endswith("bad.json"), r.at) for r in bad.collect()] == [(True, -1)]
    names = exports.asset_names(exports.json_items(spark, f"{d}/assets.json", None)[0])
    conv, nodes = exports.tree_messages(good, names)
    got = {r.path: r for r in exports.documents(conv, nodes, "root").collect()}
    assert got["root#conversation=C1"].prose == "user: root\n\nuser: right\n\nuser: [image: cat.png]"
    assert got["root#conversation=C1"].doc_date == "2023-11-14"
    assert got["root#conversation=C1&branch=abandoned"].prose == "user: left"
    assert got["root#conversation=C2"].events == "[unhandled content_type: strange]\n[thinking] S\nbody"


def test_flat_export(spark, tmp_path):
    m = lambda u, p, t, at: {"uuid": u, "parent_message_uuid": p, "sender": "human", "text": t, "created_at": at}
    data = [
        {"uuid": "L", "name": "linear", "created_at": "2026-02-03T00:00:00", "chat_messages": [m("1", None, "one", "1"), m("2", None, "two", "2")]},
        {"uuid": "B", "name": "branched", "chat_messages": [m("1", "gone", "one", "1"), m("2", "1", "off", "2"), m("3", "1", "on", "3"),
            {"uuid": "4", "parent_message_uuid": "3", "sender": "assistant", "created_at": "4",
                "content": [{"type": "text", "text": "blocks"}, {"type": "tool_result", "text": "NO"},
                    {"type": "tool_use", "name": "web", "input": {"query": "q"}}]}]},
    ]
    good, _ = exports.json_items(spark, put(tmp_path / "conversations.json", json.dumps(data)))
    got = {r.path: r for r in exports.documents(*exports.flat_messages(good), "r").collect()}
    assert got["r#conversation=L"].prose == "human: one\n\nhuman: two" and got["r#conversation=L"].doc_date == "2026-02-03"
    assert got["r#conversation=B"].prose == "human: one\n\nhuman: on\n\nassistant: blocks" and got["r#conversation=B"].events == "[tool] web query=q"
    assert got["r#conversation=B&branch=abandoned"].prose == "human: off"
    memories, _ = exports.json_items(spark, put(tmp_path / "memories.json",
        json.dumps([{"conversations_memory": "blob", "memory_files": [{"path": "a.md", "content": "A", "updated_at": "2026-01-01T0"}]}])), "memories")
    assert {r.path for r in exports.memory_documents(memories, "b1", "r").collect()} == {"r#batch=b1/memories/conversations_memory",
        "r#batch=b1/memories/a.md"}
    projects, _ = exports.json_items(spark, put(tmp_path / "p.json",
        json.dumps({"uuid": "P", "name": "N", "description": "D", "docs": [{"filename": "f", "content": "C"}, {"filename": "e", "content": " "}]})), None)
    assert {r.path: r.prose for r in exports.project_documents(projects, "b1", "r").collect()} == {"r#batch=b1/project=P": "# N\n\nD",
        "r#batch=b1/project=P/doc=f": "C"}
    listing = spark.createDataFrame([("/e/users.json",), ("/e/conversations.json",), ("/e/projects/u.json",), ("/e/chat.html",), ("/e/odd.json",)],
        "path string")
    assert [r.state for r in exports.survey(listing).collect()] == ["personal", "parsed", "parsed", "skipped", "unknown"]


def test_notes(spark):
    body = "## D-2026-01-02-01 — Use Spark [active]\n- **Why:** fast\n## D-2026-01-03-B02 — Old way\n- **Status:** superseded by D-2026-01-02-01\n- **Date:** 2025-12-31\n"
    n = spark.createDataFrame([("p/decisions.md", "p", body)], "path string, project string, text string")
    got = {r.id: r for r in notes.decisions(n).collect()}
    assert (got["D-2026-01-02-01"].status, got["D-2026-01-02-01"].supersedes, got["D-2026-01-02-01"].why, got["D-2026-01-02-01"].title) == ("active",
        ["D-2026-01-03-B02"], "fast", "Use Spark")
    assert (got["D-2026-01-03-B02"].status, got["D-2026-01-03-B02"].superseded_by, got["D-2026-01-03-B02"].date) == ("superseded",
        ["D-2026-01-02-01"], "2025-12-31")
    log = n.withColumn("text", F.lit("## 2026-01-05 — bot — Did things\n- first D-2026-01-02-01\nmore D-2026-01-02-01\n"))
    e = notes.log_entries(log).first()
    assert (e.date, e.agent, e.heading, e.decisions, e.first_line) == ("2026-01-05", "bot", "Did things", ["D-2026-01-02-01"],
        "first D-2026-01-02-01")
    q = n.withColumn("text", F.lit("## Open questions\n- why?\n  because\n- done (resolved 2026)\n## Other\n- no\n"))
    assert [r.question for r in notes.open_questions(q).collect()] == ["why? because"]
    index = n.withColumn("text", F.lit("## Families\n| f | m | n |\n|---|---|---|\n| F | `alpha`, `beta` | was `old-alpha` |\n## Projects\n| name | x | y | z | aliases |\n|--|--|--|--|--|\n| beta | a | b | c | bb, `cc` |\n"))
    table = notes.alias_table(index, {"legacy": "alpha"})
    assert {(r.alias, r.canonical) for r in table.collect()} >= {("old-alpha", "alpha"), ("bb", "beta"), ("cc", "beta"), ("beta", "beta"),
        ("legacy", "alpha")}
    r = aliases.resolve(table, spark.createDataFrame([("BB",), ("none",)], "name string")).collect()
    assert {x.name: x.canonical for x in r} == {"BB": "beta", "none": "none"}


def test_drops_and_names(spark):
    drops = spark.createDataFrame([("/d/x", True, ["conversations.json", "users.json"], None), ("/d/rollout-1.jsonl", False, None, ""),
        ("/d/s.jsonl", False, None, '{"sessionId": 1}'), ("/d/q.bin", False, None, None)],
        "path string, is_dir boolean, names array<string>, head string")
    assert [r.kind for r in notes.classify_drops(drops).collect()] == ["account-export", "rollouts", "session", "unknown"]
    rows = spark.createDataFrame([("f", 1, "the Secret-Project here"), ("f", 2, "secretprojects"), ("f", 3, "secret project")],
        "path string, n int, line string")
    assert [r.n for r in notes.name_scan(rows, spark.createDataFrame([("secret_project",)], "name string")).orderBy("n").collect()] == [1, 3]


def test_chunkers():
    long = "para one\n\n" + "x" * 5000 + "\n\n" + "tail " * 100
    for pieces in (chunking.plain_pieces(long), chunking.markdown_pieces("# Top\n" + long + "\n## Sub\nsmall")):
        assert pieces and all(p.strip() == p or p for p in pieces)
    assert chunking.plain_pieces(" \n ") == [] and chunking.markdown_pieces("") == []
    plain = chunking.plain_pieces("a" * 1700 + "\n" + "b" * 3000)
    assert plain[0] == "a" * 1700 and plain[1].startswith("a" * 480 + "\n")
    md = chunking.markdown_pieces("# A\n" + "a " * 1000 + "\n## B\n" + "b " * 1000)
    assert md[0].startswith("# A") and "[A > B]" in md[1] or md[1].startswith("[A") or "## B" in md[1]


def test_query_text():
    assert querytext.phrases('what\'s "exact words" slot_id C++') == [["exact", "words"], ["what", "s"], ["slot", "id"], ["c"]]
    assert querytext.is_exact('say "x y"') and querytext.is_exact("see a/b.py") and not querytext.is_exact("plain words.")
    assert querytext.phrases("") == [] and querytext.clamp(None) == 20 and querytext.clamp(99) == 50 and querytext.clamp(0) == 1
    assert querytext.is_hosted_model("big:120b-cloud") and not querytext.is_hosted_model("small:7b")


def test_folding(spark):
    said = "Café CAFE\u0301 Ångström straße naïve İstanbul Ελλάς e\u0301\u0302x"
    got = spark.createDataFrame([(said,)], "t string").select(text.tokens(F.col("t")).alias("a"),
        text.tokens(F.col("t"), folded=False).alias("b")).first()
    assert got.a == ["cafe", "cafe", "angstrom", "straße", "naive", "istanbul", "ελλάς", "ex"] and got.b[0] == "café"
    assert querytext.phrases('"Café Ångström" naïve') == [["cafe", "angstrom"], ["naive"]]


def test_high_entropy(spark):
    keep, drop = "a1" * 40, "aB3" * 25
    r = spark.createDataFrame([(f"{keep} and {drop}== end",)], "text string").select(text.redacted(F.col("text")).alias("r"),
        text.redact_text(F.col("text")).alias("t")).first()
    assert r.r.text == f"{keep} and [REDACTED:high-entropy] end" == r.t and r.r.kinds == ["high-entropy"]


def docs(spark, rows):
    return spark.createDataFrame(rows,
        "path string, source_type string, project string, doc_date string, title string, text string, mtime double, size long")


def test_store_over_runs(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    scanned = spark.createDataFrame([("repo-doc",)], "source_type string")
    one = [("/r/p/a.md", "repo-doc", "p", "2026-01-01", "A", "alpha words shared", 1.0, 1),
        ("/r/p/b.md", "repo-doc", "p", None, "B", "alpha words shared", 1.0, 1),
        ("/s#session=1", "transcript", "q", "2026-02-02", "S", "beta words password", 1.0, 1)]
    first = ingest.run(store, docs(spark, one), scanned, ingest.sign_embedder)
    assert first.table("chunks").count() == 2 and first.table("occurrences").count() == 3 and first.table("vectors").count() == 2
    # a changes, b stays and now owns the shared chunk, the transcript's source wasn't scanned
    two = [("/r/p/a.md", "repo-doc", "p", "2026-01-01", "A", "gamma words only", 2.0, 2), one[1]]
    second = ingest.run(store, docs(spark, two), scanned, ingest.sign_embedder)
    assert {r.path for r in second.table("documents").collect()} == {"/r/p/a.md", "/r/p/b.md", "/s#session=1"}
    assert {r.path for r in second.table("chunks").where("text like 'alpha%'").collect()} == {"/r/p/b.md"}
    assert second.table("vectors").count() == 3 and second.number == 1
    # of the second run only new chunks were written
    assert second.meta["segments"]["postings"] == ["0/postings", "1/postings"]
    assert second.store.spark.read.parquet(f"file://{tmp_path}/store/1/texts").select("text").collect() == [("gamma words only",)]
    # b is gone: its chunk, postings and vector go too
    third = ingest.run(store, docs(spark, two[:1]), scanned, None)
    assert third.table("chunks").where("text like 'alpha%'").count() == 0 and third.table("postings").where("term = 'alpha'").count() == 0
    assert third.table("vectors").count() == 2 and store.current().number == 2
    runs = third.table("ingest_runs").orderBy("run_id").collect()
    assert [(r.run_id, r.seen, r.written) for r in runs] == [(1, 3, 3), (2, 2, 1), (3, 1, 0)]
    rows = third.table("places").join(third.segments("texts"), "content_hash")
    found = search.search(rows, None, "gamma", filters=Filters(projects=("P",))).collect()
    assert [r.path for r in found] == ["/r/p/a.md"] and found[0].matched_by == ["fts"] and found[0].confidence == 1.0
    got = reading.read_documents(third.table("occurrences"), third.table("chunks")).where("path = '/s#session=1'").first().text
    assert got == "beta words password"
    near = indexed.find(third.index, "gamma", ingest.sign_embedder(["gamma words only"])[0], name="sign-16").collect()
    assert near[0].path == "/r/p/a.md" and near[0].matched_by == ["fts", "vector"] and "/s#session=1" in {r.path for r in near}
    with pytest.raises(ValueError, match="sign-16"):
        indexed.find(third.index, "gamma", [0.0] * 16, name="other")
    # a dead chunk that comes back is not written again
    fourth = ingest.run(store, docs(spark, two), scanned, ingest.sign_embedder)
    assert fourth.meta["segments"] == third.meta["segments"] and fourth.meta["dead"] == 0 and fourth.table("chunks").count() == 3
    assert [r.path for r in indexed.find(fourth.index, "alpha").collect()] == ["/r/p/b.md"] and fourth.meta["total"] == 3
    merged = fourth.merged()
    assert all(len(v) == 1 for v in merged.meta["segments"].values()) and merged.table("chunks").count() == 3
    assert [r.path for r in indexed.find(merged.index, "alpha").collect()] == ["/r/p/b.md"]
    # the first run's texts are still read by the fourth, which is kept
    gone = store.expire(keep=2)
    assert "0/documents" in gone and "0/texts" not in gone and fourth.table("chunks").count() == 3
    assert set(store.expire(keep=1)) >= {"0", "1"} and merged.table("chunks").count() == 3
    empty = store.reset()
    assert empty.table("chunks").count() == 0 and empty.table("documents").count() == 0 and indexed.find(empty.index, "alpha").count() == 0
    again = ingest.run(store, docs(spark, two), scanned, None)
    assert again.table("documents").count() == 2


def test_filters_before_limit(spark):
    """A weak hit that a filter wants is found although stronger ones outside it fill the limit."""
    rows = [(i, f"/d/{i}", "other", "repo-doc", "prose", "2026-01-01", "t", 0, "canonical", "token " * 5) for i in range(8)]
    rows += [(100, "/d/t", "mine", "repo-doc", "prose", None, "t", 0, "canonical", "token with many other words around it")]
    c = spark.createDataFrame(rows,
        "chunk_id long, path string, project string, source_type string, kind string, doc_date string, title string, ord int, branch string, text string")
    assert [r.chunk_id for r in search.search(c, None, "token", filters=Filters(projects=("MINE",)),
        policy=search.Policy(3, 3, True)).collect()] == [100]
    assert 100 not in [r.chunk_id for r in search.search(c, None, "token", filters=Filters(after="2025-01-01")).collect()]

"""``python -m corpusloom.surfaces.cli``: index, search, read, project, dashboard, report, repair and serve over a store.

Where curated notes are named, the tables of their index note say which names are one project's.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime

from corpusloom.plans import gather, ingest, report
from corpusloom.plans.snapshot import Store
from corpusloom.session import session
from corpusloom.sources import files, notes
from corpusloom.surfaces.service import Service


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corpusloom")
    out.add_argument("store", help="folder of the store, as a path or URI")
    todo = out.add_subparsers(dest="command", required=True)
    index = todo.add_parser("index", help="bring the store up to date with its sources")
    index.add_argument("--config", help="YAML configuration of trees")
    for name in ("curated", "memory", "sessions", "rollouts", "thread-names", "tree-exports", "flat-exports"):
        index.add_argument(f"--{name}")
    index.add_argument("--full", action="store_true", help="parse everything again")
    index.add_argument("--no-embed", action="store_true", help="leave chunks without vectors")
    search = todo.add_parser("search")
    search.add_argument("query")
    for name in ("project", "source-type", "kind", "after", "before"):
        search.add_argument(f"--{name}")
    search.add_argument("--limit", type=int)
    search.add_argument("--exact", action="store_true")
    search.add_argument("--json", action="store_true")
    read = todo.add_parser("read")
    read.add_argument("path")
    read.add_argument("--ord", type=int)
    read.add_argument("--context", type=int, default=2)
    todo.add_parser("report", help="coverage and health; the exit code is 1 if something is wrong")
    todo.add_parser("repair", help="drop what nothing holds, have damaged documents parsed again")
    project = todo.add_parser("project", help="a project's page from curated notes, as JSON")
    project.add_argument("name")
    dashboard = todo.add_parser("dashboard", help="projects, log, decisions, questions and backlog, as JSON")
    dashboard.add_argument("--as-of", help="the day that ages count to; today if none is given")
    serve = todo.add_parser("serve", help="answer GET requests on this machine")
    serve.add_argument("--port", type=int, default=8765)
    for command in (search, project, dashboard, serve):
        command.add_argument("--curated", required=command in (project, dashboard), help="folder of curated notes")
    return out


def main(argv: list[str] | None = None, embed: ingest.Embedder | None = ingest.sign_embedder, model_name: str = "sign-16") -> int:
    asked = parser().parse_args(argv)
    store = Store(session(), asked.store)
    if asked.command == "index":
        config = files.Config()
        if asked.config:
            with open(asked.config, encoding="utf-8") as f:
                config = files.load_config(f.read())
        sources = gather.Sources(config, asked.curated, asked.memory, asked.sessions, asked.rollouts, asked.thread_names, asked.tree_exports,
            asked.flat_exports)
        _, found = gather.update(store, sources, None if asked.no_embed else embed, model_name, asked.full)
        for name, state, what in found.states:
            print(f"{name}: {state} {what}")
        return int(found.errors > 0)
    snapshot = store.current()
    if snapshot is None:
        print("no index", file=sys.stderr)
        return 1
    known = embed if model_name in snapshot.meta["models"] else None
    notes_of = getattr(asked, "curated", None)
    curated = files.read_tree(store.spark, notes_of, "curated", files.Config()) if notes_of else None
    names = None if curated is None else notes.alias_table(curated.where("lower(substring_index(path, '/', -1)) = 'index.md'"))
    service = Service(snapshot, known, model_name, names)
    if asked.command == "search":
        options = {"project": asked.project, "source_type": asked.source_type, "kind": asked.kind, "after": asked.after, "before": asked.before,
            "exact": asked.exact}
        print(json.dumps(service.search(asked.query, limit=asked.limit, **options), ensure_ascii=False,
            indent=1) if asked.json else service.search_text(asked.query, asked.limit, **options))
        return 0
    if asked.command == "read":
        print(service.read_text(asked.path, asked.ord, asked.context))
        return 0
    if asked.command == "repair":
        ingest.repaired(store)
        return 0
    if asked.command in ("project", "dashboard"):
        day = datetime.now(UTC).date().isoformat()
        found = service.project(asked.name, curated) if asked.command == "project" else service.dashboard(curated, asked.as_of or day)
        print(json.dumps(found, ensure_ascii=False, indent=1, default=str))
        return int("error" in found)
    if asked.command == "serve":
        from corpusloom.surfaces.web import serve

        serve(service, asked.port, curated)
        return 0
    page, code = report.text_report(snapshot)
    print(page)
    return code


if __name__ == "__main__":
    sys.exit(main())

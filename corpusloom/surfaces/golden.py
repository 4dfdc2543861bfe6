"""Golden checks of a live corpus: questions it must answer, questions it must not, scopes, latency, and what exports left.

A check that the corpus cannot exercise is skipped, which is no pass.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import functions as F

from corpusloom import model
from corpusloom.functions import querytext
from corpusloom.operators import analytics
from corpusloom.plans import report
from corpusloom.surfaces.service import Service

PASS, FAIL, SKIP = "PASS", "FAIL", "SKIP"
# Results looked at, origins that a broad question must reach, seconds a search may take, and the
# share of abandoned branches that a tool's transcripts may have.
TOP, ORIGINS, SECONDS, MOST_ABANDONED = 10, 2, 0.5, 0.5


@dataclass(frozen=True)
class Checks:
    """What the corpus is asked: (query, part of an expected path), absent topics, broad queries, (query, project)."""

    present: tuple[tuple[str, str], ...] = ()
    absent: tuple[str, ...] = ()
    broad: tuple[str, ...] = ()
    scoped: tuple[tuple[str, str], ...] = ()
    seconds: float = SECONDS


@dataclass(frozen=True)
class Outcome:
    section: str
    state: str
    detail: str


def said(section: str, good: bool | None, detail: str) -> Outcome:
    return Outcome(section, SKIP if good is None else PASS if good else FAIL, detail)


def origin(row: dict) -> str:
    """A project, or the archive a result without one lies in."""
    return f"project:{row['project'].lower()}" if row["project"] else f"archive:{row['path'].split('#')[0]}"


def covered(query: str, row: dict) -> float:
    """Share of the query's terms in the excerpt."""
    terms = querytext.terms(query)
    return sum(t in row["excerpt"].lower() for t in terms) / len(terms) if terms else 0.0


def median(values: list[float]) -> float:
    held = sorted(values)
    return (held[(len(held) - 1) // 2] + held[len(held) // 2]) / 2 if held else 0.0


def run(service: Service, checks: Checks) -> list[Outcome]:
    return [o for part in (configured, answered, crossed, absent_topics, scopes, branches, leaks) for o in part(service, checks)]


def configured(service: Service, checks: Checks) -> Iterator[Outcome]:
    meta = service.snapshot.meta
    yield said("configuration", meta["schema_version"] == str(model.SCHEMA_VERSION) and meta["pipeline_version"] == str(model.PIPELINE_VERSION),
        f"schema {meta['schema_version']}, pipeline {meta['pipeline_version']}")
    yield said("one model", len(meta["models"]) == 1 if meta["models"] else None, ", ".join(meta["models"]))


def answered(service: Service, checks: Checks) -> Iterator[Outcome]:
    if not checks.present:
        yield said("answers", None, "no questions")
    for query, path in checks.present:
        rows = service.search(query, limit=TOP)
        yield said("answers", any(path in r["path"] for r in rows), f"{query!r} finds {path}")
        exact = service.search(query, limit=TOP, exact=True)
        late = ["fts" not in r["matched_by"] for r in exact]
        yield said("exact first", late == sorted(late) if exact else None, f"{query!r} lists literal hits first")


def crossed(service: Service, checks: Checks) -> Iterator[Outcome]:
    for query in checks.broad:
        found = {origin(r) for r in service.search(query, limit=TOP)}
        yield said("crosses projects", len(found) >= ORIGINS, f"{query!r} reaches {len(found)} origins")


def absent_topics(service: Service, checks: Checks) -> Iterator[Outcome]:
    """Absent topics against present ones, by score and by the banner's median; probes that the corpus covers don't count."""
    rows = {q: service.search(q, limit=TOP) for q in (*checks.absent, *(q for q, _ in checks.present))}
    spark = service.snapshot.store.spark
    top = lambda q: (q, covered(q, rows[q][0]) if rows[q] else 0.0, rows[q][0]["score"] if rows[q] else 0.0)
    present = spark.createDataFrame([(top(q)[2],) for q, _ in checks.present if rows[q]], "score double")
    probes = spark.createDataFrame([top(q) for q in checks.absent], "query string, coverage double, score double")
    verdict = report.golden_verdict(present, probes).first()
    yield Outcome("absent topics", verdict["verdict"], f"best absent {verdict['absent']}, median present {verdict['present']}")
    clean = [r["query"] for r in report.probe_states(probes).where("state = 'clean'").collect()]
    worst = max((median([r["confidence"] for r in rows[q]]) for q in clean), default=None)
    yield said("banner", None if worst is None else worst < model.ABSENT_MEDIAN, f"absent medians up to {worst}")


def scopes(service: Service, checks: Checks) -> Iterator[Outcome]:
    for query, project in checks.scoped:
        names = {n.lower() for n in service.names(project)[1]}
        held = analytics.documents_of(service.snapshot.table("documents"), sorted(names)).first()["documents"]
        service.search(query, project=project, limit=TOP)  # the first search of a plan pays for its compilation
        began = time.perf_counter()
        rows = service.search(query, project=project, limit=TOP)
        took = time.perf_counter() - began
        yield said("scope holds", all((r["project"] or "").lower() in names for r in rows), f"{query!r} in {project}")
        yield said("small project answers", len(rows) > 0 if held else None, f"{project}: {len(rows)} results of {held} documents")
        yield said("latency", took <= checks.seconds, f"{took:.3f} s in {project}")


def branches(service: Service, checks: Checks) -> Iterator[Outcome]:
    d = service.snapshot.table("documents").where((F.col("source_type") == model.TRANSCRIPT) & F.col("branch").isNotNull())
    share = d.agg(F.count("*").alias("n"), F.avg((F.col("branch") == model.ABANDONED).cast("int")).alias("share")).first()
    yield said("abandoned branches", share["share"] <= MOST_ABANDONED if share["n"] else None, f"share {share['share']} of {share['n']}")
    title = d.where("title <> ''").orderBy("path").select("title", "path").first()
    if title:
        rows = service.search(title["title"], source_type=model.TRANSCRIPT, limit=model.WEB_MOST)
        yield said("found by title", None if not rows else True, f"{title['title']!r}: {len(rows)} results")


def leaks(service: Service, checks: Checks) -> Iterator[Outcome]:
    n = report.reasoning_leaks(service.snapshot.table("chunks")).first()["leaks"]
    yield said("no reasoning in prose", n == 0, f"{n} chunks")


def summary(outcomes: list[Outcome]) -> tuple[str, int]:
    """(text, exit code)."""
    count = {s: sum(o.state == s for o in outcomes) for s in (PASS, FAIL, SKIP)}
    lines = [f"{o.state} {o.section}: {o.detail}" for o in outcomes]
    return "\n".join([*lines, f"{count[PASS]} passed, {count[FAIL]} failed, {count[SKIP]} skipped"]), int(count[FAIL] > 0)

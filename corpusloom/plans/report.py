"""Reports over a snapshot: coverage with a verdict, the dashboard, its page, and quality probes of search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import model
from corpusloom.operators import analytics, maintenance
from corpusloom.plans.snapshot import Snapshot
from corpusloom.sources import notes

def health(snapshot: Snapshot) -> DataFrame:
    """One row: totals, damage and verdict; written beside the snapshot, which never changes, and read from there."""
    path = snapshot.path("health")
    if not snapshot.store.holds(path):
        c, v, o = snapshot.table("chunks"), snapshot.table("vectors"), snapshot.table("occurrences")
        totals = analytics.counts(snapshot.table("documents"), c, v)
        damage = maintenance.integrity(o, c, v)
        said = analytics.verdict(totals, snapshot.table("ingest_runs"))
        totals.join(F.broadcast(damage)).join(F.broadcast(said)).coalesce(1).write.mode("overwrite").parquet(path)  # one row each
    return snapshot.store.spark.read.parquet(path)


def coverage(snapshot: Snapshot) -> DataFrame:
    """(source_type, documents, redacted): documents by type, and how many had something redacted."""
    d = snapshot.table("documents")
    return d.groupBy("source_type").agg(F.count("*").alias("documents"), F.count_if(F.size("redactions") > 0).alias("redacted"))


def text_report(snapshot: Snapshot, states: list[tuple[str, str, str]] = (), freshness: DataFrame | None = None) -> tuple[str, int]:
    """(text, exit code): totals, integrity, coverage by source, redactions, freshness, the last run and the verdict.

    ``states`` are (source, read, partial or failed, documents or reason) of the last run's sources, ``freshness`` the rows of
    ``analytics.capture_lag``.  A source that gave nothing is untested, neither healthy nor broken.
    """
    h, meta = health(snapshot).first(), snapshot.meta
    occurrences = snapshot.table("occurrences").count()
    out = ["Corpus report", f"  store         : {snapshot.store.root}/{snapshot.number}", f"  schema        : {meta['schema_version']}",
        f"  embed model   : {meta.get('embed_model') or '-'}", ""]
    out += [f"  documents     : {h['documents']:,}", f"  unique chunks : {h['chunks']:,}  (prose {h['prose']:,} / tool events {h['tool_events']:,})",
        f"  occurrences   : {occurrences:,}  ({occurrences - h['chunks']:,} duplicate chunks saved)", f"  embedded      : {h['vectors']:,}"]
    if h["pending"]:
        out.append(f"  PENDING       : {h['pending']:,} prose chunks")
    if h["dangling_occurrences"]:
        out += ["", f"Integrity: DAMAGED, {h['dangling_occurrences']:,} occurrences of {h['damaged_documents']:,} documents lost their chunk; repair and run again"]
    else:
        out += ["", f"Integrity: ok{f', {h["orphan_vectors"]:,} vectors without a chunk' if h['orphan_vectors'] else ''}"]
    out += ["", "Sources"]
    for name, state, what in states:
        out.append(f"  {name:<14} {'UNTESTED' if state == 'read' and what == '0' else state}  {what}")
    out += [f"  {r['source_type']:<14} {r['documents']:,} documents, {r['redacted']:,} redacted" for r in coverage(snapshot).orderBy("source_type").collect()]
    out += ["", "Redactions", *(f"  {r['kind']:<20} {r['documents']:,} documents" for r in redaction_totals(snapshot).orderBy("kind").collect())]
    stalled = []
    if freshness is not None:
        rows = freshness.orderBy("source").limit(100).collect()
        out += ["", "Capture freshness", *(f"  {r['source']:<14} {r['state']}" for r in rows)]
        stalled = [r for r in rows if r["state"] in ("stalled", "NEVER ARCHIVED")]
    run = snapshot.table("ingest_runs").orderBy(F.desc("run_id")).first()
    out += ["", f"Last run: {run['mode']}, {run['seen']:,} seen, {run['written']:,} written, {run['errors']:,} errors" if run else "Last run: none",
        f"VERDICT: {h['verdict']}"]
    failed = any(state != "read" for _, state, _ in states)
    return "\n".join(out), max(exit_code(h), int(bool(stalled)), int(failed))


def redaction_totals(snapshot: Snapshot) -> DataFrame:
    """(kind, documents): documents, not matches."""
    return snapshot.table("documents").select(F.explode("redactions").alias("kind")).groupBy("kind").agg(F.count("*").alias("documents"))


def exit_code(row) -> int:
    """1 if chunks are pending, occurrences dangle or the last run had errors; orphan vectors alone are no reason."""
    return int(row["state"] in ("red", "amber", "no-index") or row["dangling_occurrences"] > 0)


#: Rows of a dashboard's frame that are shown at most, where its feed has no limit of its own.
MOST_SHOWN = 1000


@dataclass
class Dashboard:
    """The frames of a dashboard, each bounded by its feed's size."""

    projects: DataFrame
    log: DataFrame
    decisions: DataFrame
    questions: DataFrame
    backlog: DataFrame


def dashboard(curated: DataFrame, documents: DataFrame, chunk_counts: DataFrame, as_of: str) -> Dashboard:
    """From curated notes (path, project, text), documents and their chunk counts."""
    name = F.lower(F.substring_index("path", "/", -1))
    log = notes.log_entries(curated.where(name == "log.md"))
    decisions = notes.decisions(curated.where(name == "decisions.md"))
    overview = curated.where(name == "overview.md")
    questions = notes.open_questions(overview)
    last = log.groupBy("project").agg(F.max("date").alias("last_activity"))
    projects = overview.select("project", notes.status_line(F.col("text")).alias("status")).join(last, "project",
        "left").orderBy(F.col("last_activity").desc_nulls_last(), "project").limit(MOST_SHOWN)
    day = F.lit(as_of).cast("date")
    return Dashboard(
        projects,
        analytics.feed(log, "project", model.FEED_LOG, model.FEED_LOG, F.col("date").desc(), F.col("project"), F.col("n")),
        analytics.feed(decisions, "project", model.FEED_DECISIONS, model.FEED_DECISIONS, F.col("date").desc(), F.col("id").desc(), F.col("project")),
        analytics.feed(questions, "project", model.FEED_QUESTIONS, MOST_SHOWN, F.col("project"), F.col("n"), F.col("at")),
        analytics.backlog(documents, chunk_counts, overview.select("project").distinct(), day).limit(model.FEED_BACKLOG),
    )


def home_page(d: Dashboard) -> str:
    """The dashboard as Markdown; every frame is a feed of few rows."""
    out = ["# Corpus", ""]
    parts = (
        ("Projects", d.projects, lambda r: f"**{r['project']}** {r['last_activity'] or ''} {r['status'] or ''}"),
        ("Log", d.log, lambda r: f"{r['date']} {r['project']}: {r['heading']}"),
        ("Decisions", d.decisions, lambda r: f"{r['id']} {r['project']}: {r['title']} [{r['status']}]"),
        ("Open questions", d.questions, lambda r: f"{r['project']}: {r['question']}"),
        ("Backlog", d.backlog, lambda r: f"{r['project']}: {r['documents']} documents, score {r['score']:.1f}"),
    )
    for title, frame, line in parts:
        out += [f"## {title}", *(f"- {line(r).strip()}" for r in frame.collect()), ""]
    return "\n".join(out)


def distill_prompt(backlog_row) -> str:
    """What to ask for a project of the backlog."""
    return f"Read the {backlog_row['documents']} documents of {backlog_row['project']} (last {backlog_row['last_date'] or 'undated'}) and write its overview, decisions and log."


# What makes a probe for an absent topic useless, and how far it must stay below present ones.
COMPROMISED, ELEVATED, ABSENT_SHARE = 0.8, 0.4, 0.6


def probe_states(probes: DataFrame) -> DataFrame:
    """(query, state): probes (query, coverage, score) of absent topics that the corpus covers after all are
    compromised, or elevated; only clean ones count."""
    state = F.when(F.col("coverage") >= COMPROMISED, "compromised").when(F.col("coverage") >= ELEVATED, "elevated").otherwise("clean")
    return probes.withColumn("state", state)


def golden_verdict(present: DataFrame, absent: DataFrame) -> DataFrame:
    """(verdict): PASS if the best clean absent score stays below its share of the median present one, SKIP without
    either, which is not a pass."""
    p = present.agg(F.median("score").alias("present"))
    a = probe_states(absent).where("state = 'clean'").agg(F.max("score").alias("absent"))
    verdict = F.when(F.col("present").isNull() | F.col("absent").isNull(), "SKIP").when(F.col("absent") < ABSENT_SHARE * F.col("present"),
        "PASS").otherwise("FAIL")
    return p.join(F.broadcast(a)).select("present", "absent", verdict.alias("verdict"))


def reasoning_leaks(chunks: DataFrame) -> DataFrame:
    """(leaks): prose chunks of exports that hold reasoning marks, which belong to the lexical tier."""
    return chunks.where((F.col("kind") == model.PROSE) & F.col("text").contains("[thinking]")).agg(F.count("*").alias("leaks"))

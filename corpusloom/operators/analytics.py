"""Health, freshness, backlog and feeds of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import model
from corpusloom.functions import scoring


def counts(documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of totals: documents, chunks by kind, vectors, prose without a vector."""
    d = documents.agg(F.count("*").alias("documents"))
    held = vectors.select("content_hash").distinct().withColumn("has", F.lit(1))
    rows = chunks.join(held, "content_hash", "left")
    c = rows.agg(F.count("*").alias("chunks"), F.count_if(F.col("kind") == model.PROSE).alias("prose"),
        F.count_if(F.col("kind") == model.TOOL_EVENT).alias("tool_events"),
        F.count_if((F.col("kind") == model.PROSE) & F.col("has").isNull()).alias("pending"))
    v = vectors.agg(F.count("*").alias("vectors"))
    return d.join(F.broadcast(c)).join(F.broadcast(v))  # one row each


def by_type(documents: DataFrame) -> DataFrame:
    return documents.groupBy("source_type").agg(F.count("*").alias("documents"))


def documents_of(documents: DataFrame, names: list[str]) -> DataFrame:
    """(documents): how many a project has under any of its names, in either case."""
    return documents.where(F.lower("project").isin([n.lower() for n in names])).agg(F.count("*").alias("documents"))


def distilled_names(curated: DataFrame, renames: DataFrame) -> DataFrame:
    """(project): names that have notes, and old names declared for them."""
    own = curated.select("project").distinct()
    return own.union(renames.join(own.select(F.col("project").alias("now")), "now", "left_semi").select(F.col("old").alias("project"))).distinct()


def branch_share(documents: DataFrame) -> DataFrame:
    """(project, branch, documents, share): how a project's transcripts divide among branches."""
    n = documents.where(F.col("source_type") == model.TRANSCRIPT).groupBy("project",
        F.coalesce("branch", F.lit(model.CANONICAL)).alias("branch")).agg(F.count("*").alias("documents"))
    return n.withColumn("share", F.col("documents") / F.sum("documents").over(Window.partitionBy("project")))


def capture_lag(live: DataFrame, archived: DataFrame, alarm_hours: float = model.CAPTURE_ALARM_HOURS) -> DataFrame:
    """(source, lag_hours, state): newest live time against newest archived time, never below zero."""
    a = live.groupBy("source").agg(F.max("mtime").alias("live"))
    b = archived.groupBy("source").agg(F.max("mtime").alias("kept"))
    lag = F.greatest(F.lit(0.0), (F.unix_micros(F.col("live").cast("timestamp")) - F.unix_micros(F.col("kept").cast("timestamp"))) / F.lit(3.6e9))
    state = F.when(F.col("live").isNull(), "no live source").when(F.col("kept").isNull(), "NEVER ARCHIVED").when(lag > alarm_hours,
        "stalled").otherwise("ok")
    return a.join(b, "source", "full").select("source", lag.alias("lag_hours"), state.alias("state"))


def export_freshness(batches: DataFrame, as_of: Column, stale_days: int = model.EXPORT_STALE_DAYS) -> DataFrame:
    """(source, newest, age_days, stale) by the newest batch; no date means unknown, not stale."""
    newest = batches.groupBy("source").agg(F.max("batch_date").alias("newest"))
    age = F.datediff(as_of, F.try_to_date("newest", "yyyy-MM-dd"))
    return newest.select("source", "newest", age.alias("age_days"), F.coalesce(age > stale_days, F.lit(False)).alias("stale"))


def verdict(counted: DataFrame, runs: DataFrame) -> DataFrame:
    """(state, sentence) of the corpus from its totals and its latest run (errors, written, seen)."""
    last = runs.agg(F.max_by(F.struct("errors", "written", "seen"), "run_id").alias("r"))
    sentence = (
        F.when(F.col("r").isNull(), "NO INDEX").when(F.col("r.errors") > 0, "IMPORTER ERRORS").when(F.col("pending") > 0,
            "DEGRADED").when((F.col("r.written") == 0) & (F.col("r.seen") > 0), "NOTHING NEW").when(F.col("r.seen") == 0,
            "UNTESTED").otherwise("HEALTHY")
    )
    state = F.when(F.col("r").isNull(), "no-index").when(F.col("r.errors") > 0, "red").when(F.col("pending") > 0, "amber").otherwise("green")
    return counted.join(F.broadcast(last)).select(state.alias("state"), sentence.alias("verdict"))


def backlog(documents: DataFrame, chunk_counts: DataFrame, distilled: DataFrame, as_of: Column) -> DataFrame:
    """Projects with raw material and no distilled notes, by score; chunks are counted per document before
    the join, so nothing fans out."""
    rows = documents.where("project is not null and project <> ''").join(chunk_counts, "path", "left")
    raw = rows.groupBy("project").agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"), F.max("doc_date").alias("last_date"),
        F.count_if(F.col("source_type") == model.TRANSCRIPT).alias("transcripts"),
        F.count_if(F.col("source_type") == model.REPO_DOC).alias("repo_docs"),
        F.count_if(F.col("source_type").isin(*model.DISTILLED_TYPES)).alias("distilled"),
    )
    left = raw.join(distilled.select(F.lower("project").alias("_p")).distinct(), F.lower("project") == F.col("_p"), "left_anti")
    return left.withColumn("score", scoring.backlog_score(F.col("documents"), F.col("last_date"), as_of)).orderBy(F.col("score").desc(), "project")


def suppressions(documents: DataFrame, renames: DataFrame, distilled: DataFrame) -> DataFrame:
    """(project, now, documents): projects that a declared rename hides from the backlog."""
    hidden = renames.join(distilled.select(F.col("project").alias("now")).distinct(), "now", "left_semi").select(F.col("old").alias("project"), "now")
    return documents.join(hidden, "project").groupBy("project", "now").agg(F.count("*").alias("documents")).orderBy(F.col("documents").desc(),
        "project")


def feed(rows: DataFrame, group: str, each: int, total: int, *order: Column) -> DataFrame:
    """The first rows of each group, and of those the first overall."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= each).drop("_n").orderBy(*order).limit(total)

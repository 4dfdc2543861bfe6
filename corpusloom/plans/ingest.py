"""One run: documents of all sources to the next snapshot, by difference from the last."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import model
from corpusloom.batching import small_batches
from corpusloom.functions import text
from corpusloom.operators import aliases, chunking, indexed, maintenance
from corpusloom.plans.snapshot import Snapshot, Store
from corpusloom.workdir import materialize

DOCUMENT_COLUMNS = ("path", "source_type", "project", "root", "doc_date", "mtime", "size", "title", "branch", "cwd", "content_hash", "redactions")

OWNERS = "content_hash string, path string, ord int, kind string, dl int"
RUNS = "run_id long, started string, finished string, mode string, seen long, written long, errors long"

Embedder = Callable[[list[str]], list[list[float]]]


def sign_embedder(texts: list[str], dims: int = 16) -> list[list[float]]:
    """A deterministic embedder for tests: counts of character codes modulo ``dims``, at unit length."""
    out = []
    for t in texts:
        v = np.bincount([ord(c) % dims for c in t.lower()] or [0], minlength=dims).astype(float)
        out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
    return out


def prepared(documents: DataFrame) -> DataFrame:
    """Redacted, hashed documents: (…DOCUMENT_COLUMNS, prose, events) of any source's rows."""
    have = set(documents.columns)
    rows = documents.withColumns({c: F.lit(None).cast("string") for c in ("project", "root", "doc_date", "title", "branch", "cwd", "events",
        "prose") if c not in have})
    if "text" in have and "prose" not in have:
        rows = rows.withColumn("prose", F.col("text"))
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in (("mtime", "double"), ("size", "long")) if c not in have})
    rows = rows.withColumns({"_p": text.redacted(F.coalesce("prose", F.lit(""))), "_e": text.redacted(F.coalesce("events", F.lit("")))})
    rows = rows.withColumns({"prose": F.col("_p.text"), "events": F.col("_e.text"),
        "redactions": F.array_sort(F.array_union("_p.kinds", "_e.kinds"))})
    # what a reader sees of a document is part of its hash, so a new title alone is a change
    marks = F.concat_ws("\x1f", "prose", "events", *(F.coalesce(c, F.lit("")) for c in ("title", "doc_date", "project", "branch")))
    return rows.withColumn("content_hash", F.sha2(marks, 256)).select(*DOCUMENT_COLUMNS, "prose", "events")


def chunks_of(rows: DataFrame) -> DataFrame:
    """(path, ord, kind, text, content_hash): Markdown documents by section, the rest plainly; events follow prose."""
    marked = rows.where(F.lower("path").rlike(r"\.(md|markdown)$"))
    other = rows.where(~F.lower("path").rlike(r"\.(md|markdown)$"))
    prose = chunking.chunked(marked.select("path", F.col("prose").alias("text")),
        pieces=chunking.markdown_pieces).union(chunking.chunked(other.select("path", F.col("prose").alias("text"))))
    events = chunking.chunked(rows.where("events <> ''").select("path", F.col("events").alias("text")), kind=model.TOOL_EVENT)
    n = prose.groupBy("path").agg(F.count("*").alias("n"))
    later = events.join(n, "path", "left").withColumn("ord", (F.col("ord") + F.coalesce("n", F.lit(0))).cast("int")).drop("n")
    return prose.unionByName(later.select(prose.columns))


def embedded(pending: DataFrame, embed: Embedder, model_name: str) -> DataFrame:
    """(content_hash, model, embedding) of pending chunks, in batches, three tries each; a count that differs is an error."""

    small_batches(pending.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for at in range(0, len(b), model.EMBED_BATCH):
                part = [t[: model.EMBED_CHARS] for t in b["text"].iloc[at : at + model.EMBED_BATCH]]
                for left in range(model.EMBED_TRIES - 1, -1, -1):
                    try:
                        got = embed(part)
                        break
                    except OSError:
                        if not left:
                            raise
                if len(got) != len(part):
                    raise ValueError(f"{len(part)} texts, {len(got)} vectors")
                found += got
            yield pd.DataFrame({"content_hash": b["content_hash"], "model": model_name, "embedding": found})

    return pending.select("content_hash", "text").mapInPandas(run, "content_hash string, model string, embedding array<float>")


def run(
    store: Store, documents: DataFrame, scanned: DataFrame, embed: Embedder | None = None, model_name: str = "sign-16", full: bool = False,
    errors: int = 0, now: datetime | None = None, unchanged: DataFrame | None = None
) -> Snapshot:
    """Bring the store to ``documents`` (all that were parsed) and ``unchanged`` (path of those that need no parse), with
    sources scanned successfully in ``scanned``.

    Only new and changed documents are chunked; texts, postings and vectors are written of chunks that are new, and stay where
    they are for the rest.  Documents of sources that failed stay.  Without an embedder the chunks stay pending.
    """
    spark = documents.sparkSession
    started = now or datetime.now(UTC)
    seen = materialize(prepared(documents), "seen")
    last = store.current()
    if last and last.meta.get("pipeline_version") != str(model.PIPELINE_VERSION):
        full = True  # parse everything again; vectors survive by hash
    none = spark.createDataFrame([], "content_hash string")
    if last:
        old = last.table("documents")
        states = maintenance.diff(old, seen)
        fresh = seen if full else seen.join(states.where(F.col("state").isin("new", "changed")), "path", "left_semi")
        paths = seen.select("path") if unchanged is None else seen.select("path").union(unchanged.select("path"))
        kept = maintenance.prune(maintenance.upsert(old, seen.select(*old.columns)), paths, scanned)
        before, buried, runs = last.table("owners"), last.table("dead"), last.table("ingest_runs")
        stored = last.table("occurrences").join(kept.select("path"), "path", "left_semi").join(fresh.select("path"), "path", "left_anti")
    else:
        fresh, kept, runs = seen, seen.select(*DOCUMENT_COLUMNS), None
        before, buried, stored = spark.createDataFrame([], OWNERS), none, spark.createDataFrame([],
            "path string, ord int, kind string, content_hash string")
    pieces = materialize(chunks_of(fresh), "chunks")
    occurrences = materialize(stored.unionByName(pieces.select("path", "ord", "kind", "content_hash")), "occurrences")
    held = before.select("content_hash").union(buried)
    unit = pieces.join(held, "content_hash", "left_anti").groupBy("content_hash").agg(F.min_by(F.struct("kind", "text"),
        F.struct("path", "ord")).alias("c"))
    added = materialize(unit.select("content_hash", "c.kind", "c.text"), "chunks")
    posted = indexed.postings(added.select("content_hash", "text"), "content_hash").withColumnRenamed("unit", "content_hash")
    owners = materialize(owned(occurrences, before, buried if last is None else last.segments("postings").join(buried, "content_hash", "left_semi"),
        posted, added), "owners")
    dead = materialize(held.distinct().join(owners, "content_hash", "left_anti"), "dead")
    vectors = spark.createDataFrame([], "content_hash string, model string, embedding array<float>")
    if embed is not None:
        texts = added.select("content_hash", "kind",
            "text") if last is None else last.segments("texts").unionByName(added.drop("kind")).join(owners.select("content_hash", "kind"), "content_hash")
        vectors = materialize(embedded(maintenance.pending(texts, vectors if last is None else last.segments("vectors"), model_name), embed,
            model_name), "vectors")
    number = (runs.agg(F.max("run_id")).first()[0] or 0) + 1 if runs is not None else 1
    row = spark.createDataFrame([(number, started.isoformat(), datetime.now(UTC).isoformat(), "full" if full else "incremental", seen.count(),
        fresh.count(), errors)], RUNS)
    runs = row if runs is None else runs.unionByName(row)
    tables = {"documents": kept, "occurrences": occurrences, "owners": owners, "dead": dead, "ingest_runs": runs}
    new = {"texts": added.select("content_hash", "text"), "postings": posted, "vectors": vectors}
    return store.publish(tables, new if last is None else {n: df for n, df in new.items() if not df.isEmpty()},
        {"pipeline_version": str(model.PIPELINE_VERSION), "embed_model": model_name if embed else ""})


def owned(occurrences: DataFrame, before: DataFrame, buried: DataFrame, posted: DataFrame, added: DataFrame) -> DataFrame:
    """(content_hash, path, ord, kind, dl): chunks that a document holds, each with its least place and its length.

    Lengths come with the last owners, with the postings of new chunks, or of dead ones that are held again.
    """
    home = occurrences.groupBy("content_hash").agg(F.min(F.struct("path", "ord", "kind")).alias("home"))
    lengths = before.select("content_hash", "dl").unionByName(posted.groupBy("content_hash").agg(F.first("dl").alias("dl")))
    if "dl" in buried.columns:
        lengths = lengths.unionByName(buried.groupBy("content_hash").agg(F.first("dl").alias("dl")))
    return home.join(lengths, "content_hash", "left").select("content_hash", "home.path", "home.ord", "home.kind",
        F.coalesce("dl", F.lit(0)).alias("dl"))


def repaired(store: Store) -> Snapshot:
    """The next snapshot, without vectors, texts and postings of chunks that nothing holds, and without occurrences that
    lost their chunk; documents that lost some are marked by an empty hash, so that the next run parses them again."""
    last = store.current()
    texts = last.segments("texts").select("content_hash")
    occurrences = last.table("occurrences")
    lost = materialize(occurrences.join(texts, "content_hash", "left_anti"), "lost")
    owners = materialize(last.table("owners").join(texts, "content_hash", "left_semi"), "owners")
    again = F.when(F.col("_lost"), F.lit("")).otherwise(F.col("content_hash"))
    documents = last.table("documents").join(lost.select("path").distinct().withColumn("_lost", F.lit(True)), "path", "left")
    documents = documents.withColumn("content_hash", again).withColumn("size", F.when(F.col("_lost"), -1).otherwise(F.col("size"))).drop("_lost")
    tables = {"documents": documents, "occurrences": occurrences.join(texts, "content_hash", "left_semi"), "owners": owners,
        "dead": last.table("dead").where("false"), "ingest_runs": last.table("ingest_runs")}
    rows = {n: materialize(last.segments(n).join(owners.select("content_hash"), "content_hash", "left_semi").select(last.segments(n).columns),
        n) for n in ("texts", "vectors")}
    posted = last.segments("postings").join(owners.select("content_hash"), "content_hash", "left_semi").select("term", "content_hash", "dl", "tf", "positions")
    return store.publish(tables, rows | {"postings": posted}, {}, anew=True)


def reattributed(store: Store, roots: list[str]) -> Snapshot:
    """The next snapshot, where documents have the project of the folder they were worked in, by the roots of today; nothing
    is parsed again."""
    last = store.current()
    places = last.table("documents").where("cwd is not null").select("path", "cwd")
    asked = places.select(F.col("cwd").alias("path")).distinct()
    found = places.join(aliases.project_of(asked, roots, is_file=False).withColumnRenamed("path", "cwd"), "cwd").select("path", "project")
    tables = {n: last.table(n) for n in ("occurrences", "owners", "dead", "ingest_runs")}
    return store.publish(tables | {"documents": maintenance.reattributed(last.table("documents"), found)}, {}, {})


def folder_hash(files: DataFrame) -> DataFrame:
    """(folder, digest): a hash over names and contents in order of name; changes when either does."""
    own = F.sha2(F.col("content"), 256)
    held = files.select(F.regexp_replace("path", r"/[^/]*$", "").alias("folder"),
        F.struct(F.substring_index("path", "/", -1).alias("name"), own.alias("h")).alias("f"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: F.concat_ws("\x1f", f["name"], f["h"])), "\n")
    return held.groupBy("folder").agg(F.sha2(joined, 256).alias("digest"))

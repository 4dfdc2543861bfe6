"""Documents of all sources for one run: curated notes, repositories, agent sessions, rollouts and two account exports.

Each source is gathered on its own.  One that fails is counted and reported, as is one of which a part can't be read (the rest is
taken); its type is then not among those scanned, so that its documents stay.  Files that the last snapshot holds as they are need no parse.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import model
from corpusloom.functions import text
from corpusloom.operators import aliases, maintenance, sessions
from corpusloom.plans import ingest
from corpusloom.plans.snapshot import Snapshot, Store
from corpusloom.sources import agents, discovery, exports, files
from corpusloom.workdir import materialize

COLUMNS = "path string, source_type string, project string, root string, doc_date string, mtime double, size long, title string, branch string, cwd string, prose string, events string"


@dataclass(frozen=True)
class Sources:
    """Where each source lies; one that is None is not there.  Repositories are the configuration's roots."""

    config: files.Config = field(default_factory=files.Config)
    curated: str | None = None
    memory: str | None = None
    sessions: str | None = None
    rollouts: str | None = None
    thread_names: str | None = None
    tree_exports: str | None = None
    flat_exports: str | None = None


@dataclass
class Gathered:
    documents: DataFrame
    unchanged: DataFrame
    scanned: DataFrame
    #: (source, read, partial or failed, documents or what went wrong)
    states: list[tuple[str, str, str]]

    @property
    def errors(self) -> int:
        return sum(state != "read" for _, state, _ in self.states)


class Run:
    def __init__(self, spark: SparkSession, sources: Sources, last: Snapshot | None, full: bool) -> None:
        self.spark, self.sources, self.full = spark, sources, full
        self.held = last.table("documents").select("path", "mtime", "size") if last else None
        self.roots = list(sources.config.roots.values())
        self.skipped: list[str] = []
        #: what the source that is being read has besides what it gives
        self.problems: list[str] = []

    def skip(self, found: list[files.Found]) -> set[str]:
        """Paths of a walk that need no parse; the walk's list is on the driver anyway."""
        if self.held is None or not found:
            return set()
        same = {r["path"] for r in maintenance.unchanged(files.listed(self.spark, found), self.held, self.full).select("path").collect()}
        self.skipped += sorted(same)
        return same

    def tree(self, root: str, label: str, kind: str) -> DataFrame:
        rows = files.read_tree(self.spark, root, label, self.sources.config, skip=self.skip)
        path = F.col("path")
        return rows.select("path", F.lit(kind).alias("source_type"), "project", "root",
            text.doc_date(F.col("text"), path, F.col("mtime")).alias("doc_date"), "mtime", "size", text.title(F.col("text"), path).alias("title"),
            F.col("text").alias("prose"))

    def placed(self, documents: DataFrame) -> DataFrame:
        """Documents with the project of the folder they were worked in."""
        cwd = documents.select(F.col("cwd").alias("path")).where("path is not null").distinct()
        found = aliases.project_of(cwd, self.roots, is_file=False).withColumnRenamed("path", "cwd")
        return documents.join(found, "cwd", "left")

    def session_documents(self, root: str) -> DataFrame:
        found = [f for f in files.walk(self.spark, root) if f.path.endswith(".jsonl")]
        if not found:
            return self.none()
        rows = materialize(agents.session_documents(files.lines(self.spark, [f.path for f in found])), "sessions")
        held = rows.select(F.col("path").alias("session"), F.explode("files").alias("path")).join(files.listed(self.spark, found), "path")
        return self.placed(rows.join(sessions.session_files(held).select(F.col("session").alias("path"), "mtime", "size"), "path", "left"))

    def rollout_documents(self, root: str) -> DataFrame:
        found = [files.Found(r["path"], r["mtime"], r["size"]) for r in discovery.rollouts(files.listing(self.spark, root)).collect()]
        done = self.skip(found)
        wanted = [f for f in found if f.path not in done]
        if not wanted:
            return self.none()
        rows = agents.rollout_documents(files.lines(self.spark, [f.path for f in wanted])).join(files.listed(self.spark, wanted), "path")
        if self.sources.thread_names:
            rows = agents.with_titles(rows, files.lines(self.spark, self.sources.thread_names))
        return self.placed(rows)

    def json_items(self, paths: list[str], inner: str | None = "conversations") -> DataFrame:
        """Elements that are JSON; the first few of those that aren't are problems of the source."""
        good, bad = exports.json_items(self.spark, paths, inner)
        places = [r["path"] + (f" element {r['at']}" if r["at"] >= 0 else "") for r in bad.orderBy("path", "at").limit(6).collect()]
        if places:
            self.problems.append(f"no JSON in {', '.join(places[:5])}" + " and more" * (len(places) > 5))
        return good

    def surveyed(self, listing: DataFrame) -> None:
        """Files of an export that nobody knows are a problem."""
        strange = [r["path"] for r in exports.survey(listing).where("state = 'unknown'").orderBy("path").limit(6).collect()]
        if strange:
            self.problems.append(f"unknown files: {', '.join(strange[:5])}" + " and more" * (len(strange) > 5))

    def tree_export(self, root: str) -> DataFrame:
        listing = files.listing(self.spark, root)
        self.surveyed(listing)
        batches = discovery.export_batches(listing).collect()
        if not batches:
            return self.none()
        good = self.json_items([p for b in batches for p in b["files"]])
        maps = [r["path"] for r in listing.where(F.substring_index("path", "/", -1) == exports.ASSET_NAMES).select("path").collect()]
        names = exports.asset_names(self.json_items(maps, None)) if maps else None
        return exports.documents(*exports.tree_messages(good, names), root)

    def flat_export(self, root: str) -> DataFrame:
        listing = files.listing(self.spark, root)
        self.surveyed(listing)
        held = [r["path"] for r in listing.select("path").collect()]
        out = self.none()
        talks = [p for p in held if p.rsplit("/", 1)[-1] == "conversations.json"]
        if talks:
            out = out.unionByName(exports.documents(*exports.flat_messages(self.json_items(talks)), root), allowMissingColumns=True)
        for batch in (r["batch"] for r in discovery.second_batches(listing).collect()):
            name = batch.rsplit("/", 1)[-1]
            for wanted, inner, read in ((lambda p: p == f"{batch}/memories.json", "memories", exports.memory_documents),
                (lambda p: p.startswith(f"{batch}/projects/"), None, exports.project_documents)):  # noqa: B023
                if mine := [p for p in held if wanted(p)]:
                    out = out.unionByName(read(self.json_items(mine, inner), name, root), allowMissingColumns=True)
        return out

    def none(self) -> DataFrame:
        return self.spark.createDataFrame([], COLUMNS)

    def named(self) -> list[tuple[str, tuple[str, ...], Callable[[], DataFrame]]]:
        """(name, types it feeds, how it is read) of every source that is there."""
        s = self.sources
        out = [(f"tree {label}", (model.REPO_DOC,), lambda root=root, label=label: self.tree(root, label, model.REPO_DOC)) for label,
            root in s.config.roots.items()]
        for name, at, kinds, read in (
            ("curated", s.curated, (model.CURATED,), lambda at: self.tree(at, "curated", model.CURATED)),
            ("memory", s.memory, (model.TOOL_MEMORY,), lambda at: self.tree(at, "memory", model.TOOL_MEMORY)),
            ("sessions", s.sessions, (model.TRANSCRIPT,), self.session_documents),
            ("rollouts", s.rollouts, (model.TRANSCRIPT,), self.rollout_documents),
            ("tree export", s.tree_exports, (model.TRANSCRIPT,), self.tree_export),
            ("flat export", s.flat_exports, (model.TRANSCRIPT, model.USER_MEMORY, model.PROJECT_BRIEF), self.flat_export),
        ):
            if at:
                out.append((name, kinds, lambda at=at, read=read: read(at)))
        return out


def gather(spark: SparkSession, sources: Sources, last: Snapshot | None = None, full: bool = False) -> Gathered:
    run = Run(spark, sources, last, full)
    documents, states, fed, failed = run.none(), [], set(), set()
    for name, kinds, read in run.named():
        fed |= set(kinds)
        run.problems = []
        try:
            rows = read()
            for column in (c for c in documents.columns if c not in rows.columns):
                rows = rows.withColumn(column, F.lit(None).cast(documents.schema[column].dataType))
            rows = materialize(rows.select(*(F.col(f.name).cast(f.dataType) for f in documents.schema)), "source")
            documents = documents.unionByName(rows)
            states.append((name, "partial", "; ".join(run.problems)) if run.problems else (name, "read", str(rows.count())))
            failed |= set(kinds) if run.problems else set()
        except Exception as error:  # noqa: BLE001  a source's failure is reported and leaves its documents as they are
            failed |= set(kinds)
            states.append((name, "failed", str(error).split("\n")[0][:300]))
    unchanged = spark.createDataFrame([(p,) for p in run.skipped], "path string")
    scanned = spark.createDataFrame([(k,) for k in sorted(fed - failed)], "source_type string")
    return Gathered(documents, unchanged, scanned, states)


def update(store: Store, sources: Sources, embed: ingest.Embedder | None = None, model_name: str = "sign-16", full: bool = False) -> tuple[Snapshot,
    Gathered]:
    """One run over all sources."""
    found = gather(store.spark, sources, store.current(), full)
    return ingest.run(store, found.documents, found.scanned, embed, model_name, full, found.errors, unchanged=found.unchanged), found

"""The store: numbered folders of Parquet tables, a manifest in each, and a pointer that is replaced whole.

What is written once for each distinct chunk (texts, postings, vectors) lies in segments that later snapshots go on
reading.  Vectors lie by clusters.  Texts, and the places where chunks stand with the attributes of their documents, are sorted by hash with a list of each
file's keys, so that a search opens the files of its candidates only; a run writes a segment of its new chunks only, and the hashes of chunks that no document holds any more (``dead``).
Segments are merged when there are many, or many dead in them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import model
from corpusloom.operators import clusters, indexed, keyed, ranges

#: Tables of a folder, and the schemas of those that lie in segments.
TABLES = ("documents", "occurrences", "owners", "dead", "ingest_runs")
SCHEMAS = {
    "texts": "content_hash string, text string", "postings": "term string, content_hash string, dl int, tf int, positions array<int>",
    "vectors": "content_hash string, model string, embedding array<float>",
}
PLACES = ("content_hash string, chunk_id long, path string, project string, source_type string, kind string, doc_date string, title string, "
    "ord int, branch string")
#: Segments of a table at most, and dead chunks for each live one, beyond which segments are merged.
MOST_SEGMENTS, MOST_DEAD = 8, 0.5


class Store:
    """A corpus below one folder, in any file system that Spark writes to; ``file_rows`` bounds the files of keyed tables."""

    def __init__(self, spark: SparkSession, root: str, file_rows: int = keyed.FILE_ROWS) -> None:
        self.spark, self.root, self.file_rows = spark, root.rstrip("/"), file_rows

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _read(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, path: str, text: str) -> None:
        """Write beside the target, then rename over it in one step: a reader sees the old or the new."""
        fs, part = self._fs(path + ".part")
        stream = fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        jvm = self.spark._jvm
        rename = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = jvm.java.lang.reflect.Array.newInstance(rename, 1)
        options[0] = rename.getEnumConstants()[1]
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self.spark._jsc.hadoopConfiguration()).rename(part, self._fs(path)[1],
            options)

    def holds(self, path: str) -> bool:
        """Whether a table was written whole below the path."""
        fs, p = self._fs(f"{path}/_SUCCESS")
        return fs.exists(p)

    def log(self, name: str, record: dict) -> None:
        """Append one record to the JSON-lines log ``name``."""
        self.spark.createDataFrame([(json.dumps(record, sort_keys=True),)],
            "value string").coalesce(1).write.mode("append").text(f"{self.root}/logs/{name}")

    def logged(self, name: str) -> DataFrame:
        return self.spark.read.text(f"{self.root}/logs/{name}")

    def current(self) -> Snapshot | None:
        name = self._read(f"{self.root}/CURRENT")
        return Snapshot(self, int(name), json.loads(self._read(f"{self.root}/{name.strip()}/manifest.json") or "{}")) if name else None

    def reset(self) -> Snapshot | None:
        """The next snapshot, empty; readers of the last one go on, and ``expire`` frees its space."""
        last = self.current()
        if last is None:
            return None
        none = {n: last.table(n).where("false") for n in TABLES}
        return self.publish(none, {n: last.segments(n).where("false") for n in SCHEMAS}, {"pipeline_version": ""}, anew=True)

    def expire(self, keep: int = 2) -> list[str]:
        """Delete what none of the last ``keep`` snapshots reads; what was deleted, as paths below the root."""
        last = self.current()
        if last is None:
            return []
        kept = [Snapshot(self, n, json.loads(self._read(f"{self.root}/{n}/manifest.json") or "{}")) for n in range(max(0, last.number - keep + 1),
            last.number + 1)]
        used = {s for k in kept for held in k.meta["segments"].values() for s in held}
        fs, root = self._fs(self.root)
        gone = []
        for folder in (f.getPath() for f in fs.listStatus(root)):
            name = folder.getName()
            if not name.isdigit() or int(name) >= kept[0].number:
                continue
            inside = {f"{name}/{f.getPath().getName()}": f.getPath() for f in fs.listStatus(folder)}
            needed = used & inside.keys()
            for path in [f"{name}/{p.split('/')[1]}" for p in inside if p not in needed] if needed else [name]:
                fs.delete(self._fs(f"{self.root}/{path}")[1], True)
                gone.append(path)
        return sorted(gone)

    def publish(self, tables: dict[str, DataFrame], added: dict[str, DataFrame], meta: dict[str, str], anew: bool = False) -> Snapshot:
        """Write the tables and the new segments of the next snapshot, then turn the pointer; readers of the last one go on.

        ``added`` has the rows of each new segment; with ``anew`` it has all rows, and older segments are left.
        """
        last = self.current()
        number = last.number + 1 if last else 0
        segments = {n: [] if anew or not last else list(last.meta["segments"][n]) for n in SCHEMAS}
        for name, df in tables.items():
            # one document's occurrences are in few files
            df = df.repartitionByRange("path").sortWithinPartitions("path", "ord") if name == "occurrences" else df
            df.write.mode("overwrite").parquet(f"{self.root}/{number}/{name}")
        for name, df in added.items():
            if name == "texts":
                keyed.write(df.select("content_hash", "text"), f"{self.root}/{number}/{name}", "content_hash", self.file_rows)
            elif name == "vectors":
                clusters.write(df.select("content_hash", "model", "embedding"), f"{self.root}/{number}/{name}", "content_hash", self.file_rows)
            else:
                ranges.write(df.select("term", "content_hash", "dl", "tf", "positions"), f"{self.root}/{number}/{name}", "content_hash")
            segments[name].append(f"{number}/{name}")
        keyed.write(self._places(number), f"{self.root}/{number}/places", "content_hash", self.file_rows)
        owners = self.spark.read.parquet(f"{self.root}/{number}/owners").agg(F.count("*"), F.avg("dl")).first()
        dead = self.spark.read.parquet(f"{self.root}/{number}/dead").count()
        models = [r[0] for r in self.spark.read.schema(SCHEMAS["vectors"]).parquet(*(f"{self.root}/{s}" for s in segments["vectors"])).select("model").distinct().collect()]
        facts = {"segments": segments, "total": owners[0], "mean_dl": owners[1] or 0.0,
            "dead": dead, "models": models}
        manifest = (last.meta if last else {}) | {"schema_version": str(model.SCHEMA_VERSION)} | facts | meta
        self._write(f"{self.root}/{number}/manifest.json", json.dumps(manifest))
        self._write(f"{self.root}/CURRENT", str(number))
        snapshot = Snapshot(self, number, manifest)
        return snapshot.merged() if snapshot.is_scattered() else snapshot

    def _places(self, number: int) -> DataFrame:
        """Occurrences with what a filter or a result says of their documents."""
        read = lambda name, *columns: self.spark.read.parquet(f"{self.root}/{number}/{name}").select(*columns)
        d = read("documents", "path", "project", "source_type", "doc_date", "title", F.coalesce("branch", F.lit(model.CANONICAL)).alias("branch"))
        held = read("occurrences", "path", "ord", "content_hash", "kind").join(d, "path").withColumn("chunk_id", F.xxhash64("path", "ord"))
        return held.select(*(f.split()[0] for f in PLACES.split(", ")))


@dataclass
class Snapshot:
    store: Store
    number: int
    meta: dict

    def path(self, name: str) -> str:
        return f"{self.store.root}/{self.number}/{name}"

    def segments(self, name: str) -> DataFrame:
        """All rows of a segmented table, also of dead chunks."""
        read = self.store.spark.read
        return reduce(DataFrame.unionByName, (read.schema(SCHEMAS[name]).parquet(f"{self.store.root}/{s}") for s in self.meta["segments"][name]))

    def live(self, name: str) -> DataFrame:
        rows = self.segments(name)
        return rows.join(self.table("dead"), "content_hash", "left_anti") if self.meta["dead"] else rows

    def table(self, name: str) -> DataFrame:
        """A table by name; chunks are owners with their texts."""
        if name == "chunks":
            return self.table("owners").join(self.segments("texts"), "content_hash").select("content_hash", "path", "ord", "kind",
                "text")
        return self.live(name) if name in SCHEMAS else self.store.spark.read.parquet(self.path(name))

    def is_scattered(self) -> bool:
        return max(map(len, self.meta["segments"].values())) > MOST_SEGMENTS or self.meta["dead"] > MOST_DEAD * max(1, self.meta["total"])

    def merged(self) -> Snapshot:
        """The next snapshot, with the same rows in one segment each and no dead ones."""
        same = {n: self.table(n) for n in TABLES if n != "dead"} | {"dead": self.table("dead").where("false")}
        return self.store.publish(same, {n: self.live(n) for n in SCHEMAS}, {}, anew=True)

    def texts(self, alias: str | None = None) -> keyed.Keyed:
        """Texts by hash; those of dead chunks are among them."""
        return keyed.Keyed(self.store.spark, [f"{self.store.root}/{s}" for s in self.meta["segments"]["texts"]], SCHEMAS["texts"], "content_hash", alias)

    def chunks_of(self, path: str) -> DataFrame:
        """(path, ord, text) of one document, from the files that hold its chunks."""
        own = self.table("occurrences").where(F.col("path") == path).select("path", "ord", "content_hash").collect()  # of one document
        held = F.broadcast(self.store.spark.createDataFrame(own, "path string, ord int, content_hash string"))
        return self.texts().rows([r["content_hash"] for r in own]).join(held, "content_hash").select("path", "ord", "text")

    @cached_property
    def index(self) -> indexed.Index:
        """What a search reads."""
        places = keyed.Keyed(self.store.spark, [self.path("places")], PLACES, "content_hash", "unit")
        return indexed.Index(
            places, self.live("postings").withColumnRenamed("content_hash", "unit"), self.texts("unit"), self.meta["total"], self.meta["mean_dl"],
            self.live("vectors").withColumnRenamed("content_hash", "unit") if self.meta["models"] else None, tuple(self.meta["models"]),
            self.table("occurrences").select(F.col("content_hash").alias("unit"), "kind"),
            clusters.Clustered(self.store.spark, [f"{self.store.root}/{s}" for s in self.meta["segments"]["vectors"]], SCHEMAS["vectors"], "content_hash"),
            self.table("dead").select(F.col("content_hash").alias("unit")) if self.meta["dead"] else None,
            ranges.Ranged(self.store.spark, [f"{self.store.root}/{s}" for s in self.meta["segments"]["postings"]], SCHEMAS["postings"], "content_hash"),
        )

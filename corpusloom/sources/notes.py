"""Curated notes: decisions, logs, open questions, overviews; and the tables that declare aliases."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.batching import slices, small_batches

#: Names of one automaton.
BLOCK_NAMES = 100_000
# A decision's identifier is a date and a series of letters or digits.
DECISION_ID = r"D-\d{4}-\d{2}-\d{2}-[A-Za-z0-9]+"
DECISION = rf"^##\s+({DECISION_ID})\s*(?:[—–-]+\s*)?(.*?)\s*(?:\[([^\]]+)\])?\s*$"
LOG = r"^##\s+(\d{4}-\d{2}-\d{2})\s*[—–-]+\s*([^—–]+?)\s*(?:[—–]+\s*(.*))?$"


def lines(notes: DataFrame) -> DataFrame:
    """(path, project, n, line) of every line of (path, project, text)."""
    return notes.select("path", "project", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))


def split_sections(rows: DataFrame, heading: str) -> DataFrame:
    """(path, project, n, head, body) of stretches from one matching heading to the next; what precedes goes."""
    w = Window.partitionBy("path").orderBy("n")
    hit = F.col("line").rlike(heading)
    numbered = rows.withColumn("s", F.sum(hit.cast("int")).over(w)).where("s > 0")
    held = F.array_sort(F.collect_list(F.struct("n", "line")))
    out = numbered.groupBy("path", "project", "s").agg(held.alias("h"))
    body = F.array_join(F.transform(F.slice("h", 2, F.greatest(F.lit(0), F.size("h") - 1)), lambda x: x["line"]), "\n")
    return out.select("path", "project", F.col("h")[0]["n"].alias("n"), F.col("h")[0]["line"].alias("head"), body.alias("body"))


def bullet(body: Column, name: str) -> Column:
    """The value of a ``- **Name:** value`` line."""
    return F.nullif(F.trim(F.regexp_extract(body, rf"(?im)^\s*[-*]\s*\**{name}\**\s*:\s*\**\s*(.+?)\s*$", 1)), F.lit(""))


def decisions(notes: DataFrame) -> DataFrame:
    """(project, id, title, date, status, superseded_by, supersedes, why).

    A status line beats the heading's tag; a missing date is the identifier's; targets of a
    supersession get back the identifiers that replace… and are replaced by them.
    """
    rows = split_sections(lines(notes), DECISION)
    head = lambda k: F.regexp_extract("head", DECISION, k)
    said = F.coalesce(bullet(F.col("body"), "Status"), F.nullif(head(3), F.lit("")))
    low = F.lower(said)
    status = F.when(said.isNull(), "unknown").when(low.startswith("superseded"), "superseded").when(low.startswith("active"),
        "active").otherwise(said)
    own = rows.select("project", "path", "n", head(1).alias("id"), head(2).alias("title"),
        F.coalesce(F.nullif(F.regexp_extract(F.coalesce(bullet(F.col("body"), "Date"), F.lit("")), r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")),
            F.substring(head(1), 3, 10)).alias("date"), status.alias("status"),
            F.when(low.startswith("superseded"),
                F.array_distinct(F.regexp_extract_all(said, F.lit(f"({DECISION_ID})"),
                    1))).otherwise(F.expr("cast(array() as array<string>)")).alias("superseded_by"), bullet(F.col("body"), "Why").alias("why"))
    back = own.select("project", "id", F.explode("superseded_by").alias("by")).groupBy("project",
        F.col("by").alias("id")).agg(F.array_sort(F.collect_set("id")).alias("supersedes"))
    return own.join(back, ["project", "id"], "left").withColumn("supersedes", F.coalesce("supersedes", F.expr("cast(array() as array<string>)")))


def log_entries(notes: DataFrame) -> DataFrame:
    """(project, date, agent, heading, decisions, first_line)."""
    rows = split_sections(lines(notes), LOG)
    part = lambda k: F.regexp_extract("head", LOG, k)
    refs = F.array_sort(F.array_distinct(F.regexp_extract_all("body", F.lit(f"({DECISION_ID})"), 1)))
    return rows.select("project", "path", "n", part(1).alias("date"), F.trim(part(2)).alias("agent"), part(3).alias("heading"),
        refs.alias("decisions"), first_line(F.col("body")).alias("first_line"))


def first_line(body: Column, limit: int = 240) -> Column:
    """The first line that says something, without list marks."""
    said = F.filter(F.transform(F.split(body, "\n"), lambda s: F.trim(F.regexp_replace(s, r"^\s*(?:[-*>]\s+)?", ""))),
        lambda s: (s != "") & ~s.startswith("#"))
    line = F.try_element_at(said, F.lit(1))
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit), F.lit("…"))).otherwise(line)


def open_questions(notes: DataFrame) -> DataFrame:
    """(project, n, question): bullets under a heading of open questions, with their continuation lines;
    those that end as resolved go."""
    rows = split_sections(lines(notes), r"^##\s").where(F.lower("head").contains("open question"))
    items = rows.select("path", "project", "n", F.posexplode(F.split("body", "\n")).alias("i", "line"))
    w = Window.partitionBy("path", "n").orderBy("i")
    items = items.withColumn("b", F.sum(F.col("line").rlike(r"^[-*]\s+").cast("int")).over(w)).where("b > 0 and trim(line) <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))),
        lambda x: F.trim(F.regexp_replace(x["line"], r"^\s*[-*]\s+", ""))), " ")
    out = items.groupBy("path", "project", "n", "b").agg(text.alias("question"))
    return out.where(~F.lower("question").rlike(r"(?:\(|\*\*|—|-)\s*resolved\b[^)]*\)?\**\.?\s*$")).select("project", "n", F.col("b").alias("at"),
        "question")


def status_line(overview: Column) -> Column:
    """The status of an overview, from its first 20 lines, without markup."""
    held = F.filter(F.slice(F.split(overview, "\n"), 1, 20), lambda s: F.lower(s).rlike(r"^\W*status\b"))
    return first_line(F.regexp_replace(F.regexp_replace(F.try_element_at(held, F.lit(1)), r"[*_`]", ""), r"(?i)^\W*status\s*[:—-]*\s*", ""))


def alias_table(index: DataFrame, config_aliases: dict[str, str] | None = None) -> DataFrame:
    """(alias, canonical) from pipe tables of an index note, (path, project, text).

    Rows of the families section map names in back-ticks of the notes to the family's first member; rows of
    the projects section map the aliases of the last column to the name.  Declared aliases come first.
    """
    spark = index.sparkSession
    w = Window.partitionBy("path").orderBy("n")
    rows = lines(index).withColumn("section", F.last(F.when(F.col("line").rlike(r"^#+\s"), F.lower("line")), ignorenulls=True).over(w))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    rows = rows.where(F.col("line").rlike(r"^\s*\|") & ~F.col("line").rlike(r"^\s*\|[\s:|-]+$")).withColumn("c", cells)
    ticked = lambda c: F.regexp_extract_all(c, F.lit("`([^`]+)`"), 1)
    families = rows.where(F.col("section").contains("famil") & (F.size("c") >= 3)).select(F.try_element_at(ticked(F.get("c", F.lit(1))),
        F.lit(1)).alias("canonical"), F.explode(ticked(F.get("c", F.lit(2)))).alias("alias")).where("canonical is not null")
    clean = lambda c: F.trim(F.regexp_replace(c, r"[`*\[\]]|\(.*?\)", ""))
    projects = rows.where(F.col("section").contains("project") & (F.size("c") >= 5)).select(clean(F.get("c", F.lit(0))).alias("canonical"),
        F.explode(F.split(F.element_at("c", -1), "[,;]")).alias("a")).select("canonical", clean(F.col("a")).alias("alias"))
    names = rows.where(F.col("section").contains("project")).select(clean(F.get("c", F.lit(0))).alias("canonical")).select("canonical",
        F.col("canonical").alias("alias"))
    every = families.select("alias", "canonical").withColumn("rank", F.lit(2)).union(projects.select("alias", "canonical").withColumn("rank",
        F.lit(3))).union(names.select("alias", "canonical").withColumn("rank", F.lit(4)))
    if config_aliases:
        every = every.union(spark.createDataFrame([(a, c, 1) for a, c in config_aliases.items()], "alias string, canonical string, rank int"))
    first = every.where("alias is not null and alias not in ('', '-', '—') and canonical <> ''").groupBy(F.lower("alias").alias("alias")).agg(F.min_by("canonical", F.struct("rank", "canonical")).alias("canonical"))
    return first.select("alias", "canonical")


def classify_drops(listing: DataFrame) -> DataFrame:
    """(path, kind, reason) of dropped entries; the first rule that fits wins.

    ``listing`` has path, is_dir, names (files inside, where it is a folder) and head (first characters).
    """
    name = F.lower(F.substring_index("path", "/", -1))
    inside = lambda pattern: F.exists("names", lambda n: n.rlike(pattern))
    kind = (
        F.when(F.col("is_dir") & inside(r"^conversations[^/]*\.json$") & inside(r"^users?\.json$"), "account-export")
        .when(F.col("is_dir") & inside(r"^rollout-.*\.jsonl$"), "rollouts").when(F.col("is_dir") & inside(r"\.(md|markdown)$"), "notes")
        .when(name.endswith(".zip") & name.rlike("export|data-"), "export-archive").when(name.endswith(".zip"),
            "archive").when(name.rlike(r"^rollout-.*\.jsonl$"), "rollouts")
        .when(name.endswith(".jsonl") & F.col("head").contains('"sessionId"'), "session").when(name.rlike(r"\.(md|markdown|txt)$"),
            "notes").otherwise("unknown")
    )
    return listing.select("path", kind.alias("kind"), F.when(kind == "unknown",
        "no rule fits").otherwise(F.concat(F.lit("looks like "), kind)).alias("reason"))


def name_scan(rows: DataFrame, names: DataFrame, block_names: int = BLOCK_NAMES) -> DataFrame:
    """(name, path, n, line): protected names in lines, bounded by what is no letter or digit; ``_``, ``-`` and
    blanks stand for each other.

    All names of a block are one automaton, which goes over every line once, in batches; only lines with a name leave a task.
    """
    spark = rows.sparkSession
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    wanted = names.select("name", plain(F.col("name")).alias("plain")).where("plain <> ''").distinct()
    held = rows.select("path", "n", "line", F.concat(F.lit(" "), plain(F.col("line")), F.lit(" ")).alias("plain"))
    small_batches(spark)
    schema = "name string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema if f.name != "plain")
    out = spark.createDataFrame([], schema)
    blocks = 1 + wanted.count() // block_names
    for i in range(blocks):
        some = wanted.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == i).collect()  # block_names of them, or so
        if some:
            out = out.unionByName(held.mapInArrow(_finder(spark.sparkContext.broadcast(automaton([(r["plain"], r["name"]) for r in some]))), schema))
    return out.distinct()


def automaton(named: list[tuple[str, str]]):
    """An automaton of plain names with a blank on each side; names of one plain form are found together."""
    import ahocorasick

    by: dict[str, list[str]] = {}
    for plain, name in named:
        by.setdefault(plain, []).append(name)
    made = ahocorasick.Automaton()
    for plain, held in by.items():
        made.add_word(f" {plain} ", held)
    made.make_automaton()
    return made


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = shared.value.iter
        for b in slices(batches):
            at, found = [], []
            for i, line in enumerate(b.column("plain").to_pylist()):
                for name in {n for _, held in search(line) for n in held} if line else ():
                    at.append(i)
                    found.append(name)
            if at:
                part = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(found), *(part.column(c) for c in ("path", "n", "line"))], ["name", "path", "n", "line"])

    return run


def protected_names(candidates: DataFrame, allowed: DataFrame, generic: tuple[str, ...] = (), least: int = 5) -> DataFrame:
    return candidates.select("name").distinct().where((F.length("name") >= least) & ~F.lower("name").isin([g.lower() for g in generic])).join(allowed.select("name"), "name", "left_anti")

"""Names of projects: aliases, and which project a path belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Folders that hold checkouts outside every root, and how many path parts lie between them and the project.
CONTAINERS = ((r"\.codex/worktrees", 1), ("codex_projects", 0))


def resolve(aliases: DataFrame, names: DataFrame) -> DataFrame:
    """(name, canonical, names): ``aliases`` is (alias, canonical); an unknown name stands for itself."""
    held = aliases.select(F.lower("alias").alias("_a"), "canonical").dropDuplicates(["_a"])
    of = aliases.groupBy("canonical").agg(F.collect_set("alias").alias("all"))
    got = names.select("name", F.lower("name").alias("_a")).join(held, "_a", "left").select("name",
        F.coalesce("canonical", "name").alias("canonical"))
    every = F.array_sort(F.array_distinct(F.concat(F.array("canonical"), F.coalesce("all", F.expr("cast(array() as array<string>)")))))
    return got.join(of, "canonical", "left").select("name", "canonical", every.alias("names"))


def project_of(paths: DataFrame, roots: list[str], is_file: bool = True) -> DataFrame:
    """(path, project): the first root in order that holds the path gives its first segment below.

    The root itself and files directly in it are loose.  Two container layouts count outside every root.
    """
    root = F.lit(None).cast("string")
    for r in reversed(roots):
        r = r.rstrip("/")
        root = F.when((F.col("path") == r) | F.col("path").startswith(r + "/"), F.lit(r)).otherwise(root)
    rest = F.substr("path", F.length("_root") + F.lit(2))
    deep = F.split(rest, "/")
    loose = (F.length(rest) == 0) | (F.lit(is_file) & (F.size(deep) == 1))
    container = F.coalesce(*(F.nullif(F.regexp_extract("path", rf"(?:^|/){name}/(?:[^/]+/){{{skip}}}([^/]+)(?:/|$)", 1), F.lit("")) for name,
        skip in CONTAINERS))
    return paths.withColumn("_root", root).select("path", F.when(F.col("_root").isNull(), container).when(loose,
        "_loose").otherwise(deep[0]).alias("project"))

"""Trees of text files: listing, admission, attribution, decoding."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from fnmatch import translate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".md", ".markdown")
TEXT_SUFFIXES = (*SUFFIXES, ".txt")


@dataclass
class Config:
    """Roots in order, and what is never read.  ``roots`` maps a label to a folder."""

    roots: dict[str, str] = field(default_factory=dict)
    exclude_dirs: tuple[str, ...] = ()
    exclude_files: tuple[str, ...] = ()
    never_index: tuple[str, ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)


def load_config(text: str) -> Config:
    """A YAML configuration.  A root's label is its folder's name; a name that is taken, or ``projects``, is
    qualified by its parent's."""
    import yaml

    raw = yaml.safe_load(text) or {}
    roots: dict[str, str] = {}
    for entry in raw.get("source_roots") or []:
        path = (entry["path"] if isinstance(entry, dict) else str(entry)).rstrip("/")
        *_, parent, name = ["", *path.split("/")]
        roots[f"{parent}-{name}" if name in roots or name == "projects" else name] = path
    return Config(roots, tuple(raw.get("exclude_dirs") or ()), tuple(raw.get("exclude_files") or ()), tuple(raw.get("never_index") or ()),
        dict(raw.get("historical_aliases") or {}))


def globs(names: tuple[str, ...]) -> str:
    """One pattern for shell globs over a whole name; none match nothing."""
    return "|".join(f"^(?:{translate(n)})" for n in names).replace(r"\Z", "$").replace(r"\z", "$") or r"(?!)"


def admitted(rel: Column, path: Column, config: Config, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Whether a file counts: its suffix in any case, no excluded folder above it, no excluded name, in no
    forbidden folder."""
    parts = F.split(rel, "/")
    name = F.element_at(parts, -1)
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | F.lower(name).endswith(s)
    banned = F.lit(False)
    for p in config.never_index:
        p = p.rstrip("/")
        banned = banned | (path == p) | path.startswith(p + "/")
    return ends & ~F.exists(dirs, lambda d: d.rlike(globs(config.exclude_dirs))) & ~name.rlike(globs(config.exclude_files)) & ~banned


def admit(path: Column, config: Config, banned_roots: tuple[str, ...] = (), suffixes: tuple[str, ...] = TEXT_SUFFIXES) -> Column:
    """Whether a path may be shown: inside a root, in no banned one, and admitted below that root.

    Paths that climb are refused; links are the business of whoever opens the file.
    """
    clean = F.regexp_replace(path, r"/(?:\./)*/*", "/")
    below = lambda root: clean.startswith(root.rstrip("/") + "/")
    rel = F.lit(None).cast("string")
    for root in reversed(list(config.roots.values())):
        rel = F.when(below(root), F.substr(clean, F.lit(len(root.rstrip("/")) + 2))).otherwise(rel)
    banned = F.lit(False)
    for root in banned_roots:
        banned = banned | below(root)
    climbs = F.array_contains(F.split(clean, "/"), "..")
    return F.coalesce(rel.isNotNull() & ~banned & ~climbs & admitted(rel, clean, config, suffixes), F.lit(False))


def plain_path(column: Column) -> Column:
    return F.regexp_replace(column, r"^file:/*", "/")


def metadata_path() -> Column:
    """The path of a row's file; the metadata column has it percent-encoded."""
    return F.url_decode(F.replace(plain_path(F.col("_metadata.file_path")), F.lit("+"), F.lit("%2B")))


@dataclass(frozen=True)
class Found:
    """A file of a listing; its time is in seconds, to the millisecond that Spark's readers tell."""

    path: str
    mtime: float
    size: int


def local(root: str) -> str | None:
    """The path of a root on this machine's own disk, if it is one."""
    scheme = re.match(r"([a-z][a-z0-9+.-]*):", root)
    return re.sub(r"^file:/*", "/", root) if not scheme or scheme[1] == "file" else None


def entries(spark: SparkSession, folder: str) -> Iterator[tuple[str, bool, Found]]:
    """(name, is folder, file) of what lies in a folder; links are left out, an unreadable folder is empty."""
    if (own := local(folder)) is not None:
        try:
            with os.scandir(own) as held:
                for e in sorted(held, key=lambda e: e.name):
                    if not e.is_symlink():
                        at = e.stat(follow_symlinks=False)
                        yield e.name, e.is_dir(follow_symlinks=False), Found(e.path, at.st_mtime_ns // 1_000_000 / 1000, at.st_size)
        except OSError:
            return
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    try:
        held = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    except Exception:  # noqa: BLE001  the file system's own errors: no access, no such folder
        return
    for f in held:
        if not f.isSymlink():
            yield f.getPath().getName(), f.isDirectory(), Found(f.getPath().toString(), f.getModificationTime() / 1000, f.getLen())


def walk(spark: SparkSession, root: str, config: Config = Config(), suffixes: tuple[str,
    ...] | None = None) -> Iterator[Found]:  # noqa: B008  never changed
    """Files below ``root`` that the configuration admits, of all suffixes if none are given.

    Excluded and forbidden folders are not listed, links are not followed, and no file is opened.
    """
    dirs, names = re.compile(globs(config.exclude_dirs)), re.compile(globs(config.exclude_files))
    banned = [p.rstrip("/") for p in config.never_index]
    forbidden = lambda path: any(path == p or path.startswith(p + "/") for p in banned)
    left = [root.rstrip("/")]
    while left:
        for name, is_dir, found in entries(spark, left.pop()):
            plain = local(found.path) or found.path
            if forbidden(plain):
                continue
            if is_dir and not dirs.match(name):
                left.append(found.path)
            elif not is_dir and not names.match(name) and (suffixes is None or name.lower().endswith(suffixes)):
                yield found


def listing(spark: SparkSession, root: str, config: Config = Config()) -> DataFrame:  # noqa: B008  never changed
    """(path, mtime, size) of every admitted file below ``root``; contents are not read."""
    return listed(spark, list(walk(spark, root, config)))


def listed(spark: SparkSession, found: list[Found]) -> DataFrame:
    return spark.createDataFrame([(f.path, f.mtime, f.size) for f in found], "path string, mtime double, size long")


def read_tree(spark: SparkSession, root: str, label: str, config: Config, suffixes: tuple[str, ...] = SUFFIXES,
    skip: Callable[[list[Found]], set[str]] | None = None) -> DataFrame:
    """(path, root, project, text, encoding_fallback, mtime, size) of the admitted files below ``root``.

    The tree is walked first, so only admitted files are opened; of these ``skip`` names those that need no read.
    """
    found = list(walk(spark, root, config, suffixes))
    done = skip(found) if skip else set()
    wanted = [f.path for f in found if f.path not in done]
    if not wanted:
        return spark.createDataFrame([], "path string, root string, project string, text string, encoding_fallback boolean, mtime double, size long")
    # a path's own characters are no glob
    raw = spark.read.format("binaryFile").load([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in wanted])
    rows = raw.select(plain_path(F.col("path")).alias("path"), F.col("modificationTime").alias("at"), F.col("length").alias("size"), "content")
    base = (local(root) or root).rstrip("/")
    parts = F.split(F.substr("path", F.lit(len(base) + 2)), "/")
    return rows.select("path", F.lit(label).alias("root"), F.when(F.size(parts) == 1, "_loose").otherwise(parts[0]).alias("project"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
        (~F.is_valid_utf8(F.col("content").cast("string"))).alias("encoding_fallback"), (F.unix_micros("at") / F.lit(1e6)).alias("mtime"), "size")


def lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, seq, value) of every line; ``seq`` sorts the lines of a file."""
    raw = spark.read.text(paths)
    raw = raw.select(metadata_path().alias("path"), F.struct(F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line")).alias("seq"), "value")
    return raw.where("trim(value) <> ''")

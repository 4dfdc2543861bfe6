"""Elements of JSON arrays in files of any size, by ranges of bytes.

Spark's text reader takes closing braces for line ends, so a file that is one line (or one array of gigabytes) comes as
ranges of short pieces, from any store that Spark reads, and no row holds more than what stands between two braces.  What a range
means depends on what comes before it: whether it begins inside a string, and how deep.  Three passes find that out:

1. each range tells how many quotes it has (odd or even) and how its depth changes, for both beginnings.  There is one small row for
   each range; added up over a file they give every range's own beginning;
2. files that are an object tell where the array under the wanted key begins and ends, one or two rows a range;
3. each range cuts its elements at the commas of that array.  An element that goes on in the next ranges leaves fragments, which
   are brought together by file; whole ones stay where they are.

An element that is no JSON is a failure of its own; so is a file whose brackets or strings don't close, that has something behind its
end, or that holds neither an array nor an object.  An element beyond Spark's limit of one value (128 MiB) fails alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.batching import slices, small_batches
from corpusloom.sources.files import metadata_path
from corpusloom.workdir import scratch_path

QUOTE, SLASH = 0x22, 0x5C
#: Change of depth by byte, and which bytes matter at all.
STEP = np.zeros(256, np.int8)
STEP[[ord("["), ord("{")]], STEP[[ord("]"), ord("}")]] = 1, -1
MATTERS = STEP != 0
MATTERS[[QUOTE, SLASH, ord(",")]] = True
BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\r\n\xef\xbb\xbf", np.uint8))


@dataclass
class State:
    """Where a range stands: inside a string or not, and how many brackets are open."""

    text: bool = False
    depth: int = 0

    def marks(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, bytes and depths (after each) of brackets and commas outside strings; the state moves behind ``raw``."""
        at = np.flatnonzero(MATTERS[raw])
        byte = raw[at]
        # a quote behind an odd run of backslashes is a character; no run is parted, since pieces end with a brace
        slash = at[byte == SLASH]
        quote = byte == QUOTE
        if len(slash):
            head = np.flatnonzero(np.append(True, np.diff(slash) > 1))
            size = np.diff(head, append=len(slash))
            quote &= ~np.isin(at, (slash[head] + size)[size % 2 == 1])
        inside = (np.cumsum(quote) + self.text) % 2 == 1
        held = ~inside & (byte != SLASH) & (byte != QUOTE)
        at, byte = at[held], byte[held]
        depth = self.depth + np.cumsum(STEP[byte], dtype=np.int64)
        self.text = bool(inside[-1]) if len(inside) else self.text
        self.depth = int(depth[-1]) if len(depth) else self.depth
        return at, byte, depth


@dataclass(frozen=True)
class Plan:
    """What is known of a file before it is cut: ranges' beginnings, whether a brace ends it, and the array's place."""

    begins: dict[int, tuple[bool, int]]
    closed: bool
    level: int  # depth inside the array; 0 if the object itself is the only element
    root: int  # the range in which the file's value begins
    start: tuple[int, int] = (0, 0)
    end: tuple[int, int] | None = None


def pieces(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, size, block, value): what stands between closing braces, in ranges that begin at ``block``."""
    read = spark.read.option("lineSep", "}").text(paths)
    return read.select(metadata_path().alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"))


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes, bool]]:
    """(path, size, block, bytes with their braces, whether they are the range's last), in order."""
    held = None
    for b in slices(batches):
        path, block = b.column("path").to_pylist(), b.column("block").to_pylist()
        cuts = [0, *(i for i in range(1, len(path)) if path[i] != path[i - 1] or block[i] != block[i - 1]), len(path)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            body = b"}".join(b.column("value").slice(a, z - a).to_pylist()) + b"}"
            now = path[a], b.column("size")[a].as_py(), block[a], body
            if held is not None:
                yield *held, held[:3] != now[:3]
            held = now
    if held is not None:
        yield *held, True


def measured(source: DataFrame) -> DataFrame:
    """(path, size, block, bytes, odd, plain, quoted, first): of each range its bytes, whether its quotes are odd, its change of depth
    if it begins outside or inside a string, and its first byte that is no blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, total, first = [State(), State(True)], 0, None
        for path, size, block, body, last in ranges(batches):
            raw = np.frombuffer(body, np.uint8)
            for s in states:
                s.marks(raw)
            if first is None and not BLANK[raw].all():
                first = int(raw[~BLANK[raw]][0])
            total += len(raw)
            if last:
                row = {"path": path, "size": size, "block": block, "bytes": total, "odd": states[0].text, "plain": states[0].depth, "quoted": states[1].depth, "first": first}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("path", pa.string()), ("size", pa.int64()), ("block", pa.int64()), ("bytes", pa.int64()), ("odd", pa.bool_()),
                    ("plain", pa.int64()), ("quoted", pa.int64()), ("first", pa.int32())]))
                states, total, first = [State(), State(True)], 0, None

    return source.mapInArrow(run, "path string, size long, block long, bytes long, odd boolean, plain long, quoted long, first int")


def planned(source: DataFrame, inner: str | None) -> tuple[dict[str, Plan], list[tuple[str, str]]]:
    """What each file's ranges are, and the files that are no JSON."""
    files: dict[str, list] = {}
    for r in measured(source).orderBy("path", "block").collect():  # a row for each range
        files.setdefault(r["path"], []).append(r)
    plans, bad = {}, []
    for path, held in files.items():
        text, depth, begins = False, 0, {}
        for r in held:
            begins[r["block"]] = text, depth
            text, depth = text ^ r["odd"], depth + (r["quoted"] if text else r["plain"])
        closed = sum(r["bytes"] for r in held) == held[0]["size"]  # else the last brace is ours
        first, root = next(((r["first"], r["block"]) for r in held if r["first"] is not None), (None, 0))
        if text or depth + (not closed) != 0 or first not in (ord("["), ord("{")):
            bad.append((path, "no JSON"))
        else:
            plans[path] = Plan(begins, closed, 1 if first == ord("[") else 0, root)
    objects = [p for p, plan in plans.items() if not plan.level] if inner else []
    if objects:
        found: dict[str, list] = {}
        for r in _found(source, {p: plans[p] for p in objects}, inner).collect():  # some rows a range
            found.setdefault(r["path"], []).append(((r["block"], r["at"]), r["opens"]))
        for path, marks in found.items():
            marks.sort()
            if (start := next((at for at, opens in marks if opens), None)) is not None:
                plans[path] = Plan(plans[path].begins, plans[path].closed, 2, plans[path].root, start, next(at for at, opens in marks if not opens and at > start))
    return plans, bad


def _found(source: DataFrame, plans: dict[str, Plan], inner: str) -> DataFrame:
    """(path, block, at, opens): where the array under ``inner`` begins in an object, and in each range where a member of the object
    first ends, or ends behind that."""
    key = re.compile(rb'"' + re.escape(inner.encode()) + rb'"\s*:\s*\[')

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, ended, state = 0, False, None
        for path, _, block, body, last in ranges(batches):
            if path not in plans:
                continue
            state = state or State(*plans[path].begins[block])
            at, byte, depth = state.marks(np.frombuffer(body, np.uint8))
            place = dict(zip(at.tolist(), depth.tolist(), strict=True))
            rows = [(m.end() - 1, True) for m in key.finditer(body) if place.get(m.end() - 1) == 2]
            ends = at[(depth == 1) & (STEP[byte] < 0)]
            for after in ([] if ended else [-1]) + [a for a, _ in rows]:
                if len(later := ends[ends > after]):
                    rows.append((int(later[0]), False))
                    ended = True
            if rows:
                yield pa.RecordBatch.from_pydict({"path": [path] * len(rows), "block": [block] * len(rows), "at": [before + a for a, _ in rows], "opens": [o for _, o in rows]})
            # an array that begins late in these bytes may end in the next
            ended = ended and not any(o and not len(ends[ends > a]) for a, o in rows)
            before += len(body)
            if last:
                before, ended, state = 0, False, None

    return source.mapInArrow(run, "path string, block long, at long, opens boolean")


def fragments(source: DataFrame, plans: dict[str, Plan]) -> DataFrame:
    """(path, block, n, begins, ends, value): elements by number within the range in which they begin; those that the range holds only
    part of have no beginning or no end in it.  What a file has besides its value has number -1."""
    types = pa.schema([("path", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("begins", pa.bool_()), ("ends", pa.bool_()), ("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = None
        for path, _, block, body, last in ranges(batches):
            plan = plans.get(path)
            if plan is None:
                continue
            cutter = cutter or Cutter(plan, block)
            if last and block == max(plan.begins) and not plan.closed:
                body = body[:-1]
            rows = list(cutter.cut(body, last))
            if last:
                cutter = None
            if rows:
                columns = [[path] * len(rows), [block] * len(rows), *zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.types, strict=True)], schema=types)

    return source.mapInArrow(run, "path string, block long, n long, begins boolean, ends boolean, value binary")


class Cutter:
    """Cuts the bytes of one range, which come in turn."""

    def __init__(self, plan: Plan, block: int) -> None:
        self.plan, self.block, self.state = plan, block, State(*plan.begins[block])
        self.before = self.n = 0
        #: bytes of the element that is open, whether it began in this range, and whether it is its array's first
        self.parts: list[bytes] = []
        self.begun = self.first = False
        self.roots = block > plan.root
        if plan.level == 2:
            self.open = plan.start[0] < block <= plan.end[0] and self.state.depth >= 2
        else:
            self.open = self.state.depth > 0

    def _within(self, at: np.ndarray) -> np.ndarray:
        """Which marks are in the array, its brackets included."""
        start, end = self.plan.start, self.plan.end
        if self.plan.level < 2 or start[0] < self.block < end[0]:
            return np.ones(len(at), bool)
        if not start[0] <= self.block <= end[0]:
            return np.zeros(len(at), bool)
        place = self.before + at
        return (place >= (start[1] if self.block == start[0] else 0)) & (place <= (end[1] if self.block == end[0] else self.before + at.max(initial=0)))

    def cut(self, body: bytes, last: bool) -> Iterator[tuple[int, bool, bool, bytes]]:
        """(n, begins, ends, value)"""
        level, was = self.plan.level, self.state.depth
        at, byte, depth = self.state.marks(np.frombuffer(body, np.uint8))
        step, outer = STEP[byte], max(level, 1)
        comma = (byte == ord(",")) & (depth == level) & (level > 0)
        cuts = self._within(at) & (comma | (step > 0) & (depth == outer) | (step < 0) & (depth == outer - 1))
        if level < 2 and (stray := self._stray(body, at, step, depth, was)):
            yield -1, True, True, stray
        done = 0
        for p, s in zip(at[cuts].tolist(), step[cuts].tolist(), strict=True):
            # an object that is the element itself keeps its brackets
            edge = p + 1 if level == 0 and s < 0 else p
            if self.open:
                value = b"".join([*self.parts, body[done:edge]])
                # an array without elements has blanks between its brackets
                if not (self.begun and self.first and s < 0 and not value.strip()):
                    yield self.n if self.begun else -2, self.begun, True, value
                    self.n += self.begun
            self.parts, done = [], p if level == 0 else p + 1
            self.open = self.begun = s >= 0
            self.first = s > 0
        if self.open:
            self.parts.append(body[done:])
        self.before += len(body)
        if last and self.open and self.parts:
            yield self.n if self.begun else -2, self.begun, False, b"".join(self.parts)

    def _stray(self, body: bytes, at: np.ndarray, step: np.ndarray, depth: np.ndarray, was: int) -> bytes:
        """What is outside all brackets and no blank; the brackets of a second value too."""
        roots = at[(step > 0) & (depth == 1)]
        spans = [(0, int(at[0]) if len(at) else len(body))] if was == 0 else []
        for c in at[(step < 0) & (depth == 0)].tolist():
            later = at[at > c]
            spans.append((c + 1, int(later[0]) if len(later) else len(body)))
        more = b"{" * (len(roots) > (0 if self.roots else 1))
        self.roots = self.roots or len(roots) > 0
        return (b"".join(body[a:z].strip(b" \t\r\n\xef\xbb\xbf") for a, z in spans) + more)[:200]


#: Parts a line of written fragments, and no JSON may hold it.
MARK = "\x1e"


def written(parts: DataFrame) -> DataFrame:
    """The fragments, written once and read back.  They are lines of text: a reader of columns would hold thousands of them at a time."""
    spark = parts.sparkSession
    path = scratch_path(spark, "elements")
    value = F.translate(F.col("value").cast("string"), MARK, "\0")
    head = F.to_json(F.struct("path", "block", "n", "begins", "ends"))
    parts.select(F.concat(head, F.lit("\t"), value).alias("value")).write.option("lineSep", MARK).text(path)
    line = spark.read.option("lineSep", MARK).text(path).withColumn("at", F.instr("value", "\t"))
    known = F.from_json(F.substring("value", F.lit(1), F.col("at") - 1), "path string, block long, n long, begins boolean, ends boolean")
    return line.select(known.alias("k"), F.substr("value", F.col("at") + 1).alias("value")).select("k.*", "value")


def elements(spark: SparkSession, paths: list[str] | str, inner: str | None = "conversations") -> tuple[DataFrame, DataFrame]:
    """((path, at, item), (path, at, problem)): the elements of each file's array, of the array ``inner`` of its object, or the object
    itself, by number; and what is no JSON, by number of the element, or -1 for a file."""
    small_batches(spark)
    source = pieces(spark, paths)
    plans, bad = planned(source, inner)
    cut = written(fragments(source, plans))
    # fragments of elements that several ranges hold: each goes with the last beginning before it
    torn = cut.where("n <> -1 and not (begins and ends)")
    order = Window.partitionBy("path").orderBy("block", F.col("begins").cast("int"))
    parts = torn.withColumn("owner", F.max(F.when(F.col("begins"), F.struct("block", "n"))).over(order))
    joined = parts.groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "value"))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: x["value"]), "")
    every = cut.where("n >= 0 and begins and ends").select("path", "block", "n", "value").unionByName(joined.select("path", "owner.block", "owner.n", whole.alias("value")))
    begun = cut.where("n >= 0 and begins").groupBy("path", "block").agg(F.count("*").alias("n"))
    before = begun.select("path", "block", (F.sum("n").over(Window.partitionBy("path").orderBy("block")) - F.col("n")).alias("before"))  # a row for each range
    parsed = every.join(F.broadcast(before), ["path", "block"]).select("path", (F.col("before") + F.col("n")).cast("int").alias("at"),
        F.try_parse_json("value").alias("item"))
    files = spark.createDataFrame([(p, -1, why) for p, why in bad], "path string, at int, problem string")
    stray = cut.where("n = -1").select("path", F.lit(-1).alias("at"), F.lit("no JSON").alias("problem")).distinct()
    broken = parsed.where("item is null").select("path", "at", F.lit("no JSON").alias("problem"))
    return parsed.where("item is not null"), files.unionByName(stray).unionByName(broken)

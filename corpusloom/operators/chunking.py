"""Texts to overlapping chunks: plain windows, and Markdown sections packed to a size.

Both are state machines over one text, so they run over Arrow batches; everything after is relational.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.batching import slices, small_batches
from corpusloom.model import MERGED_CHARS, MIN_CHUNK_CHARS, OVERLAP_CHARS, TARGET_CHARS

HEADING = re.compile(r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")


def plain_pieces(text: str, size: int = TARGET_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    """Windows of ``size``: cut at the last line feed if that lies in the second half, and start the next
    ``overlap`` before the cut."""
    out, rest = [], text
    while rest.strip():
        if len(rest) <= size:
            out.append(rest.strip())
            break
        cut = rest.rfind("\n", 0, size)
        cut = size if cut < size // 2 else cut
        if piece := rest[:cut].strip():
            out.append(piece)
        rest = rest[max(cut - overlap, 1) :]
    return out


def sections(text: str) -> list[tuple[str, str]]:
    """(heading path, section with its heading line)."""
    out: list[tuple[str, list[str]]] = [("", [])]
    stack: list[str] = []
    for line in text.splitlines():
        if m := HEADING.match(line):
            level = len(m[1])
            stack = [*stack[: level - 1], *[""] * (level - 1 - len(stack)), m[2]]
            out.append((" > ".join(s for s in stack if s), [line]))
        else:
            out[-1][1].append(line)
    return [(p, "\n".join(lines)) for p, lines in out if any(x.strip() for x in lines)]


def split_large(body: str, size: int) -> list[str]:
    """A body over ``size`` by paragraphs, then by lines, then by characters."""
    for mark in ("\n\n", "\n"):
        if mark in body.strip():
            out, held = [], ""
            for part in body.split(mark):
                if held and len(held) + len(mark) + len(part) > size:
                    out.append(held)
                    held = part
                else:
                    held = f"{held}{mark}{part}" if held else part
            out.append(held)
            return [x for part in out for x in (split_large(part, size) if len(part) > size and part != body else [part])]
    return [body[i : i + size] for i in range(0, len(body), size)]


def markdown_pieces(text: str, size: int = TARGET_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    packed: list[tuple[str, str]] = []
    path, held = "", ""
    for where, body in sections(text):
        if len(body) > size:
            if held:
                packed.append((path, held))
                held = ""
            packed += [(where, piece) for piece in split_large(body, size)]
        elif held and len(held) + 1 + len(body) <= size:
            held += "\n" + body
        else:
            if held:
                packed.append((path, held))
            path, held = where, body
    if held:
        packed.append((path, held))
    merged: list[tuple[str, str]] = []
    for where, body in packed:
        if merged and min(len(body), len(merged[-1][1])) < MIN_CHUNK_CHARS and len(body) + len(merged[-1][1]) + 1 <= MERGED_CHARS:
            merged[-1] = (merged[-1][0] or where, f"{merged[-1][1]}\n{body}")
        else:
            merged.append((where, body))
    out, before = [], ""
    for where, body in merged:
        body = body.strip()
        if not body:
            continue
        payload = f"{before[-overlap:].lstrip()}\n\n{body}" if before else body
        if where and not body.startswith("#"):
            payload = f"[{where}]\n{payload}"
        out.append(payload)
        before = body
    return out


def chunked(docs: DataFrame, key: str = "path", pieces: Callable[[str], list[str]] = plain_pieces, kind: str = "prose", first: int = 0) -> DataFrame:
    """(key, ord, kind, text, content_hash) of every piece of every text."""
    types = docs.schema[key].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys, ords, texts = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = pieces(t) if t else []
                keys += [k] * len(got)
                ords += range(first, first + len(got))
                texts += got
            hashes = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(ords, pa.int32()), pa.array([kind] * len(keys)),
                pa.array(texts, pa.string()), pa.array(hashes, pa.string())], [key, "ord", "kind", "text", "content_hash"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {types}, ord int, kind string, text string, content_hash string")

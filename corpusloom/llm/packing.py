"""Packing: concatenate documents' token ids and cut them into windows of fixed length.

Pass 1 encodes each document once and writes its ids with the token count before it in its input
partition.  A prefix sum over the partitions' totals (one row for each) turns these into global
offsets.  Pass 2 cuts each document at the multiples of the window: a piece that touches a window's
edge is a boundary record, and pieces of one ``sequence_id`` in order of ``offset`` are the sequence.
No row moves between tasks; a document of any length is cut where it lies.

Null texts count as empty, and every document has at least its end id.  Equal rows are packed once
each.  An empty table gives no pieces.  Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow_rows import batch, slices, small_batches
from corpusloom.llm.token_ids import shared_ids
from corpusloom.workdir import materialize

SEQUENCE_TOKENS = 4096
TOKENIZER = "word_bpe_49k.json"
DOCUMENT_END = 2

ENCODED = {"doc_id": pa.int64(), "part": pa.int32(), "before": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}
PIECE = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(),
    "sequence_id": pa.int64(), "offset": pa.int64(), "ids": pa.binary()}


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int | None = DOCUMENT_END) -> DataFrame:
    """(doc_id, part, before, n_tokens, ids): ids as little-endian integers, 2 bytes each if every id fits."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = shared_ids(tokenizer)
        end = np.array([] if end_id is None else [end_id], ids_of.dtype)
        part, before = TaskContext.get().partitionId(), 0
        for b in slices(batches):
            found = [np.concatenate([ids, end]) for ids in ids_of.of(b.column("text").to_pylist())]
            n = np.array([len(x) for x in found])
            ends = before + np.cumsum(n)
            yield batch({"doc_id": b.column("doc_id"), "part": np.full(len(n), part), "before": ends - n, "n_tokens": n,
                "ids": [x.tobytes() for x in found]}, ENCODED)
            before = int(ends[-1])
        ids_of.forget()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, part int, before long, n_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = DOCUMENT_END, sequence_tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """One row for each piece of a document in a sequence, with its ids (``ids``, 4 bytes each, little-endian)."""
    encoded = materialize(encode(docs, tokenizer, end_id), "packing")
    return cut(encoded, id_bytes(tokenizer), sequence_tokens)


def id_bytes(tokenizer: str) -> int:
    return shared_ids(tokenizer).dtype.itemsize


def cut(encoded: DataFrame, width: int, sequence_tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    bases, total = {}, 0
    for part, n in sorted(map(tuple, encoded.groupBy("part").agg(F.sum("n_tokens")).collect())):  # a row for each input partition
        bases[part], total = total, total + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: dict[str, list] = {k: [] for k in PIECE}
            for doc, part, before, n, raw in zip(*(b.column(k).to_pylist() for k in ENCODED), strict=True):
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                base = bases[part] + before
                for window in range(base // sequence_tokens, (base + n - 1) // sequence_tokens + 1):
                    a = max(base, window * sequence_tokens) - base
                    z = min(base + n, (window + 1) * sequence_tokens) - base
                    piece = ids[a:z].tobytes()
                    for k, v in zip(PIECE, (doc, a, z - a, zlib.crc32(piece), n, window, base + a - window * sequence_tokens, piece), strict=True):
                        out[k].append(v)
            yield batch(out, PIECE)

    return encoded.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) from pieces; a group holds at most one window of tokens."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = pieces.groupBy("sequence_id").agg(ordered.alias("p"))
    return joined.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"),
        F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))

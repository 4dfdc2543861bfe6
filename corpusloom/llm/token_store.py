"""Token ids in sorted-string-table shards.

A shard is one file, written and read by Spark alone, so it lies in whatever store the path names:

    magic
    blocks      zstd; entries in key order, each: shared u16, own u16, tokens u32, key[shared:], ids
    index       one entry a block: first key, offset, length, entries, tokens of the shard before it
    filter      Bloom filter over the keys
    footer      fixed length: where index and filter are, counts, shard order, checksum, magic

Keys are a byte that tells null from not null and the identifier as 8 big-endian bytes with the sign
turned, so byte order is identifier order, and neighbours share long prefixes.  A shard lies in a folder whose
name tells its place in the order, its first and last key, its entries and its tokens, so a listing of the
folders is the manifest: ``start`` of every shard and the shards that could hold a key are known before
a byte is read.  A lookup opens these alone, tests the filter, bisects the index and opens one block.

Null texts count as empty and null identifiers sort first.  Rows that repeat an identifier are all kept,
in order of their text's hash, and are dealt into shards by it, so a frequent identifier is spread.  An empty
table gives no shard, and reading that gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.arrow_rows import batch, slices, small_batches
from corpusloom.llm.token_ids import shared_ids

MAGIC = b"CLSSTAB1"
TOKENIZER = "word_bpe_49k.json"
DOCUMENT_END = 1
BLOCK_BYTES = 64 * 1024
SHARD_BYTES = 32 * 1024 * 1024
#: A shard's folder is named so, with what ``Manifest`` reads.
FOLDER = "shard"
FILTER_BITS, FILTER_HASHES = 10, 7
ENTRY = struct.Struct("<HHI")
INDEX = struct.Struct("<9sQIIQ")
#: index at, filter at, filter bits, entries, tokens, partition, number in it, id width, checksum, magic
FOOTER = struct.Struct("<QQQQQIIII8s")
ROW = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + 2**63)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - 2**63 if key[0] else None


def filter_places(keys: list[bytes], bits: int) -> np.ndarray:
    """Bit numbers of each key: two mixes of its 8 bytes, stepped."""
    x = np.frombuffer(b"".join(k[1:] for k in keys), ">u8").astype(np.uint64) + np.array([k[0] for k in keys], np.uint64)
    mixed = []
    for salt in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        y = (x ^ (x >> np.uint64(31))) * np.uint64(salt)
        y = (y ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed.append(y ^ (y >> np.uint64(32)))
    return (mixed[0][:, None] + np.arange(FILTER_HASHES, dtype=np.uint64) * (mixed[1] | np.uint64(1))[:, None]) % np.uint64(bits)


class ShardWriter:
    def __init__(self, width: int, part: int, number: int, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> None:
        self.width, self.part, self.number = width, part, number
        self.shard_bytes, self.block_bytes = shard_bytes, block_bytes
        self.body, self.size = [MAGIC], len(MAGIC)
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.tokens = 0
        self.squeeze = zstandard.ZstdCompressor(level=1)
        self._begin()

    def _begin(self) -> None:
        self.block, self.block_size, self.first, self.last, self.count, self.ahead = [], 0, b"", b"", 0, self.tokens

    def add(self, key: bytes, ids: bytes) -> None:
        shared = next((i for i, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), len(self.last))
        self.first = self.first or key
        n = len(ids) // self.width
        self.block += [ENTRY.pack(shared, len(key) - shared, n), key[shared:], ids]
        self.block_size += len(ids) + 16
        self.last, self.count, self.tokens = key, self.count + 1, self.tokens + n
        self.keys.append(key)
        if self.block_size >= self.block_bytes:
            self._end_block()

    def _end_block(self) -> None:
        if self.count:
            raw = self.squeeze.compress(b"".join(self.block))
            self.index.append(INDEX.pack(self.first, self.size, len(raw), self.count, self.ahead))
            self.body.append(raw)
            self.size += len(raw)
        self._begin()

    def full(self) -> bool:
        return self.size >= self.shard_bytes

    def name(self) -> str:
        """What the shard's folder tells; see ``Manifest``."""
        return "-".join(["shard", str(self.part), str(self.number), self.keys[0].hex(), self.keys[-1].hex(), str(len(self.keys)), str(self.tokens)])

    def finish(self) -> bytes:
        self._end_block()
        index = b"".join(self.index)
        bits = max(64, FILTER_BITS * len(self.keys)) // 8 * 8
        marked = np.zeros(bits, np.uint8)
        marked[filter_places(self.keys, bits)] = 1
        bloom = np.packbits(marked).tobytes()
        footer = FOOTER.pack(self.size, self.size + len(index), bits, len(self.keys), self.tokens, self.part, self.number, self.width,
            zlib.crc32(index + bloom), MAGIC)
        return b"".join([*self.body, index, bloom, footer])


class Shard:
    """A shard's bytes, opened."""

    def __init__(self, data: bytes) -> None:
        self.data = memoryview(data)
        # The writer ends each file with one line feed.
        at = len(data) - FOOTER.size - (data[-9:-1] == MAGIC and data[-1:] == b"\n")
        self.index_at, self.filter_at, self.bits, self.entries, self.tokens, self.part, self.number, self.width, check, magic = FOOTER.unpack_from(data, at)
        if magic != MAGIC or data[: len(MAGIC)] != MAGIC or zlib.crc32(self.data[self.index_at : at]) != check:
            raise ValueError("not a whole shard")
        self.index = list(INDEX.iter_unpack(self.data[self.index_at : self.filter_at]))
        self.open = zstandard.ZstdDecompressor()

    def block(self, number: int) -> Iterator[tuple[bytes, int, bytes]]:
        """(key, tokens of the shard before it, ids as stored) of one block."""
        _, at, size, count, before = self.index[number]
        raw = self.open.decompress(self.data[at : at + size], max_output_size=2**31 - 1)
        key, at = b"", 0
        for _ in range(count):
            shared, own, n = ENTRY.unpack_from(raw, at)
            at += ENTRY.size
            key = key[:shared] + raw[at : at + own]
            at += own
            yield key, before, raw[at : at + n * self.width]
            at += n * self.width
            before += n

    def __iter__(self) -> Iterator[tuple[bytes, int, bytes]]:
        for number in range(len(self.index)):
            yield from self.block(number)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row of this identifier; opens no block the filter and the index rule out."""
        key = key_of(doc_id)
        places = filter_places([key], self.bits)[0]
        bloom = np.frombuffer(self.data[self.filter_at : self.filter_at + self.bits // 8], np.uint8)
        if not ((bloom[places >> np.uint64(3)] >> (np.uint64(7) - (places & np.uint64(7))).astype(np.uint8)) & 1).all():
            return []
        found = []
        keys = [x[0] for x in self.index]
        number = max(0, bisect_right(keys, key) - 1)
        while number > 0 and keys[number] == key:
            number -= 1  # equal keys may begin in the block before
        for k in range(number, len(keys)):
            if keys[k] > key:
                break
            found += [np.frombuffer(ids, f"<u{self.width}").astype(np.uint32) for own, _, ids in self.block(k) if own == key]
        return found


class Manifest:
    """The shards below a path in order of their keys, from the names of their folders."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        home = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = home.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(home)
        names = [f.getPath().getName().removeprefix(f"{FOLDER}=") for f in found if f.isDirectory() and f.getPath().getName().startswith(f"{FOLDER}=")]
        shards = sorted((int(part), int(number), bytes.fromhex(first), bytes.fromhex(last), int(tokens), name) for name in names for _, part, number,
            first, last, _, tokens in [name.split("-")])
        self.names = [s[5] for s in shards]
        self.first, self.last = [s[2] for s in shards], [s[3] for s in shards]
        ends = np.cumsum([s[4] for s in shards], dtype=np.int64)
        #: ids of all documents before a shard, by part and number
        self.before = {(s[0], s[1]): int(e) - s[4] for s, e in zip(shards, ends, strict=True)}

    def holding(self, keys: list[bytes]) -> list[str]:
        """Names of the shards whose range holds one of the keys; ranges of neighbours may share a key."""
        found = set()
        for key in keys:
            found |= set(range(bisect_left(self.last, key), bisect_right(self.first, key)))
        return [self.names[i] for i in sorted(found)]


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int | None = DOCUMENT_END, shard_bytes: int = SHARD_BYTES,
    block_bytes: int = BLOCK_BYTES) -> None:
    """Write the shards of ``docs`` (doc_id, text) below ``path``."""
    small_batches(docs.sparkSession)
    types = {FOLDER: pa.string(), "data": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = shared_ids(tokenizer)
        end = b"" if end_id is None else np.array([end_id], ids_of.dtype).tobytes()
        part, number, shard = TaskContext.get().partitionId(), 0, None
        for b in slices(batches):
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), ids_of.of(b.column("text").to_pylist()), strict=True):
                shard = shard or ShardWriter(ids_of.dtype.itemsize, part, number, shard_bytes, block_bytes)
                shard.add(key_of(doc_id), ids.tobytes() + end)
                if shard.full():
                    yield batch({FOLDER: [shard.name()], "data": [shard.finish()]}, types)
                    number, shard = number + 1, None
        if shard:
            yield batch({FOLDER: [shard.name()], "data": [shard.finish()]}, types)
        ids_of.forget()

    mark = F.xxhash64("text")
    # the text's hash and a row's number split what shares an identifier
    ordered = docs.select("doc_id", "text", mark.alias("_mark"), F.monotonically_increasing_id().alias("_row")).repartitionByRange("doc_id", "_mark",
        "_row").sortWithinPartitions("doc_id", "_mark")
    shards = ordered.select("doc_id", "text").mapInArrow(run, f"{FOLDER} string, data binary").withColumn("data", F.col("data").cast("string"))
    shards.write.partitionBy(FOLDER).text(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(content, shard) of every file; a condition on ``shard`` leaves the other files unread."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content", F.col(FOLDER).cast("string").alias(FOLDER))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all shards; ids are little-endian, 4 bytes each.

    ``start`` counts the ids of all documents before it.  The driver holds a name for each shard, as it
    holds a listing of files.
    """
    before = Manifest(spark, path).before

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            shard = Shard(b.column("content")[0].as_py())
            base = before[shard.part, shard.number]
            for number in range(len(shard.index)):
                rows = list(shard.block(number))
                ids = [np.frombuffer(x, f"<u{shard.width}").astype("<u4") for _, _, x in rows]
                yield batch({"doc_id": [id_of(k) for k, _, _ in rows], "start": [base + s for _, s, _ in rows], "n_tokens": [len(x) for x in ids],
                    "ids": [x.tobytes() for x in ids]}, ROW)

    schema = "doc_id long, start long, n_tokens long, ids binary"
    return files(spark, path).select("content").mapInArrow(run, schema) if before else spark.createDataFrame([], schema)


def lookup(spark: SparkSession, path: str, doc_ids: list[int | None]) -> DataFrame:
    """(doc_id, ids) of some identifiers: only shards whose range holds one are read, and answer from their
    filter, their index and few blocks."""
    wanted = list(doc_ids)
    names = Manifest(spark, path).holding([key_of(d) for d in wanted])
    if not names:
        return spark.createDataFrame([], "doc_id long, ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            shard = Shard(b.column("content")[0].as_py())
            found = [(d, x.astype("<u4").tobytes()) for d in wanted for x in shard.get(d)]
            yield batch({"doc_id": [d for d, _ in found], "ids": [x for _, x in found]}, {"doc_id": pa.int64(), "ids": pa.binary()})

    return files(spark, path).where(F.col(FOLDER).isin(names)).select("content").mapInArrow(run, "doc_id long, ids binary")

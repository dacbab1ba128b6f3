"""Operator 10: token ids in sorted-string-table shards.

A shard holds documents in ascending key order. Layout: data blocks (each compressed; in it, keys are
prefix-compressed against the key before), one Bloom filter over ids, one sparse index with the first key
of each block, and a fixed footer that says where those two are. A lookup reads the footer, asks the
filter, bisects the index and scans one block.

Keys are 13 bytes: 1 for an id or 0 for null, the id with its sign bit turned, big-endian, and a running
number among rows of the same id, so byte order is id order and repeated ids keep all their rows. Values
are the ids, two bytes each where they all fit, else four. Defined cases: null text counts as empty (the
end id alone); null ids sort first; an empty table gives no shards and no rows; further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import fresh_path, saved, small_batches
from .tokens import default_path, encoder

MAGIC = b"MSSTAB01"
FOOTER = struct.Struct("<QQQQQQ13s13sI8s")
BLOCK_BYTES = 1 << 16
MANIFEST = "path string, first_key binary, last_key binary, n_docs long, n_ids long"
_SIGN = 1 << 63


def make_key(doc_id: int | None, nth: int) -> bytes:
    return struct.pack(">BQI", doc_id is not None, 0 if doc_id is None else (doc_id + _SIGN), nth)


def key_id(key: bytes) -> int | None:
    has, value, _ = struct.unpack(">BQI", key)
    return value - _SIGN if has else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _pack_ids(ids: bytes) -> bytes:
    wide = np.frombuffer(ids, "<u4")
    return b"\2" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else b"\4" + ids


def _unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u2" if value[0] == 2 else "<u4", offset=1).astype("<u4")


def _probes(key: bytes, bits: int, n: int = 7) -> list[int]:
    a, b = zlib.crc32(key[:9]), zlib.crc32(key[:9], 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(n)]


class ShardWriter:
    """Writes keys, which must ascend, to an open binary file."""

    def __init__(self, file) -> None:
        self.file, self.at = file, 0
        self.block, self.block_first, self.last = bytearray(), b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.ids: set[bytes] = set()
        self.first_key, self.n_docs, self.n_ids = b"", 0, 0
        self.codec = zstandard.ZstdCompressor(level=1)

    def _put(self, data: bytes) -> tuple[int, int]:
        self.file.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def add(self, key: bytes, ids: bytes) -> None:
        if key <= self.last:
            raise ValueError("keys must ascend")
        if not self.block:
            self.block_first, before = key, b""
        else:
            before = self.last
        shared = 0
        while shared < len(before) and before[shared] == key[shared]:
            shared += 1
        value = _pack_ids(ids)
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.first_key, self.last = self.first_key or key, key
        self.ids.add(key[:9])
        self.n_docs, self.n_ids = self.n_docs + 1, self.n_ids + len(ids) // 4
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.index.append((self.block_first, *self._put(self.codec.compress(bytes(self.block)))))
            self.block = bytearray()

    def finish(self) -> None:
        self._flush()
        bits = max(64, 10 * len(self.ids))
        filter_ = np.zeros(bits, bool)
        for key in self.ids:
            filter_[_probes(key, bits)] = True
        bloom = struct.pack("<Q", bits) + np.packbits(filter_).tobytes()
        bloom_at = self._put(bloom)
        index = b"".join(struct.pack("<13sQQ", *x) for x in self.index)
        index_at = self._put(index)
        self._put(FOOTER.pack(*index_at, *bloom_at, self.n_docs, self.n_ids, self.first_key, self.last, zlib.crc32(bloom + index), MAGIC))


class ShardReader:
    """Random and sequential access to one shard."""

    def __init__(self, path: str) -> None:
        store, inner = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(inner)
        self.file.seek(self.file.size() - FOOTER.size)
        index_at, index_n, bloom_at, bloom_n, self.n_docs, self.n_ids, self.first_key, self.last_key, crc, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        bloom, index = self._at(bloom_at, bloom_n), self._at(index_at, index_n)
        if magic != MAGIC or zlib.crc32(bloom + index) != crc:
            raise ValueError(f"{path} is not a whole shard")
        self.bits = struct.unpack_from("<Q", bloom)[0]
        self.bloom = bloom[8:]
        self.index = list(struct.iter_unpack("<13sQQ", index))
        self.codec = zstandard.ZstdDecompressor()

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, nth: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, n = self.index[nth]
        data, at, key = self.codec.decompress(self._at(at, n)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            yield key, _unpack_ids(data[at + own : at + own + size])
            at += own + size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for nth in range(len(self.index)):
            yield from self._block(nth)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with this id; empty if there is none."""
        low, high = make_key(doc_id, 0), make_key(doc_id, 0xFFFFFFFF)
        if not all(self.bloom[p >> 3] & 128 >> (p & 7) for p in _probes(low, self.bits)):
            return []
        firsts, out = [x[0] for x in self.index], []
        for nth in range(max(0, bisect_right(firsts, low) - 1), bisect_right(firsts, high)):
            out += [ids for key, ids in self._block(nth) if low <= key <= high]
        return out

    def close(self) -> None:
        self.file.close()


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` and write shards into ``folder`` (a URI); returns the manifest, a row a shard.

    Rows are range-partitioned on the id (and, among equal ids, the text), so shard follows shard in id
    order. A file's name holds the task attempt; only files of attempts that succeeded are in the manifest,
    so lost executors and retries leave no wrong shard in it.
    """
    small_batches(docs.sparkSession)
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = ordered.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, shard, out, path, last, nth, store = TaskContext.get(), None, None, "", (), 0, None
        for batch in batches:
            encoded = encoder(tokenizer).encode(batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                if shard is None:
                    path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.sst"
                    store, inner = fs.FileSystem.from_uri(path)
                    store.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(inner)
                    shard = ShardWriter(out)
                nth = nth + 1 if last == (doc_id,) else 0
                last = (doc_id,)
                shard.add(make_key(doc_id, nth), ids + end)
        if shard is not None:
            shard.finish()
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "first_key": shard.first_key, "last_key": shard.last, "n_docs": shard.n_docs, "n_ids": shard.n_ids}], _schema(MANIFEST))

    return saved(ordered.select("doc_id", "text").mapInArrow(write, MANIFEST), "sst-manifest")


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all rows before), ids (little-endian unsigned 32-bit): every row of every shard, read from the files."""
    shards, start = [], 0
    for row in sorted(manifest.collect(), key=lambda r: (bytes(r["first_key"]), bytes(r["last_key"]), r["path"])):  # one small row a file
        shards.append((row["path"], start))
        start += row["n_ids"]
    todo = spark.createDataFrame(shards, "path string, start long").repartition(max(1, len(shards)))
    fields = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard, at, rows = ShardReader(row["path"]), row["start"], []
                for key, ids in shard:
                    rows.append({"doc_id": key_id(key), "start": at, "ids": ids.tobytes()})
                    at += len(ids)
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, fields)
                        rows = []
                shard.close()
                yield pa.RecordBatch.from_pylist(rows, fields)

    return todo.mapInArrow(read, "doc_id long, start long, ids binary")


def token_shards(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as shards in the shared folder and read the files back."""
    manifest = write_shards(docs, fresh_path(spark, "sst"), tokenizer or default_path(), end_id)
    return read_shards(spark, manifest)


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    back = token_shards(spark, docs.select("doc_id", "text"))
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))

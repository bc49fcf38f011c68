"""Token ids in files: fixed-width bit packing with block offsets.

A shard file is a row of records, each followed by one line feed:

    block   BLOCK_IDS ids (the last: the rest), `bits` bits each, least significant bit first
    index   per document its id (int64), then its start in the shard (uint64), then a null flag (one byte);
            after all documents the byte offset of each block (uint64)
    tail    TAIL below: magic, version, bits, ids a block, documents, ids, blocks, offset of the index,
            ids of the same task's shards before

A task ends a shard, and so a file, with the document that brings it to FILE_BYTES, and begins another. Its last
file is a ledger: per shard its documents and ids (uint64 each), then a tail with the magic of ledgers and the sums.
Ids flow on from one document to the next and from block to block; bits is the least that the
vocabulary fits in. All blocks but the last are equally long, whole bytes, so any span of ids is read
by unpacking the few blocks that it touches. The files are written by Spark's text writer, one row a file, which
adds the last line feed, commits whole tasks only, and reaches every file system that Spark does. Beside them a
Parquet manifest, worked out from the ledgers alone, says where each shard begins among all ids.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratamem.llm import common, packing

END_ID = 2
#: Ids a block; a multiple of eight, so that a block is whole bytes at every width.
BLOCK_IDS = 1 << 16
#: Bytes of text a task, about (its ids take half to two thirds).
SHARD_BYTES = 1 << 26
#: Bytes at which a shard ends with its document. A writer holds a shard at a time; a reader those of one Arrow batch, which
#: by Spark's default has 64 MB or one row. Both are held in several copies on the way between Spark and Python.
FILE_BYTES = 1 << 23
MAGIC = b"STRATIDS"
LEDGER = b"STRATLGR"
#: Larger files are not looked into for ledgers; 65,000 shards a task fit.
LEDGER_MOST = 1 << 20
VERSION = 2
TAIL = "<8sHHIQQQQQ"
TAIL_BYTES = struct.calcsize(TAIL)
#: Texts that come to a writer at once; by Spark's default 10,000 or 64 MB do, and both sides hold two batches for a while.
_TEXTS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Ids that a reader hands on at once, about.
_STEP = 1 << 18
_READ = "doc_id long, start long, n_tokens long, ids binary"


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """ids (below 2^bits) at `bits` bits each, the last byte filled up with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    lanes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(lanes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_ids(packed: bytes | memoryview, count: int, bits: int) -> np.ndarray:
    """The first `count` ids of what pack_ids made, as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(packed, f"<u{bits // 8}", count).astype("<u4")
    lanes = np.unpackbits(np.frombuffer(packed, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (lanes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


class Shard:
    """Random access to one shard file's bytes."""

    def __init__(self, content: bytes | memoryview):
        self.content = memoryview(content)
        magic, version, self.bits, self.block_ids, self.n_docs, self.n_ids, n_blocks, at, self.before = struct.unpack_from(TAIL, self.content, len(self.content) - TAIL_BYTES - 1)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of token ids")
        self.doc_ids = np.frombuffer(self.content, "<i8", self.n_docs, at)
        self.starts = np.frombuffer(self.content, "<u8", self.n_docs, at + 8 * self.n_docs)
        self.nulls = np.frombuffer(self.content, np.uint8, self.n_docs, at + 16 * self.n_docs)
        self.offsets = np.frombuffer(self.content, "<u8", n_blocks, at + 17 * self.n_docs)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop (exclusive) of the shard; only the blocks that hold them are unpacked."""
        if start >= stop:
            return np.empty(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        counts = [min(self.block_ids, self.n_ids - b * self.block_ids) for b in range(first, last + 1)]
        parts = [unpack_ids(self.content[int(self.offsets[b]) : int(self.offsets[b]) + -(-n * self.bits // 8)], n, self.bits) for b, n in zip(range(first, last + 1), counts, strict=True)]
        joined = parts[0] if len(parts) == 1 else np.concatenate(parts)
        return joined[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the shard."""
        stop = int(self.starts[k + 1]) if k + 1 < self.n_docs else self.n_ids
        return self.ids(int(self.starts[k]), stop)

    def batches(self, first_id: int) -> Iterator[pa.RecordBatch]:
        """All documents in order, starts counted from first_id."""
        bounds = np.append(self.starts, self.n_ids).astype(np.int64)
        a = 0
        while a < self.n_docs:
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + _STEP, "right")) - 1)
            ids, edges = self.ids(int(bounds[a]), int(bounds[b])), bounds[a : b + 1]
            cells = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(((edges - edges[0]) * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
            doc_ids = pa.array(self.doc_ids[a:b], pa.int64(), mask=self.nulls[a:b].astype(bool))
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(edges[:-1] + first_id), pa.array(np.diff(edges)), cells], ["doc_id", "start", "n_tokens", "ids"])
            a = b


class _Writer:
    """Cuts a stream of documents into the records of one shard; before: ids of the task's earlier shards."""

    def __init__(self, bits: int, before: int = 0):
        self.bits, self.before, self.at, self.n_ids = bits, before, 0, 0
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        self.offsets: list[int] = []

    def file_bytes(self) -> int:
        """What the shard takes if it ends here, about."""
        return self.n_ids * self.bits // 8 + 17 * len(self.sizes)

    def _record(self, body: bytes) -> bytes:
        self.at += len(body) + 1
        return body

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[bytes]:
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= BLOCK_IDS:
            joined = np.concatenate(self.waiting)
            cut = self.n_waiting - self.n_waiting % BLOCK_IDS
            for k in range(0, cut, BLOCK_IDS):
                yield self._block(joined[k : k + BLOCK_IDS])
            self.waiting, self.n_waiting = [joined[cut:]], self.n_waiting - cut

    def _block(self, ids: np.ndarray) -> bytes:
        self.offsets.append(self.at)
        return self._record(pack_ids(ids, self.bits))

    def close(self) -> Iterator[bytes]:
        if self.n_waiting:
            yield self._block(np.concatenate(self.waiting))
        sizes, index_at = np.array(self.sizes, np.uint64), self.at
        starts = np.cumsum(sizes) - sizes
        nulls = np.array([x is None for x in self.doc_ids], np.uint8)
        ids = np.array([x or 0 for x in self.doc_ids], "<i8")
        yield self._record(ids.tobytes() + starts.astype("<u8").tobytes() + nulls.tobytes() + np.array(self.offsets, "<u8").tobytes())
        yield self._record(struct.pack(TAIL, MAGIC, VERSION, self.bits, BLOCK_IDS, len(ids), self.n_ids, len(self.offsets), index_at, self.before))


def _ledger(shards: list[tuple[int, int]], bits: int) -> bytes:
    """The last file of a task, of its shards' documents and ids."""
    counts = np.array(shards, "<u8")
    body = counts.tobytes() + struct.pack(TAIL, LEDGER, VERSION, bits, BLOCK_IDS, *counts.sum(axis=0).tolist(), len(shards), 0, 0)
    if len(body) >= LEDGER_MOST:
        raise ValueError(f"{len(shards)} shards in one task; SHARD_BYTES is too large for FILE_BYTES")
    return body


def width(tokenizer: str) -> int:
    """The bits that every id of a tokenizer's vocabulary, and the end id, fit in."""
    from tokenizers import Tokenizer

    return max(END_ID, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()).bit_length()


@lru_cache(maxsize=1)
def _encoder(path: str) -> packing.Encoder:
    """One encoder a worker process, so that words seen by one task are known to the next; its memory is bounded."""
    return packing.Encoder(path)


def write_ids(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Writes the ids of all texts of docs (doc_id, text) below path: shard files in `ids`, and `manifest`.

    Documents go in ascending doc_id, null first; rows that share an id by a hash of the text, then by place, so
    that a third of all rows may have one id and still go to many shards. A null text counts as empty; each
    document ends with END_ID, so none is without ids. Rows equal in all are all written. Other columns of docs,
    whatever their names, are left out. An empty table makes an empty manifest.

    Texts are shuffled once, in ranges; a task encodes its range in order and hands on a shard at a time. It
    holds a shard's bytes, one batch of texts and one document's ids, besides the words that the encoder remembers.
    """
    spark = docs.sparkSession
    bits, file_bytes = width(tokenizer), FILE_BYTES
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(-(-total // SHARD_BYTES), spark.sparkContext.defaultParallelism)
    order = ("doc_id", "tie", "place")
    placed = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = _encoder(tokenizer), _Writer(bits)
        end = END_ID.to_bytes(4, "little")
        body: list[bytes] = []
        shards: list[tuple[int, int]] = []
        put = lambda x: pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], ["record"])

        def shard() -> pa.RecordBatch:
            body.extend(writer.close())
            shards.append((len(writer.sizes), writer.n_ids))
            found = put(b"\n".join(body))
            body.clear()
            return found

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                body.extend(writer.add(doc_id.as_py(), np.frombuffer(encoder(text.as_py()) + end, "<u4")))
                if writer.file_bytes() >= file_bytes:
                    yield shard()
                    writer = _Writer(bits, writer.before + writer.n_ids)
        if writer.sizes:
            yield shard()
        if shards:
            yield put(_ledger(shards, bits))

    had = spark.conf.get(_BATCH_CONF)
    spark.conf.set(_BATCH_CONF, _TEXTS)
    try:
        # the cast takes the bytes as they are, and the text writer puts them into the file unchanged
        ordered.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(f"{path}/ids", compression="none")
    finally:
        spark.conf.set(_BATCH_CONF, had)
    _ledgers(spark, path).write.parquet(f"{path}/manifest")


def _files(spark: SparkSession, path: str | list[str], below: int | None = None) -> DataFrame:
    """path, content and task (whose ids go on in the order of the tasks' numbers) of files; of larger ones than `below` nothing is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    if below:
        found = found.where(F.col("length") < below)
    return found.select("path", "content", F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long").alias("task"))


def _ledgers(spark: SparkSession, path: str) -> DataFrame:
    """The manifest: task, bits, shard (counted in its task), file, n_docs, n_ids, first_id; one row a shard.

    Tasks are numbered on by a window over their few rows, one for SHARD_BYTES of text.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task, name, content in zip(batch.column("task").to_pylist(), batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                _, _, bits, _, _, n_ids, n_shards, *_ = struct.unpack_from(TAIL, content, len(content) - TAIL_BYTES - 1)
                counts = np.frombuffer(content, "<u8", 2 * n_shards).reshape(-1, 2).astype(np.int64)
                before = np.cumsum(counts[:, 1]) - counts[:, 1]
                # the text writer counts a task's files
                named = [re.sub(r"-c\d+(?=[^-/]*$)", f"-c{k:03d}", name) for k in range(n_shards)]
                parts = [dict(zip(("shard", "file", "n_docs", "n_ids", "before"), x, strict=True)) for x in zip(range(n_shards), named, *counts.T.tolist(), before.tolist(), strict=True)]
                yield pa.RecordBatch.from_pylist([{"task": task, "bits": bits, "all_ids": n_ids, "parts": parts}], schema=made)

    part = pa.struct([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("before", pa.int64())])
    made = pa.schema([("task", pa.int64()), ("bits", pa.int64()), ("all_ids", pa.int64()), ("parts", pa.list_(part))])
    found = _files(spark, f"{path}/ids", LEDGER_MOST).where(F.substring("content", -TAIL_BYTES - 1, len(LEDGER)) == F.lit(LEDGER))
    tasks = found.mapInArrow(read, "task long, bits long, all_ids long, parts array<struct<shard:int,file:string,n_docs:bigint,n_ids:bigint,before:bigint>>")
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    placed = tasks.select("task", "bits", F.coalesce(F.sum("all_ids").over(before), F.lit(0)).alias("first"), "parts")
    return placed.select("task", "bits", "first", F.inline("parts")).select("task", "bits", "shard", "file", "n_docs", "n_ids", (F.col("first") + F.col("before")).alias("first_id"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) of what write_ids wrote."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoder.cache_clear()  # a reader has no use for the words that a writer left in this worker
        for batch in batches:
            for first_id, content in zip(batch.column("first_id"), batch.column("content"), strict=True):
                held = memoryview(content.as_buffer())
                if bytes(held[-TAIL_BYTES - 1 :][: len(LEDGER)]) != LEDGER:
                    shard = Shard(held)
                    yield from shard.batches(first_id.as_py() + shard.before)

    # 16 bytes for each 64 MB of text: 25 MB at 100 TB
    firsts = F.broadcast(spark.read.parquet(f"{path}/manifest").where("shard = 0").select("task", "first_id"))
    return _files(spark, f"{path}/ids").join(firsts, "task").select("first_id", "content").mapInArrow(read, _READ)


def read_span(spark: SparkSession, path: str, start: int, stop: int) -> np.ndarray:
    """Ids start to stop (exclusive) among all ids: the files that hold them are opened, the blocks that hold them unpacked."""
    held = spark.read.parquet(f"{path}/manifest").where((F.col("first_id") < stop) & (F.col("first_id") + F.col("n_ids") > start))
    found = {x["file"]: x for x in held.collect()}
    parts = {}
    if start < stop and found:
        for x in _files(spark, list(found)).toLocalIterator():
            first = found[x["path"]]["first_id"]
            shard = Shard(x["content"])
            parts[first] = shard.ids(max(0, start - first), min(shard.n_ids, stop - first))
    return np.concatenate([parts[k] for k in sorted(parts)]) if parts else np.empty(0, "<u4")


def op12_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_ids(common.documents(spark, sf_dir), packing.production_tokenizer(), path)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

"""Token files of byte or bit planes.

Documents stand in ascending doc_id order over shards; a shard is a run of
chunks, a chunk holds whole documents. A chunk's ids are cut into blocks of
fixed size; each block of 32-bit ids is transposed into 4 byte planes (or 32
bit planes) and every plane is compressed by zstandard on its own, so the
planes of high bytes all but vanish. The chunk index says where each plane
lies and how many ids each document has; the manifest says where each shard
starts in the corpus. Files are Parquet rows with the planes as binary
payload, so any store that Spark writes to holds them.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean, ranges, shared_dir, slices
from .tokens import SLICE, encode_ended, vocabulary, worker_encoder

END_ID = 0
BLOCK = 1 << 16
CHUNK = 1 << 18
CHUNK_SCHEMA = "shard int, chunk int, first long, n_ids long, doc_ids array<long>, doc_lengths array<long>, planes string, plane_ends array<long>, payload binary"


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """A block of unsigned 32-bit ids as 4 byte planes or 32 bit planes, lowest first."""
    by = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(by[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(by, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids again: to_planes(ids, kind) for either kind."""
    if len(planes) == 4:
        by = np.stack([np.frombuffer(p, np.uint8) for p in planes], 1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], 1)
        by = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(by).view("<u4").ravel()[:n]


def pack_ids(ids: np.ndarray, kind: str = "byte", block: int = BLOCK, level: int = 3) -> tuple[list[int], bytes]:
    """Where each compressed plane ends, and the planes of all blocks."""
    squeeze = zstandard.ZstdCompressor(level=level)
    out = [squeeze.compress(p) for a in range(0, len(ids), block) for p in to_planes(ids[a : a + block], kind)]
    return np.cumsum([len(x) for x in out]).tolist(), b"".join(out)


def unpack_ids(ends: list[int], payload: bytes, n: int, kind: str = "byte", block: int = BLOCK) -> np.ndarray:
    open_, per = zstandard.ZstdDecompressor(), 4 if kind == "byte" else 32
    planes = [open_.decompress(payload[a:b]) for a, b in zip([0, *ends], ends)]
    parts = [from_planes(planes[k * per : (k + 1) * per], min(block, n - k * block)) for k in range(len(planes) // per)]
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def write_token_files(docs: DataFrame, to: str, path: str | None = None, end_id: int = END_ID, kind: str = "byte", block: int = BLOCK, chunk: int = CHUNK) -> None:
    """Writes {to}/chunks and {to}/manifest.

    Null texts are empty; a null doc_id comes before all others; repeated rows
    stand next to each other, ordered by text. Other columns do not matter.
    """
    path = path or vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, k, done = worker_encoder(path), TaskContext.get().partitionId(), 0, 0
        held, held_ids, size = [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            ends, payload = pack_ids(ids, kind, block)
            row = [[shard], [k], [done], [len(ids)], [held_ids], [[len(x) for x in held]], [kind], [ends], [payload]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], [x.split()[0] for x in CHUNK_SCHEMA.split(", ")])

        for batch in slices(batches, size=SLICE):
            ids, bounds = encode_ended(encoder, batch.column(1), end_id)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                held.append(ids[bounds[i] : bounds[i + 1]])
                held_ids.append(doc)
                size += len(held[-1])
                if size >= chunk:
                    yield close()
                    k, done, size = k + 1, done + size, 0
                    held, held_ids = [], []
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(ranges(docs.sparkSession), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(lean(encode), CHUNK_SCHEMA).write.mode("overwrite").parquet(f"{to}/chunks")
    chunks = docs.sparkSession.read.schema(CHUNK_SCHEMA).parquet(f"{to}/chunks")
    sizes = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"), F.count("*").alias("n_chunks"))  # a row per shard
    base = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes.withColumn("base", base).write.mode("overwrite").parquet(f"{to}/manifest")


def read_token_files(spark: SparkSession, to: str, block: int = BLOCK, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; with its ids if asked for."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = unpack_ids(r["plane_ends"], r["payload"], r["n_ids"], r["planes"], block)
                ends = np.cumsum(r["doc_lengths"])
                parts = [found[b - n : b] for b, n in zip(ends, r["doc_lengths"], strict=True)]
                columns = [pa.array(r["doc_ids"], pa.int64()), pa.array(r["base"] + r["first"] + ends - r["doc_lengths"], pa.int64()), pa.array(r["doc_lengths"], pa.int64()), pa.array([zlib.crc32(np.ascontiguousarray(x)) for x in parts], pa.int64())]
                if ids:
                    columns.append(pa.array([x.tolist() for x in parts], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{to}/chunks")
    manifest = spark.read.schema("shard int, n_ids long, n_chunks long, base long").parquet(f"{to}/manifest")
    return chunks.join(F.broadcast(manifest.select("shard", "base")), "shard").mapInArrow(lean(decode), schema)  # a manifest row per shard


def token_files(docs: DataFrame, to: str | None = None, **how) -> DataFrame:
    """Writes the files (to a new folder of the shared one unless told) and reads them back."""
    spark = docs.sparkSession
    to = to or f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, to, **how)
    return read_token_files(spark, to, how.get("block", BLOCK))

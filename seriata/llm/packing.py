"""Best-fit packing planned on a histogram of lengths.

Only counts by length reach the driver: at most max_tokens numbers, whatever
the corpus. Best fit in order of decreasing length runs over those counts, all
pieces of one length at a time, and writes a plan of ranges: pieces of a
length with ranks a..b take a place in sequences s.., at an offset. Pieces then
find their places by joining on length and rank.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean, ragged, slices, written
from .tokens import CACHE, SLICE, Encoder, encode_ended, vocabulary, worker_encoder

MAX_TOKENS = 1024
END_ID = 2


def best_fit_plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, n, first sequence, offset) rows: best fit of decreasing lengths, as piece by piece.

    n pieces of consecutive ranks go to n consecutive sequences at one offset.
    """
    open_: dict[int, list[list[int]]] = {}  # room left: ranges [first sequence, n]
    plan, made = [], 0
    for length in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                room, fits = size, size // length
                first, n = made, max(1, left // fits)
                made += n
            else:
                fits = room // length
                first, held = open_[room].pop()
                n = min(held, max(1, left // fits))
                if n < held:
                    open_[room].append([first + n, held - n])
                if not open_[room]:
                    del open_[room]
            each = min(fits, left)
            for k in range(each):
                plan.append((length, rank, n, first, size - room + k * length))
                rank += n
            left -= n * each
            if rest := room - each * length:
                open_.setdefault(rest, []).append([first, n])
    return plan


def pieces(docs: DataFrame, path: str | None = None, end_id: int = END_ID, max_tokens: int = MAX_TOKENS, keep_ids: bool = False, cache_bytes: int = CACHE, slice_bytes: int = SLICE, keep_encoder: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), with the task that cut it and its rank there among equal lengths."""
    path = path or vocabulary()
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, local_rank long" + (", ids array<int>" if keep_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, task = (worker_encoder if keep_encoder else Encoder)(path, cache_bytes), Counter(), TaskContext.get().partitionId()
        for batch in slices(batches, size=slice_bytes):
            ids, bounds = encode_ended(encoder, batch.column(1), end_id)
            total = np.diff(bounds)
            n = -(-total // max_tokens)
            doc = np.repeat(np.arange(len(total)), n)
            piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            head = total - (n - 1) * max_tokens  # the first piece is the short one
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * max_tokens)
            length = np.where(piece == 0, head[doc], max_tokens)
            at = bounds[doc] + start
            ranks = np.empty(len(doc), np.int64)
            for i, x in enumerate(length.tolist()):
                ranks[i] = seen[x]
                seen[x] += 1
            crcs = [zlib.crc32(ids[a : a + m]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crcs, pa.int64()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(ranks)]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(ids.astype(np.int32)[ragged(at, length)])))
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(cut), schema)


def pack(docs: DataFrame, path: str | None = None, end_id: int = END_ID, max_tokens: int = MAX_TOKENS, keep_ids: bool = False, cache_bytes: int = CACHE, slice_bytes: int = SLICE, keep_encoder: bool = True) -> DataFrame:
    """Each piece of every document with its sequence_id and offset there (and its ids if asked for).

    A document is its ids and end_id. One of at most max_tokens is one piece;
    a longer one is cut into pieces of max_tokens of which the first may be
    shorter. Null and empty texts are end_id alone. Repeated rows are packed
    as often as they stand; a null doc_id stays null. Sequences are gapless
    from offset 0. Other columns of docs do not matter. Workers keep their
    encoder for the next task unless told not to.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, path, end_id, max_tokens, keep_ids, cache_bytes, slice_bytes, keep_encoder))
    by_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most max_tokens rows
    plan = spark.createDataFrame(best_fit_plan(counts, max_tokens), "length int, first_rank long, n long, first_sequence long, offset int")
    ranked = cut.join(before.drop("n"), ["task", "length"]).withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("local_rank"))
    # The plan's size depends on max_tokens alone, not on the number of pieces.
    placed = ranked.join(F.broadcast(plan), (ranked.length == plan.length) & (ranked["rank"] >= plan.first_rank) & (ranked["rank"] < plan.first_rank + plan.n))
    sequence = plan.first_sequence + ranked["rank"] - plan.first_rank
    return placed.select(ranked.doc_id, ranked.piece, ranked.start, ranked.length.cast("long").alias("length"), ranked.ids_crc32, sequence.alias("sequence_id"), plan["offset"].cast("long").alias("offset"), *(["ids"] if keep_ids else []))

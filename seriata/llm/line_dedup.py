"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

Every line long enough to count has a 128-bit key. The exact table holds, per
key, how many lines refer to it and the smallest and largest document that do.
A key is *shared* when those two differ. Per shard of the key space a cuckoo
filter holds the shared keys; documents look their lines up there first, and
only lines that may be shared meet the exact table. Inserting documents adds
references and new shared keys; deleting documents takes references away,
deletes keys that are no longer shared from the filters and finds the next
smallest holder again, so dedup stays reversible.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, durable, lean, ranges, slices

SLOTS = 4
MIN_CHARS = 10
WHITE = b" \t\n\x0b\x0c\r"


# ---------------------------------------------------------------- cuckoo filter
class CuckooFilter:
    """A cuckoo filter over unsigned 64-bit keys, 4 slots a bucket, 16-bit fingerprints.

    Vectorised: keys go in by rounds; in each round every bucket takes what it
    has room for and the rest go to their other bucket or push one key out.
    It doubles when a round limit is reached, which needs the keys again, so
    the caller keeps them (the exact table does).
    """

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, n) / SLOTS / 0.6 + 1)))))

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        f = cls.sized(len(keys))
        while not f.insert(keys):
            f = cls(f.buckets * 2)
        return f

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        t = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(t), t)

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = keys.astype(np.uint64)
        print_ = (keys >> np.uint64(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        first = (keys & np.uint64(self.buckets - 1)).astype(np.int64)
        return print_, first, self._other(first, print_)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return bucket ^ ((print_.astype(np.int64) * 0x5BD1E995) & (self.buckets - 1))

    def insert(self, keys: np.ndarray, rounds: int = 400) -> bool:
        """Whether all keys went in."""
        print_, at, _ = self._places(keys)
        for turn in range(rounds):
            if not len(print_):
                return True
            order = np.argsort(at, kind="stable")
            print_, at = print_[order], at[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            free = self.table[at] == 0
            slot = np.argmax(np.cumsum(free, 1) == (rank + 1)[:, None], 1)
            fits = free.sum(1) > rank
            self.table[at[fits], slot[fits]] = print_[fits]
            print_, at, rank = print_[~fits], at[~fits], rank[~fits]
            if turn % 2:  # both buckets were full: the first of each bucket pushes a key out
                _, pick = np.unique(at, return_index=True)
                victim = (turn // 2 + pick) % SLOTS
                print_[pick], self.table[at[pick], victim] = self.table[at[pick], victim].copy(), print_[pick].copy()
            at = self._other(at, print_)
        return not len(print_)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        print_, a, b = self._places(keys)
        return ((self.table[a] == print_[:, None]) | (self.table[b] == print_[:, None])).any(1)

    def delete(self, keys: np.ndarray) -> None:
        """Takes one copy of each key's fingerprint out; the keys must have been inserted."""
        for p, a, b in zip(*self._places(keys), strict=True):
            for bucket in (a, b):
                where = np.flatnonzero(self.table[bucket] == p)
                if len(where):
                    self.table[bucket, where[0]] = 0
                    break


# ---------------------------------------------------------------- lines
def _lines(raw: bytes) -> list[bytes]:
    return raw.translate(LOWER).split(b"\n")


def _chars(key: bytes) -> int:
    return len(key) if len(key) >= 4 * MIN_CHARS else len(key.decode("utf-8", "replace"))


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        docs, version, hi, lo = [], [], [], []
        for doc, raw in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
            if doc is None:
                continue
            mark = None
            for line in _lines(raw):
                key = line.strip(WHITE)
                if len(key) >= MIN_CHARS and _chars(key) >= MIN_CHARS:
                    d = hashlib.blake2b(key, digest_size=16).digest()
                    mark = mark or int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)
                    docs.append(doc)
                    version.append(mark)
                    hi.append(d[:8])
                    lo.append(d[8:])
        wide = lambda parts: pa.array(np.frombuffer(b"".join(parts), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(version, pa.int64()), wide(hi), wide(lo)], ["doc_id", "version", "hi", "lo"])


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, version, hi, lo, shard): the key of every long enough line; version tells texts of one doc_id apart."""
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(_occurrences), "doc_id long, version long, hi long, lo long")
    return found.withColumn("shard", _shard(docs))


def _shard(df: DataFrame):
    return F.pmod(F.shiftright("hi", 20), F.lit(ranges(df.sparkSession, 4))).cast("int")


# ---------------------------------------------------------------- the store
@dataclass
class LineStore:
    """postings: a row per counted line; refs: a row per key; filters: a cuckoo filter per shard, of shared keys."""

    postings: DataFrame
    refs: DataFrame
    filters: DataFrame

    @classmethod
    def empty(cls, spark) -> LineStore:
        return cls(*(spark.createDataFrame([], s) for s in ("doc_id long, version long, hi long, lo long, shard int", "shard int, hi long, lo long, refs long, first_doc long, last_doc long", "shard int, held long, bits binary")))

    def insert(self, docs: DataFrame) -> LineStore:
        """The store with the documents' lines added."""
        new = occurrences(docs)
        counted = _count(new)
        fresh = self.refs.isEmpty()
        refs = durable(counted if fresh else self.refs.unionByName(counted).groupBy("shard", "hi", "lo").agg(F.sum("refs").alias("refs"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc")))
        if fresh:
            return LineStore(new, refs, _build(refs))
        postings = durable(self.postings.unionByName(new))
        return LineStore(postings, refs, _revise(self.filters, self.refs, refs))

    def delete(self, docs: DataFrame) -> LineStore:
        """The store without the documents whose doc_id is given."""
        gone = docs.select("doc_id").distinct()
        postings = durable(self.postings.join(gone, "doc_id", "left_anti"))
        lost = self.postings.join(gone, "doc_id", "left_semi").groupBy("shard", "hi", "lo").agg(F.count("*").alias("lost"))
        same = self.refs.join(lost, ["shard", "hi", "lo"], "left_anti")
        touched = _count(postings.join(lost, ["shard", "hi", "lo"], "left_semi"))
        refs = durable(same.unionByName(touched))
        return LineStore(postings, refs, _revise(self.filters, self.refs, refs))

    def drops(self) -> DataFrame:
        """(doc_id, version, keys): the keys whose lines the document loses, as one binary string of 16-byte keys."""
        filters, refs = self.filters, self.refs
        # A shard with a very common key has far more lines than others: it is dealt over several groups, each with the filter.
        load = refs.groupBy("shard").agg(F.sum("refs").alias("lines"))
        mean = (refs.agg(F.sum("refs")).first()[0] or 0) / ranges(refs.sparkSession, 4) + 1
        parts = filters.join(F.broadcast(load.select("shard", F.ceil(F.col("lines") / (2 * mean)).cast("int").alias("parts"))), "shard")
        spread = F.broadcast(parts.select("shard", "parts"))
        left = self.postings.join(spread, "shard").withColumn("part", F.pmod(F.xxhash64("doc_id", "hi"), F.col("parts")).cast("int")).select("shard", "part", "doc_id", "version", "hi", "lo")
        right = parts.select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "bits")
        maybe = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInPandas(_probe, "doc_id long, version long, hi long, lo long")
        shared = refs.where("first_doc < last_doc").select("hi", "lo", "first_doc")
        hit = maybe.join(shared, ["hi", "lo"]).where("doc_id > first_doc")
        key = F.concat(*(F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("hi", "lo")))
        return hit.select("doc_id", "version", key.alias("key")).groupBy("doc_id", "version").agg(F.array_join(F.transform(F.collect_set("key"), F.hex), "").alias("keys"))


def _count(rows: DataFrame) -> DataFrame:
    return rows.groupBy("shard", "hi", "lo").agg(F.count("*").alias("refs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def _build(refs: DataFrame) -> DataFrame:
    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf.lo.to_numpy().view(np.uint64)
        return pd.DataFrame({"shard": [key[0]], "held": [len(keys)], "bits": [CuckooFilter.of(keys).dump()]})

    return durable(refs.where("first_doc < last_doc").select("shard", "lo").groupBy("shard").applyInPandas(build, "shard int, held long, bits binary"))


def _revise(filters: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Filters after the change from the old to the new table: keys newly shared go in, those no longer shared come out."""
    was, now = (x.where("first_doc < last_doc").select("shard", "hi", "lo") for x in (old, new))
    both = was.withColumn("sign", F.lit(-1)).unionByName(now.withColumn("sign", F.lit(1))).groupBy("shard", "hi", "lo").agg(F.sum("sign").alias("sign"), F.count("*").alias("n"))

    def revise(key: tuple, held: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        low, sign = keys.lo.to_numpy().view(np.uint64), keys.sign.to_numpy()
        f = CuckooFilter.load(held.bits.iloc[0]) if len(held) else CuckooFilter.sized(1)
        f.delete(low[sign < 0])
        stay = low[sign >= 0]
        if len(stay) > 0.8 * SLOTS * f.buckets or not f.insert(low[sign > 0]):
            f = CuckooFilter.of(stay)
        return pd.DataFrame({"shard": [key[0]], "held": [len(stay)], "bits": [f.dump()]})

    return durable(filters.groupBy("shard").cogroup(both.select("shard", "lo", "sign").groupBy("shard")).applyInPandas(revise, "shard int, held long, bits binary"))


def _probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    keep = left[["doc_id", "version", "hi", "lo"]]
    if not len(right) or not len(left):
        return keep.iloc[:0]
    return keep[CuckooFilter.load(right.bits.iloc[0]).contains(keep.lo.to_numpy().view(np.uint64))]


# ---------------------------------------------------------------- applying it
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds n_lines, n_dropped and the kept text to rows of any columns with text and keys."""
    for batch in slices(batches, "text"):
        n_lines, n_dropped, kept = [], [], []
        for raw, keys in zip(_texts(batch.column("text")), batch.column("keys").to_pylist(), strict=True):
            lines = raw.split(b"\n")
            n_lines.append(len(lines))
            if keys:
                gone = {bytes.fromhex(keys[i : i + 32]) for i in range(0, len(keys), 32)}
                lower = _lines(raw)
                lines = [x for x, low in zip(lines, lower, strict=True) if not ((k := low.strip(WHITE)) and _digest(k) in gone)]
            n_dropped.append(n_lines[-1] - len(lines))
            kept.append(b"\n".join(lines).decode("utf-8", "replace"))
        out = [batch.column(i) for i, name in enumerate(batch.schema.names) if name not in ("text", "keys")]
        names = [name for name in batch.schema.names if name not in ("text", "keys")]
        yield pa.RecordBatch.from_arrays([*out, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], [*names, "n_lines", "n_dropped", "kept_text"])


def _digest(key: bytes) -> bytes:
    d = hashlib.blake2b(key, digest_size=16).digest()
    return d[:8][::-1] + d[8:][::-1]  # as hex() of the little-endian halves prints them


def _version(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        marks = [int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True) for raw in _texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.int64())], [*batch.schema.names, "version"])


def dedup_lines(docs: DataFrame, store: LineStore | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for every row of docs.

    A line's key is the line without the white space at both its ends, A-Z in
    lower case. A key of at least MIN_CHARS code points that two different
    doc_ids hold keeps its lines only in the smallest of them, all of them
    there. Null and empty texts have one empty line. Rows that repeat a doc_id
    count as one document; each keeps its own text. A null doc_id neither holds
    nor loses lines. Very long texts are read whole, one at a time; without rows
    there are none in the result. Other columns of docs do not matter.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    store = store or LineStore.empty(spark).insert(docs)
    marked = docs.mapInArrow(lean(_version), "doc_id long, text string, version long")
    joined = marked.join(store.drops(), ["doc_id", "version"], "left").select("doc_id", "text", "keys")
    return joined.mapInArrow(lean(_cut), "doc_id long, n_lines long, n_dropped long, kept_text string")


def rewrite_documents(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs with the text that dedup_lines keeps (a null one stays null), and n_chars as its length.

    Other columns go along in one struct, so their names cannot clash with those
    used here. Otherwise as dedup_lines.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    store = LineStore.empty(docs.sparkSession).insert(own)
    others = [f for f in docs.schema if f.name != "text"]
    kept = [T.StructField("row", T.StructType(others), False), T.StructField("doc_id", T.LongType()), T.StructField("was_null", T.BooleanType()), T.StructField("text", T.StringType()), T.StructField("version", T.LongType())]
    marked = docs.select(F.struct(*(F.col(f"`{f.name}`") for f in others)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").isNull().alias("was_null"), F.col("text").cast("string").alias("text"))
    marked = marked.mapInArrow(lean(_version), T.StructType(kept)).join(store.drops(), ["doc_id", "version"], "left").select("row", "was_null", "text", "keys")
    cut = marked.mapInArrow(lean(_cut), T.StructType([kept[0], kept[2], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())]))
    text = F.when(~F.col("was_null"), F.col("kept_text"))
    now = {"text": text, "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*(now.get(c, F.col(f"row.`{c}`") if c != "text" else text).alias(c) for c in docs.columns))

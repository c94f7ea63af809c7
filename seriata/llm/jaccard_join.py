"""Exact Jaccard join of word shingles with set-relation skipping.

Equal sets are one node. Shingles are ordered from rare to frequent (how many
texts hold a shingle is counted over the whole corpus; the frequent ones are
told to all workers, a bounded table), and each node puts the shingles of its
prefix into an inverted index: two linked nodes share one.

Skipping works on two levels. In the index, a list is cut into blocks of like
positions, in each of which sizes ascend; a block whose sizes and remainders
cannot reach the overlap with an entry is skipped whole, before any of its
entries is looked at. Between sets, answers are derived from those of a similar
set: in a list of more than SHORT entries every entry is at first only compared
with the list's pivot, the entry whose rare shingles are fewest. Whatever links
to the pivot has the pivot's component; only entries whose component still
differs from the pivot's meet the rest of their list, and only entries of other
components there. Long lists are dealt out in both steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, durable, lean, mix64, ragged, ranges, slices, trim, written

SHORT = 4
FREQUENT = 48
MOST_FREQUENT = 4_000_000
CELL_BITS = 40
SUBLIST = 4096
#: Blocks of positions in a list, and how many blocks are looked at in one step.
BLOCKS = 64
MOST_BLOCKS = 1 << 20
#: Odd multipliers of a word's place in its shingle.
_PLACES = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


# ---------------------------------------------------------------- shingles
def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Each text's sorted set of shingle hashes: words in lower case (A-Z), parted by ASCII white space."""
    n = len(texts)
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if not n:
        return []
    offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4)
    raw = texts.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if texts.buffers()[2] is not None else b""
    offsets = offsets - offsets[0]
    lower = pa.StringArray.from_buffers(n, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(raw.translate(LOWER)))
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(lower))
    coded = lists.values.dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names), np.uint64, len(names))[coded.indices.to_numpy()] if names else np.zeros(0, np.uint64)
    empty = np.array([x == "" for x in names], bool)[coded.indices.to_numpy()] if "" in names else None
    bounds = lists.offsets.to_numpy()
    sums = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        sums += hashes[k : len(hashes) - words + 1 + k] * _PLACES[k]
    sums = mix64(sums)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(sums[a : b - words + 1]))
        elif empty is not None and empty[a:b].any() or a == b:
            out.append(np.zeros(0, np.uint64))
        else:
            out.append(mix64((hashes[a:b] * _PLACES[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
    return out


def set_id(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
    return int(d[0]), int(d[1])


@dataclass(frozen=True)
class Names:
    """64-bit names of sets: the first half of their 128 bits, or the second half where two sets of the corpus share the first."""

    bits: int = 64
    clashes: frozenset[int] = frozenset()

    def first(self, half: int) -> int:
        return half >> (64 - self.bits)

    def of(self, s: np.ndarray) -> int:
        a, b = set_id(s)
        return b if self.first(a) in self.clashes else self.first(a)


def _distinct(batches: Iterator[pa.RecordBatch], words: int, names: Names) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(name, set) of the different sets that are not empty, per batch of rows: copies are put together before any shuffle."""
    for batch in batches:
        seen: dict[int, None] = {}
        for part in slices(iter([batch]), 0):
            found = []
            for s in shingle_sets(part.column(0), words):
                if len(s) and (i := names.of(s)) not in seen:
                    seen[i] = None
                    found.append((i, s))
            if found:
                yield found


# ---------------------------------------------------------------- how frequent shingles are
def _planes(x: np.ndarray) -> bytes:
    """Unsigned 64-bit integers, byte plane after byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unplanes(raw: bytes) -> np.ndarray:
    by = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(by.T).view("<u8").ravel().astype(np.uint64)


def _cuts(sorted_: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Where the parts of a space of so many bits begin in ascending numbers; one bound more than parts."""
    edges = np.array([(k << bits) // parts for k in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_, edges), [len(sorted_)]])


READ = "doc_id long, n_shingles long, node long, node_hi long, part int, cells binary, n binary"


def read_sets(docs: DataFrame, words: int, bits: int = 64) -> DataFrame:
    """All texts read once, written: a row per document (doc_id, n_shingles, node, node_hi), and rows that count cells of shingles (part, cells, n).

    Cells are leading bits of hashes; of equal texts in one slice one counts.
    Rows without a doc_id are not counted.
    """
    parts, names = ranges(docs.sparkSession, 2), Names(bits)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column(1), words)
            ids = [set_id(s) if len(s) else (None, None) for s in sets]
            own = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([i if i is None else names.first(i) for i, _ in ids], pa.int64()), pa.array([j for _, j in ids], pa.int64())]
            counted = list({i: s for i, s, d in zip(ids, sets, batch.column(0).is_valid().to_pylist(), strict=True) if d and len(s)}.values())
            cells, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *counted]) >> np.uint64(64 - CELL_BITS), return_counts=True)
            cuts = _cuts(cells, parts, CELL_BITS)
            some = [k for k in range(parts) if cuts[k] < cuts[k + 1]]
            blobs = [(_planes(np.diff(cells[cuts[k] : cuts[k + 1]], prepend=np.uint64(0))), _planes(n[cuts[k] : cuts[k + 1]])) for k in some]
            none = lambda k, n: [pa.nulls(n, t) for t in [pa.int64()] * 4 + [pa.int32(), pa.binary(), pa.binary()]][k]
            yield pa.RecordBatch.from_arrays([*own, *(none(k, batch.num_rows) for k in (4, 5, 6))], [x.split()[0] for x in READ.split(", ")])
            yield pa.RecordBatch.from_arrays([*(none(k, len(some)) for k in range(4)), pa.array(some, pa.int32()), pa.array([a for a, _ in blobs], pa.binary()), pa.array([b for _, b in blobs], pa.binary())], [x.split()[0] for x in READ.split(", ")])

    return written(docs.mapInArrow(lean(read), READ))


def frequent_shingles(read: DataFrame, most: int = MOST_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Cells that at least FREQUENT sets fall in, ascending, and their levels (log2 of the count).

    All shingles of the corpus are counted. If more than most cells are
    frequent, the lowest levels are left out: that only makes lists longer.
    """

    def add_up(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cells = np.concatenate([np.cumsum(_unplanes(x), dtype=np.uint64) for x in pdf.cells])
        n = np.concatenate([_unplanes(x) for x in pdf.n]).astype(np.int64)
        order = np.argsort(cells, kind="stable")
        cells, n = cells[order], n[order]
        first = np.flatnonzero(np.diff(cells, prepend=cells[0] + np.uint64(1)) != 0)
        total = np.add.reduceat(n, first)
        keep = total >= FREQUENT
        level = np.log2(np.maximum(total, 1)).astype(np.int64)
        rows = [(lv, int((keep & (level == lv)).sum()), _planes(cells[first][keep & (level == lv)])) for lv in np.unique(level[keep])]
        trim()
        return pd.DataFrame(rows, columns=["level", "n", "cells"])

    counted = durable(read.where("part is not null").select("part", "cells", "n").groupBy("part").applyInPandas(add_up, "level int, n long, cells binary"))
    left, least = most, 64
    for r in counted.groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect():  # a row per power of two
        left -= r.n
        if left < 0:
            break
        least = r.level
    found = [(r.level, _unplanes(r.cells)) for r in counted.where(F.col("level") >= least).collect()]  # at most `most` cells
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cells, levels = np.concatenate([c for _, c in found]), np.concatenate([np.full(len(c), lv) for lv, c in found])
    order = np.argsort(cells)
    return cells[order], levels[order]


# ---------------------------------------------------------------- the index
def prefix_index(docs: DataFrame, words: int, share: int, names: Names, cells: np.ndarray, levels: np.ndarray) -> DataFrame:
    """(part, postings): runs of prefix shingles with node, size and position; a frequent shingle's list is dealt over several parts."""
    parts = ranges(docs.sparkSession, 4)
    box = docs.sparkSession.sparkContext.broadcast((cells, levels))  # at most MOST_FREQUENT cells

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, levels = box.value
        for found in _distinct(batches, words, names):
            size = np.array([len(s) for _, s in found])
            tokens, node = np.concatenate([s for _, s in found]), np.repeat(np.array([i for i, _ in found], np.int64), size)
            doc = np.repeat(np.arange(len(found)), size)
            level = np.zeros(len(tokens), np.int64)
            if len(cells):
                cell = tokens >> np.uint64(64 - CELL_BITS)
                at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
                level = np.where(cells[at] == cell, levels[at], 0)
            order = np.lexsort((tokens, level, doc))  # within each document: rare ones first
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
            prefix = size - (-(-share * size // 100)) + 1
            keep = place < prefix[doc]
            chosen = order[keep]
            token, level, node, place, sizes = tokens[chosen], level[chosen], node[chosen], place[keep], size[doc][keep]
            dealt = np.maximum(0, level - int(np.log2(SUBLIST))).astype(np.uint64)
            spread = np.where(dealt > 0, mix64(node.view(np.uint64)) % (np.uint64(1) << dealt) + np.uint64(1), np.uint64(0))  # 0: the list is whole
            part = (mix64(token + spread * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((token, part))
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            some = [k for k in range(parts) if bounds[k] < bounds[k + 1]]
            columns = [(np.diff(token[o], prepend=np.uint64(0)), node[o].view(np.uint64), sizes[o], place[o], spread[o]) for k in some for o in [order[bounds[k] : bounds[k + 1]]]]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([_planes(np.concatenate([c.astype(np.uint64) for c in cs])) for cs in columns], pa.binary())], ["part", "postings"])

    return docs.select(F.col("text").cast("string")).mapInArrow(lean(index), "part int, postings binary")


def _may_link(sa, pa_, sb, pb, share: int):
    """Whether overlap can suffice if the shingle at these positions is the first that both sets hold."""
    return (100 + share) * np.minimum(sa - pa_, sb - pb) >= share * (sa + sb)


@dataclass
class Lists:
    """Entries by list, in blocks of like positions, sizes ascending in each; what the largest remainder and the smallest size of a block are."""

    size: np.ndarray
    place: np.ndarray
    blocks: np.ndarray  # where blocks begin, and the end

    @classmethod
    def of(cls, group: np.ndarray, size: np.ndarray, place: np.ndarray) -> Lists:
        """group: ascending numbers of lists; within each, entries by position (place * BLOCKS // size), then size."""
        at = place * BLOCKS // size
        new = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (at[1:] != at[:-1])])) if len(group) else np.zeros(0, np.int64)
        return cls(size, place, np.append(new, len(group)))

    def pairs(self, x: np.ndarray, first: np.ndarray, last: np.ndarray, size: np.ndarray, place: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
        """(x, y): each x, an entry of this size and place, with the entries y of blocks from first up to last that may link. Blocks that cannot are skipped."""
        if not (last > first).any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        least, rest = np.minimum.reduceat(self.size, self.blocks[:-1]), np.maximum.reduceat(self.size - self.place, self.blocks[:-1])
        out = []
        steps = np.cumsum(last - first) // MOST_BLOCKS  # so many blocks at a time, for bounded work space
        for k in np.unique(steps):
            on = np.flatnonzero(steps == k)
            block, who = ragged(first[on], (last - first)[on]), np.repeat(on, (last - first)[on])
            ok = (100 + share) * np.minimum(rest[block], (size - place)[who]) >= share * (least[block] + size[who])
            block, who = block[ok], who[ok]
            n = self.blocks[block + 1] - self.blocks[block]
            y, who = ragged(self.blocks[block], n), np.repeat(who, n)
            ok = _may_link(size[who], place[who], self.size[y], self.place[y], share)
            out.append((x[who[ok]], y[ok]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def list_pairs(index: DataFrame, share: int) -> DataFrame:
    """(kind, token, a, b, size, place): kind 0: compare nodes a and b. kind 1: a stands in a long list, with pivot b there."""

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = [_unplanes(x).reshape(5, -1) for x in pdf.postings]
        token = np.concatenate([np.cumsum(b[0], dtype=np.uint64) for b in blocks])
        node, size, place, spread = (np.concatenate([b[k] for b in blocks]).view(np.int64) for k in range(1, 5))
        order = np.lexsort((node, size, place * BLOCKS // size, spread, token))  # a list by blocks of positions; its first entry is the pivot
        token, node, size, place, spread = token[order], node[order], size[order], place[order], spread[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (spread[1:] != spread[:-1]) | (node[1:] != node[:-1])
        token, node, size, place, spread = token[fresh], node[fresh], size[fresh], place[fresh], spread[fresh]
        starts = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (spread[1:] != spread[:-1])]))
        length = np.diff(np.append(starts, len(token)))
        out = []
        for m in range(2, SHORT + 1):  # short lists: all pairs
            s = starts[length == m]
            for i in range(m):
                for j in range(i + 1, m):
                    x, y = s + i, s + j
                    ok = _may_link(size[x], place[x], size[y], place[y], share)
                    out.append((np.zeros(ok.sum(), np.int32), token[x[ok]], node[x[ok]], node[y[ok]], size[x[ok]], place[x[ok]]))
        long = (length > SHORT) | (spread[starts] > 0)
        n, s = length[long], starts[long]
        lists = Lists.of(np.repeat(np.arange(len(starts)), length), size, place)
        pivot, member = lists.pairs(s, np.searchsorted(lists.blocks, s), np.searchsorted(lists.blocks, s + n), size[s], place[s], share)
        ok = member != pivot
        out.append((np.zeros(ok.sum(), np.int32), token[member[ok]], node[pivot[ok]], node[member[ok]], size[member[ok]], place[member[ok]]))
        member, pivot = ragged(s, n), np.repeat(s, n)
        out.append((np.ones(len(member), np.int32), token[member], node[member], node[pivot], size[member], place[member]))
        kind, token, a, b, size, place = (np.concatenate(c) for c in zip(*out, strict=True))
        pair = pd.DataFrame({"kind": kind, "token": token.view(np.int64), "a": a, "b": b, "size": size.astype(np.int32), "place": place.astype(np.int32)})
        compared = pair[pair.kind == 0]
        low, high = np.minimum(compared.a, compared.b), np.maximum(compared.a, compared.b)
        trim()
        return pd.concat([compared.assign(a=low, b=high).drop_duplicates(["a", "b"]), pair[pair.kind == 1]])

    return index.groupBy("part").applyInPandas(join, "kind int, token long, a long, b long, size int, place int")


def rest_pairs(told: DataFrame, share: int) -> DataFrame:
    """(a, b): entries of lists that are apart from their pivot's component, with those entries of other components that may link.

    told: token, node, size, place, label, apart. A list is dealt over groups of
    about SUBLIST entries on either side, so no task holds a long one whole.
    """
    n = told.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("apart").cast("int")).alias("n_apart"))
    deal = lambda c: F.ceil(F.col(c) / SUBLIST).cast("int")
    sized = told.join(n.select("token", deal("n").alias("rows"), deal("n_apart").alias("cols")), "token")
    some = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = sized.where("apart").withColumn("col", some("cols")).select("token", "col", every("rows").alias("row"), "node", "size", "place", "label", F.lit(True).alias("asks"))
    right = sized.withColumn("row", some("rows")).select("token", every("cols").alias("col"), "row", "node", "size", "place", "label", F.lit(False).alias("asks"))
    parts = ranges(told.sparkSession, 4)

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        size, place = pdf["size"].to_numpy().astype(np.int64), pdf["place"].to_numpy().astype(np.int64)
        column = lambda c: pdf[c].to_numpy()
        order = np.lexsort((size, place * BLOCKS // size, column("row"), column("col"), column("token")))
        size, place = size[order], place[order]
        node, label, asks, token, col, row = (column(c)[order] for c in ("node", "label", "asks", "token", "col", "row"))
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (col[1:] != col[:-1]) | (row[1:] != row[:-1])])
        group = np.cumsum(new) - 1
        x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
        lists = Lists.of(group[y], size[y], place[y])
        block = lambda g: np.searchsorted(lists.blocks, np.searchsorted(group[y], g))
        a, b = lists.pairs(x, block(group[x]), block(group[x] + 1), size[x], place[x], share)
        b = y[b]
        ok = label[a] != label[b]
        low, high = np.minimum(node[a[ok]], node[b[ok]]), np.maximum(node[a[ok]], node[b[ok]])
        trim()
        return pd.DataFrame({"a": low, "b": high}).drop_duplicates()

    # Many lists a call; as many tasks as the cluster has for a shuffle, since little data here is much work.
    dealt = left.unionByName(right).withColumn("part", F.pmod(F.xxhash64("token", "col", "row"), F.lit(parts)).cast("int"))
    return dealt.repartition(parts // 4, "part").groupBy("part").applyInPandas(join, "a long, b long").distinct()


# ---------------------------------------------------------------- comparing
BLOOM_BITS = 25


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, ...) with each document's text, compressed.

    A Bloom filter of fixed size lets most other rows go before the shuffle; what
    it lets through by mistake the join drops, so any load gives whole results.
    """
    spot = lambda k: F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.lit(1 << BLOOM_BITS))
    bits = wanted.select(F.explode(F.array(spot(1), spot(2))).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    table, found = np.zeros(1 << (BLOOM_BITS - 6), np.int64), bits.toArrow()  # at most as many rows as the filter has words
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    box = docs.sparkSession.sparkContext.broadcast(table)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, squeeze = box.value, zstandard.ZstdCompressor(level=3)
        for batch in batches:
            spots = [batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3)]
            ok = np.logical_and(*((table[x >> 6] >> (x & 63)) & 1 == 1 for x in spots)) if batch.num_rows else np.zeros(0, bool)
            part = batch.filter(pa.array(ok))
            blobs = [squeeze.compress((x.as_py() or "").encode()) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary())], ["doc_id", "blob"])

    rows = docs.where("doc_id is not null").select("doc_id", "text", spot(1).alias("s1"), spot(2).alias("s2")).mapInArrow(lean(keep), "doc_id long, blob binary")
    return rows.join(wanted, "doc_id")


def linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, share: int, names: Names) -> DataFrame:
    """(a, b): those pairs of nodes whose sets are similar enough, by their whole sets.

    A node that is compared with many meets them in several groups, each with
    its own copy of that node's text.
    """
    pairs = durable(pairs.select("a", "b").distinct())  # read three times
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    known = durable(degree.join(nodes, "node").select("node", "doc_id", "n"))
    texts = written(texts_of(docs, known).select("node", "blob"))
    weighed = pairs.join(known.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(known.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    hub, other, n = (F.when(F.col("na") >= F.col("nb"), F.col(x)).otherwise(F.col(y)) for x, y in (("a", "b"), ("b", "a"), ("na", "nb")))
    groups = lambda n: F.ceil(n / 64).cast("int")
    asked = weighed.select(hub.alias("hub"), other.alias("node"), n.alias("hub_n"))
    with_text = asked.join(texts, "node").select("hub", F.pmod(F.xxhash64("node"), groups(F.col("hub_n"))).cast("int").alias("group"), "node", "blob")
    used = asked.select(F.col("hub").alias("node"), F.pmod(F.xxhash64("node"), groups(F.col("hub_n"))).cast("int").alias("group")).distinct()
    hubs = used.join(texts, "node").select(F.col("node").alias("hub"), "group", F.lit(None).cast("long").alias("node"), "blob")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, expand = None, None, zstandard.ZstdDecompressor()
        for batch in slices(batches, 3, 1 << 20):
            sets = shingle_sets(pa.array([expand.decompress(x.as_py()) if len(x.as_py()) else b"" for x in batch.column(3)], pa.binary()).cast(pa.string()), words)
            a, b = [], []
            for hub, group, node, s in zip(*(batch.column(k).to_pylist() for k in range(3)), sets, strict=True):
                if node is None:
                    if len(s) and names.of(s) == hub:  # another text of a repeated doc_id is not meant
                        at, held = (hub, group), s
                elif at == (hub, group) and len(s) and names.of(s) == node:
                    common = len(np.intersect1d(held, s, assume_unique=True))
                    if 100 * common >= share * (len(held) + len(s) - common):
                        a.append(min(hub, node))
                        b.append(max(hub, node))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    together = with_text.unionByName(hubs).repartition("hub", "group").sortWithinPartitions("hub", "group", F.col("node").asc_nulls_first())
    return together.mapInArrow(lean(compare), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (a, b) reach from each linked node, by alternating large and small stars.

    It ends when the edges are stars: no node hangs on two, and none that hangs
    on another is hung upon.
    """
    edges = durable(links.select("a", "b").where("a <> b"))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = durable(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # neighbours above a node hang on its least neighbour
        down = durable(large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        least = durable(down.groupBy("a").agg(F.min("b").alias("m")))
        ends = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = durable(down.join(least, "a").select(F.explode(ends).alias("e")).select("e.a", "e.b").where("a <> b").distinct())
        part = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("hangs")), F.struct(F.col("b").alias("node"), F.lit(0).alias("hangs"))))
        roles = edges.select(part.alias("r")).groupBy("r.node").agg(F.sum("r.hangs").alias("hangs"), F.min("r.hangs").alias("least"))
        if roles.where("hangs > 1 or (hangs = 1 and least = 0)").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _named(read: DataFrame, bits: int) -> tuple[DataFrame, Names]:
    """The documents' rows with one 64-bit name per different set. Sets that share their first halves are so few that their names fit the driver."""
    rows = read.where("part is null").select("doc_id", "n_shingles", "node", "node_hi")
    clashes = rows.where("node is not null").groupBy("node").agg(F.min("node_hi").alias("lo"), F.max("node_hi").alias("hi")).where("lo <> hi").select("node")
    names = Names(bits, frozenset(r.node for r in clashes.collect()))
    if names.clashes:
        rows = rows.withColumn("node", F.when(F.col("node").isin(sorted(names.clashes)), F.col("node_hi")).otherwise(F.col("node")))
    return rows.drop("node_hi"), names


def jaccard_components(docs: DataFrame, words: int = 4, share: int = 85, name_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    Two documents link when 100 * |intersection| >= share * |union| of their
    shingle sets; component_id is the smallest doc_id reachable. A text of fewer
    words than a shingle is one shingle; null texts and texts without words have
    no shingle and link with nothing. Rows that share a doc_id are one document:
    links of either text count for it. A null doc_id links with nothing and has
    a null component. Very long texts are read whole, one at a time; an empty
    table gives an empty one. Other columns do not matter. name_bits: bits of
    sets' first names, fewer only in tests.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = read_sets(docs, words, name_bits)
    rows, names = _named(read, name_bits)
    nodes = durable(rows.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    # A text that only rows without a doc_id hold is no node, so it must not lead a list.
    index = prefix_index(docs.where("doc_id is not null"), words, share, names, *frequent_shingles(read))
    lists = written(list_pairs(index, share))
    member = lists.where("kind = 1").select("token", F.col("a").alias("node"), F.col("b").alias("pivot"), "size", "place")
    # Pivots of the parts of a list that was dealt out meet the list's first pivot.
    pivots = member.where("node = pivot").select("token", "node", "size", "place")
    main = durable(pivots.groupBy("token").agg(F.min(F.struct((F.col("place") * BLOCKS / F.col("size")).cast("int").alias("block"), "size", "node")).alias("p")).select("token", F.col("p.node").alias("main")))
    meet = pivots.join(main, "token").where("node <> main").select(F.least("node", "main").alias("a"), F.greatest("node", "main").alias("b"))
    first = durable(linked(lists.where("kind = 0").select("a", "b").unionByName(meet), nodes, docs, words, share, names))
    doc = lambda side: nodes.select(F.col("node").alias(side), F.col("doc_id").alias(f"doc_{side}"))
    # Nodes whose doc_id is that of another node are one document.
    of_docs = lambda links: links.join(doc("a"), "a").join(doc("b"), "b").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).distinct()
    by_doc = of_docs(first)
    found = components(by_doc)
    label = nodes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("node", F.coalesce("component", "doc_id").alias("label"))
    # Second level: entries whose component is not their pivot's, against the entries of other components. Lists of one component are done.
    labelled = written(member.drop("pivot").join(label, "node"))
    mixed = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    told = labelled.join(written(mixed), "token").join(main, "token").join(label.select(F.col("node").alias("main"), F.col("label").alias("main_label")), "main")
    told = written(told.select("token", "node", "size", "place", "label", (F.col("label") != F.col("main_label")).alias("apart")).distinct())
    rest = durable(rest_pairs(told, share).join(first, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = durable(linked(rest, nodes, docs, words, share, names))
        found = found if more.isEmpty() else components(by_doc.unionByName(of_docs(more)))
    own = rows.join(nodes.withColumnRenamed("doc_id", "first_doc"), "node", "left")
    out = own.join(found.select(F.col("node").alias("first_doc"), "component"), "first_doc", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first_doc", "doc_id")).alias("component_id"))

"""Benchmark decontamination in DataFrame functions alone.

Windows of a document are as long as a benchmark item: for each length of items
one at every start where enough of its shingles stand in items of that length (a
window similar to any of them has that many, in whatever order, so none is
missed). Each window has a 64-bit SimHash of its shingles. The fingerprints
search the items of that length through a multi-index: BLOCKS blocks of bits, and
an item is filed under each block's value and every value at most FLIPS bits away.
Two fingerprints within RADIUS bits differ by at most FLIPS bits in some block, so
the index guarantees all of them. The exact weighted similarity of the shingles
decides, where a shingle weighs as often as it stands.

At a similarity of 0.8 fingerprints differ in 9.7 of 64 bits on average, with a
standard deviation of 2.9: RADIUS is more than four of them beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, written

WORDS = 5
SIMILARITY = 0.8
BLOCKS, FLIPS = 8, 2  # BLOCKS divides 64
RADIUS = (FLIPS + 1) * BLOCKS - 1
#: Up to this many shingles, or index entries, of benchmark items are told to every task; beyond it they are joined by a shuffle.
MOST_BROADCAST = 500_000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def shingle_hashes(words: Column, width: int = WORDS) -> Column:
    """array<bigint>, one for each place of width words; empty for fewer words."""
    hashed = lambda w, i: F.xxhash64(*(F.get(w, i + F.lit(k)) for k in range(width)))
    every = lambda w: F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: hashed(w, i))).otherwise(F.array().cast("array<bigint>"))
    return _let(words, every)


def simhash(shingles: str) -> Column:
    """64 bits of a column of shingle hashes: each the majority of that bit, weighted by how often a shingle stands.

    Bits b and b + 32 are counted in the two halves of one number.
    """
    both = f"aggregate({shingles}, 0L, (n, h) -> n + (shiftrightunsigned(h, b) & {(1 << 32) + 1}L))"
    bit = lambda n, at: f"if(2 * ({n}) > size({shingles}), shiftleft(1L, {at}), 0L)"
    told = f"transform(array({both}), n -> {bit('n & 4294967295L', 'b')} | {bit('shiftrightunsigned(n, 32)', 'b + 32')})[0]"
    return F.expr(f"aggregate(sequence(0, 31), 0L, (bits, b) -> bits | {told})")


def blocks(print_: str, near: bool = False) -> Column:
    """array<struct<block, value>> of a fingerprint's blocks; near: with every value at most FLIPS bits away."""
    bits = 64 // BLOCKS
    flips = [x for x in range(1 << bits) if x.bit_count() <= FLIPS] if near else [0]
    each = f"transform(array({', '.join(f'{x}L' for x in flips)}), f -> struct(k AS block, (shiftrightunsigned({print_}, k * {bits}) & {(1 << bits) - 1}L) ^ f AS value))"
    return F.expr(f"flatten(transform(sequence(0, {BLOCKS - 1}), k -> {each}))")


def similarity(a: str, b: str) -> Column:
    """Sum of the smaller over sum of the larger counts of shingles."""
    count = lambda s: f"size(filter({s}, x -> x = h))"
    total = lambda pick: f"aggregate(array_union({a}, {b}), 0, (n, h) -> n + {pick}({count(a)}, {count(b)}))"
    once = f"size(array_distinct({a})) = size({a}) and size(array_distinct({b})) = size({b})"
    sets = f"transform(array(size(array_intersect({a}, {b}))), c -> c / (size({a}) + size({b}) - c))[0]"
    return F.expr(f"if({once}, {sets}, {total('least')} / {total('greatest')})")


def starts(places: str, n: str, size: Column | str, item_size: Column) -> Column:
    """Every start of a window of size shingles, in a text of n, that holds as many shared ones as SIMILARITY takes at least; ascending.

    places: where the shared shingles stand, ascending. Similar windows have
    c / (item_size + size - c) >= SIMILARITY for c in common. A start belongs to
    the first place at or after it, so the number of starts follows the text.
    """
    least = F.greatest(F.lit(1), F.ceil((item_size + F.col(size)) * SIMILARITY / (1 + SIMILARITY) - 1e-6).cast("int"))

    def after(p: Column, need: Column) -> Column:
        def run(j: Column) -> Column:
            low = F.greatest(F.lit(0), F.get(p, j + need - 1) - F.col(size) + 1, F.coalesce(F.when(j > 0, F.get(p, j - 1) + 1), F.lit(0)))
            high = F.least(F.get(p, j), F.col(n) - F.col(size))
            return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

        return F.when(F.size(p) >= need, F.flatten(F.transform(F.sequence(F.lit(0), F.size(p) - need), run))).otherwise(F.array().cast("array<int>"))

    return _let(F.struct(F.col(places).alias("p"), least.alias("need")), lambda x: after(x["p"], x["need"]))


def _told(few: DataFrame) -> DataFrame:
    """The rows, broadcast if they are few enough."""
    return F.broadcast(few) if few.count() <= MOST_BROADCAST else few


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, similarity): the best window of every document that holds an item, the earliest of equally good ones.

    start counts words from 0. An item of fewer than WORDS words is one shingle
    of all its words; a null item, or one without words, is held by nothing, and
    null and empty documents hold nothing. Rows that share a doc_id are one
    document, rows of an item_id one item with several texts; rows with a null
    id are left out. Very long texts have all their windows looked at; without
    rows in either table there are none in the result. Other columns do not
    matter.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where("doc_id is not null")
    items = written(benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("words")).where("item_id is not null and size(words) > 0").distinct())
    widths = [r.width for r in items.select(F.least(F.size("words"), F.lit(WORDS)).alias("width")).distinct().collect()]  # at most WORDS numbers
    found = [_search(docs, items.where(F.least(F.size("words"), F.lit(WORDS)) == width), width) for width in widths or [WORDS]]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = every.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "start")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.start").cast("long").alias("start"), (-F.col("best.less")).alias("similarity"))


def _search(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """(doc_id, item_id, start, similarity) of windows that are similar to items, by shingles of width words."""
    items = items.select("item_id", shingle_hashes(F.col("words"), width).alias("item_shingles")).withColumn("item_size", F.size("item_shingles"))
    items = written(items.withColumn("item_print", simhash("item_shingles")).withColumn("item", F.xxhash64("item_id", "item_shingles")))
    known = _told(items.select("item_size", F.explode("item_shingles").alias("hash")).groupBy("hash").agg(F.collect_set("item_size").alias("sizes")))
    cut = docs.select("doc_id", F.xxhash64("text").alias("copy"), shingle_hashes(words_of(F.col("text")), width).alias("shingles"))
    places = cut.select("doc_id", "copy", F.size("shingles").alias("n"), F.posexplode("shingles").alias("place", "hash"))
    shared = places.join(known, "hash").select("doc_id", "copy", "n", "place", F.explode("sizes").alias("item_size")).groupBy("doc_id", "copy", "n", "item_size")
    shared = shared.agg(F.sort_array(F.collect_set("place")).alias("places")).withColumn("size", F.least("item_size", "n"))
    hits = written(shared.withColumn("starts", starts("places", "n", "size", F.col("item_size"))).where("size(starts) > 0").drop("places", "n"))
    held = written(hits.select("doc_id", "copy").distinct())
    texts = docs.withColumn("copy", F.xxhash64("text")).join(held, ["doc_id", "copy"]).distinct().select("doc_id", "copy", shingle_hashes(words_of(F.col("text")), width).alias("all"))
    windows = texts.join(hits, ["doc_id", "copy"]).select("doc_id", "copy", "item_size", "size", "all", F.explode("starts").alias("start"))
    windows = windows.select("doc_id", "copy", "item_size", "start", F.slice("all", F.col("start") + 1, F.col("size")).alias("shingles"))
    windows = durable(windows.withColumn("print", simhash("shingles")))
    index = _told(items.select("item", "item_size", "item_print", F.explode(blocks("item_print", near=True)).alias("at")))
    asked = windows.select("doc_id", "copy", "item_size", "start", "print", F.explode(blocks("print")).alias("at"))
    near = asked.join(index, ["item_size", "at"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS).select("doc_id", "copy", "item", "item_size", "start").distinct()
    checked = near.join(windows, ["doc_id", "copy", "item_size", "start"]).join(items.select("item", "item_id", "item_shingles"), "item")
    return checked.select("doc_id", "item_id", "start", similarity("shingles", "item_shingles").alias("similarity")).where(F.col("similarity") >= SIMILARITY)

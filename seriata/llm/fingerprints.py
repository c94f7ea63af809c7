"""Document fingerprints from closed syncmers, in DataFrame functions alone.

Symbols are code points. A k-mer (K code points) is a closed syncmer if the
smallest hash of its inner substrings (S code points) lies at one of its ends:
whether it is one depends on nothing outside it. So an edit moves no anchor but
those that it touches, a long text may be read in blocks, and the anchors of a
text put together from parts of others are theirs, with those that cross a joint.
An anchor has the place of its first code point. All of a text's anchors are
compared; the fingerprint that is printed holds the SIZE smallest hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ranges

K, S = 40, 9
#: Inner substrings of a k-mer, and how many of them are looked at at once: a power of two, half of INNER at most.
INNER, STEP = K - S + 1, 8
SIZE = 64
#: Code points that are read at a time, so that work space does not follow the length of a text.
BLOCK = 1 << 14
#: No text that fits an array of four bytes a code point has more places.
PLACE_BITS = 29
_PLACE = (1 << PLACE_BITS) - 1


def _let(value: Column, use) -> Column:
    """use(value) with value computed once a row."""
    return F.transform(F.array(value), use)[0]


def _packed(h: Column, place: Column) -> Column:
    """35 bits of a hash above the 29 of a place."""
    return F.shiftleft(h, PLACE_BITS).bitwiseOR(place.cast("bigint"))


def _hash(x: Column) -> Column:
    return F.shiftrightunsigned(x, PLACE_BITS)


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_PLACE))


def _none() -> Column:
    return F.array().cast("array<bigint>")


def _chosen(steps: Column, last: Column) -> Column:
    """The places up to last, in order, at which a run of INNER values begins that has its smallest at either end.

    steps: the values in arrays of STEP. Whatever run begins in a step, the next
    INNER / STEP - 1 steps lie in it whole, so an end above their smallest is
    none; most steps have no other and are passed over. What follows the last
    run does not matter.
    """
    whole = INNER // STEP

    def places(low: Column) -> Column:
        inside = lambda q: F.least(*(F.get(low, q + k) for k in range(1, whole)))
        kept = F.filter(F.sequence(F.lit(0), F.shiftright(last, STEP.bit_length() - 1)), lambda q: F.least(F.get(low, q), F.get(low, q + whole), F.get(F.get(steps, q + (whole - 1)), F.lit(STEP - 1))) <= inside(q))

        def of_step(at: Column) -> Column:
            """at: the number of the step, its values, those of the step where its runs end and the smallest between."""
            near = lambda x, j: (x <= at["most"]) | (F.coalesce(F.get(at["after"], j - 1), at["end"]) <= at["most"])
            smallest = lambda j: F.least(at["most"], F.array_min(F.filter(at["own"], lambda _, k: k >= j)), F.array_min(F.filter(at["after"], lambda _, k: k < j)))
            ends = lambda x, j: F.least(x, F.coalesce(F.get(at["after"], j - 1), at["end"])) <= smallest(j)
            marked = F.transform(at["own"], lambda x, j: F.when(near(x, j), F.when(ends(x, j), at["q"] * STEP + j)))
            return F.filter(marked, lambda i: i <= last)

        step = lambda q: F.struct(q.alias("q"), F.get(steps, q).alias("own"), F.get(steps, q + whole).alias("after"), F.get(F.get(steps, q + (whole - 1)), F.lit(STEP - 1)).alias("end"), inside(q).alias("most"))
        return F.flatten(F.transform(kept, lambda q: _let(step(q), of_step)))

    return _let(F.transform(steps, F.array_min), places)


def syncmers(text: Column) -> Column:
    """array<bigint>: every closed syncmer's hash and place, by place."""
    def of_block(raw: Column, at: Column) -> Column:
        """raw: four bytes a code point, K - 1 code points more than BLOCK, the first one at place at."""
        n = F.length(raw)
        hash_ = lambda i: F.xxhash64(F.substring(raw, i, F.lit(4 * S)))
        hashes = F.transform(F.sequence(F.lit(1), n - F.lit(4 * S - 1), F.lit(4 * STEP)), lambda p: F.transform(F.sequence(p, F.least(p + F.lit(4 * STEP - 4), n - F.lit(4 * S - 1)), F.lit(4)), hash_))
        found = _let(hashes, lambda steps: _chosen(steps, F.shiftright(n, 2) - F.lit(K)))
        return F.when(n >= 4 * K, F.transform(found, lambda i: _packed(F.xxhash64(F.substring(raw, i * 4 + 1, F.lit(4 * K))), i + at))).otherwise(_none())

    def of_text(raw: Column) -> Column:
        n = (F.length(raw) / 4).cast("int")
        blocks = F.sequence(F.lit(0), F.greatest(n - F.lit(K), F.lit(0)), F.lit(BLOCK))
        return F.flatten(F.transform(blocks, lambda at: _let(F.substring(raw, at * 4 + 1, F.lit(4 * (BLOCK + K - 1))), lambda part: of_block(part, at))))

    return _let(F.encode(text, "UTF-32"), of_text)


def distinct(found: Column) -> Column:
    """Syncmers in ascending order (as signed numbers), the first place of each."""
    return _let(F.sort_array(found), lambda a: F.filter(a, lambda x, j: (j == 0) | (_hash(x) != _hash(F.get(a, j - 1)))))


def or_alone(found: Column, text: Column) -> Column:
    """A text without any syncmer has its own hash as its only anchor."""
    return F.when(F.size(found) > 0, found).otherwise(F.array(_packed(F.xxhash64(text), F.lit(0))))


def anchors_of(text: Column) -> Column:
    """array<bigint>: the distinct anchors of a text, ascending as signed numbers."""
    return _let(distinct(syncmers(text)), lambda found: or_alone(found, text))


def fingerprint(text: Column) -> Column:
    """The SIZE smallest anchors."""
    return F.slice(anchors_of(text), 1, SIZE)


def moves(a: Column, b: Column) -> Column:
    """By how many code points each common anchor stands later in b than in a, in the order of its places in a."""
    side = lambda p, k: F.transform(p, lambda x: F.shiftleft(_hash(x), PLACE_BITS + 1).bitwiseOR(F.lit(k << PLACE_BITS)).bitwiseOR(_place(x)))
    same = lambda x, y: F.shiftrightunsigned(x, PLACE_BITS + 1) == F.shiftrightunsigned(y, PLACE_BITS + 1)
    # A common anchor's two places stand side by side; its place in a goes above how far it moved.
    pair = lambda x, y: F.when(same(x, y), F.shiftleft(_place(x), PLACE_BITS + 1) + (_place(y) - _place(x) + F.lit(1 << PLACE_BITS)))
    both = F.sort_array(F.concat(side(a, 0), side(b, 1)))
    met = _let(both, lambda m: F.sort_array(F.filter(F.transform(m, lambda x, j: pair(x, F.get(m, j + 1))), lambda d: d.isNotNull())))
    return F.transform(met, lambda d: d.bitwiseAND(F.lit((1 << PLACE_BITS + 1) - 1)) - F.lit(1 << PLACE_BITS))


def _usual(by: Column) -> Column:
    """The most frequent number of an array, the smallest such on ties; null if it is empty."""

    def runs(d: Column) -> Column:
        first = F.filter(F.transform(d, lambda v, j: F.when((j == 0) | (v != F.get(d, j - 1)), j)), lambda j: j.isNotNull())
        lengths = lambda f: F.zip_with(f, F.slice(f, 2, F.size(f)), lambda j, k: F.struct(j - F.coalesce(k, F.size(d)), F.get(d, j).alias("by")))
        return _let(first, lengths)

    return F.array_min(_let(F.sort_array(by), runs))["by"]


def shift(by: Column) -> Column:
    """Positional match of two texts with these moves: by how many code points most common anchors stand later; null without any."""
    return _usual(by)


def likeness(by: Column, a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' anchors by hash and place.

    A common anchor counts where its place fits: it is moved as far as a
    neighbour among the common ones, or as far as most of them.
    """
    fits = lambda usual: F.size(F.filter(by, lambda d, i: (d == usual) | F.coalesce(d == F.get(by, i - 1), F.lit(False)) | F.coalesce(d == F.get(by, i + 1), F.lit(False))))
    return F.when(F.size(by) == 0, F.lit(0.0)).otherwise(_let(_let(_usual(by), fits), lambda n: n / (F.size(a) + F.size(b) - n)))


def to_string(print_: Column) -> Column:
    return F.array_join(F.transform(print_, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def with_next(rows: DataFrame, *columns: str, first=lambda rows: rows) -> DataFrame:
    """rows with next_<column>: the values of the row with the next doc_id, after the last those of the first.

    Ties go by text; a null doc_id comes first. Rows meet in ranges of ids of
    about equal numbers of rows, whatever the ids are; each range borrows the
    first row of the next one that is not empty. first is applied to the rows
    after they have moved.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    n = ranges(rows.sparkSession, 2)
    ends = rows.agg(F.percentile_approx(key, [k / n for k in range(1, n)], 100 * n).alias("ends")).first().ends or []  # as many numbers as ranges
    bounds = F.array(*map(F.lit, sorted(set(ends)))).cast("array<bigint>")
    bucket = _let(F.array_position(F.transform(bounds, lambda b: key < b), True), lambda at: F.when(at == 0, F.size(bounds) + 1).otherwise(at)).cast("int")
    rows = rows.withColumn("bucket", bucket).withColumn("borrowed", F.lit(False))
    heads = sorted((r.bucket, r.head) for r in rows.groupBy("bucket").agg(F.min("doc_id").alias("head"), F.count_if(F.col("doc_id").isNull()).alias("none")).select("bucket", F.when(F.col("none") == 0, F.col("head")).alias("head")).collect())  # a row per range
    links = rows.sparkSession.createDataFrame([(b, head) for (b, _), (_, head) in zip(heads, [*heads[1:], *heads[:1]], strict=True)], "before int, head long")
    borrowed = rows.join(F.broadcast(links), rows.doc_id.eqNullSafe(links["head"])).withColumn("bucket", F.col("before")).withColumn("borrowed", F.lit(True)).select(rows.columns)
    ordered = Window.partitionBy("bucket").orderBy("borrowed", F.col("doc_id").asc_nulls_first(), "text")
    both = first(rows.unionByName(borrowed).repartition("bucket"))
    return both.select(*both.columns, *(F.lead(c).over(ordered).alias(f"next_{c}") for c in columns)).where(~F.col("borrowed")).drop("bucket", "borrowed")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of docs: its fingerprint, that of its edited text, and how like they are.

    The edited text has the last half of the code points (rounded down) replaced
    by as many of the next document's first; its anchors are those of its two
    parts and of the K - 1 code points on either side of the joint. Null texts
    are empty. Of repeated doc_ids each row is the next one's predecessor,
    ordered by text; they stand in one range. Texts without an anchor, such as
    those shorter than K code points, have one that stands for the whole text.
    Very long texts are read block by block. Without rows there are none in the
    result. Other columns do not matter.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows, "text", "found", first=lambda moved: moved.withColumn("found", distinct(syncmers(F.col("text")))))
    n = F.char_length("text")
    rows = rows.withColumn("n", n).withColumn("cut", n - F.floor(n / 2).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("cut")), F.substring("next_text", F.lit(1), F.col("n") - F.col("cut"))))
    # Numbers of a row are bound before they meet an array's elements, else they would be counted anew for each.
    more = F.least(F.char_length("next_text"), F.col("n") - F.col("cut"))
    before = _let(F.col("cut"), lambda cut: F.filter("found", lambda x: _place(x) + K <= cut))
    after = _let(F.struct(F.col("cut"), more.alias("more")), lambda at: F.transform(F.filter("next_found", lambda x: _place(x) + K <= at["more"]), lambda x: x + at["cut"]))
    around = F.substring("edited", F.greatest(F.col("cut") - (K - 1), F.lit(0)) + 1, F.least(F.col("cut"), F.lit(K - 1)) + (K - 1))
    joint = _let(F.greatest(F.col("cut") - (K - 1), F.lit(0)), lambda first: F.transform(syncmers(around), lambda x: x + first))
    rows = rows.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), or_alone(F.col("found"), F.col("text")).alias("a"),
        _let(distinct(F.concat(before, joint, after)), lambda found: or_alone(found, F.col("edited"))).alias("b"), or_alone(F.col("next_found"), F.col("next_text")).alias("c"),
    )
    a, b, c = (F.col(x) for x in "abc")
    rows = rows.withColumn("to_edited", moves(a, b)).withColumn("to_next", moves(a, c))
    edited, next_ = F.col("to_edited"), F.col("to_next")
    return rows.select("doc_id", "n_chars", "edited_sha256", to_string(F.slice(a, 1, SIZE)).alias("fingerprint"), to_string(F.slice(b, 1, SIZE)).alias("edited_fingerprint"), likeness(edited, a, b).alias("near_edited"), likeness(next_, a, c).alias("near_next"), shift(edited).alias("shift_edited"))

"""Robust statistics, histograms and their cumulative shares, as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def histogram(rows: DataFrame, keys: list[str], bin_: Column, bins: int = 256) -> DataFrame:
    """keys, bin, n for bins 0..bins-1 that are not empty; other values are left out."""
    return rows.withColumn("bin", bin_.cast("int")).where((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def dense(histo: DataFrame, keys: list[str], bins: int = 256) -> DataFrame:
    """keys, counts: an array of all bins; a key without rows has no array (a missing image)."""
    found = histo.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    return found.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0))).alias("counts"))


def cdf(histo: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bin, n, share: the running share of all counts up to a bin."""
    w = Window.partitionBy(*keys)
    return histo.withColumn("share", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w))


def percentile_width(histo: DataFrame, keys: list[str], low: float = 0.05, high: float = 0.98) -> DataFrame:
    """keys, low_bin, high_bin, width: the first bins beyond two shares."""
    first = lambda s: F.min(F.when(F.col("share") > s, F.col("bin")))
    return cdf(histo, keys).groupBy(*keys).agg(first(low).alias("low_bin"), first(high).alias("high_bin")).withColumn("width", F.col("high_bin") - F.col("low_bin"))


def histogram_mode(counts: Column, prefer: list[tuple[int, int]], smooth: int = 5, least: float = 0.25) -> Column:
    """The bin of the tallest raw count among smoothed peaks of the first preferred range that has one; -1 if there is none.

    counts: a dense array. The box filter has smooth bins (odd), the ends repeated
    by reflection; a peak must be higher than the bin before and not lower than
    the next, and its raw count more than least of the largest.
    """
    half = smooth // 2

    def of(c: Column) -> Column:
        n = F.size(c)
        inside = lambda j: F.when(j < 0, -j - 1).when(j >= n, 2 * n - 1 - j).otherwise(j)
        smoothed = F.transform(c, lambda _, i: sum((F.get(c, inside(i + k)) for k in range(-half, half + 1)), F.lit(0)))
        return F.transform(F.array(smoothed), lambda s: pick(c, s))[0]

    def pick(c: Column, s: Column) -> Column:
        top = F.array_max(c) * least
        is_peak = lambda i: (F.get(s, i) > F.get(s, i - 1)) & (F.get(s, i) >= F.get(s, i + 1)) & (F.get(c, i) > top)
        found = F.filter(F.sequence(F.lit(1), F.size(c) - 2), is_peak)
        return F.transform(F.array(found), lambda f: choose(c, f))[0]

    def choose(c: Column, peaks: Column) -> Column:
        best = F.lit(-1)
        for lo, hi in reversed(prefer):
            there = F.filter(peaks, _between(lo, hi))
            tallest = F.array_min(F.transform(there, lambda i: F.struct((-F.get(c, i)).alias("h"), i.alias("i"))))["i"]
            best = F.coalesce(tallest, best)
        return best

    return F.transform(F.array(counts), of)[0]


def _between(lo: int, hi: int):
    return lambda i: (i >= lo) & (i < hi)


def mad_z(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with z: (x - median) / 1.4826 / MAD per group; 0 where the MAD is 0. Two aggregates joined back, no group in one task's memory."""
    med = rows.groupBy(*keys).agg(F.median(value).alias("med_"))
    with_med = rows.join(med, keys)
    mad = with_med.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("med_"))).alias("mad_"))
    z = F.when(F.col("mad_") == 0, 0.0).otherwise((F.col(value) - F.col("med_")) / 1.4826 / F.nullif("mad_", F.lit(0.0)))
    return with_med.join(mad, keys).withColumn("z", z).drop("med_", "mad_")


def r2(rows: DataFrame, keys: list[str], truth: str, guess: str, weight: Column | None = None) -> DataFrame:
    """keys, r2: share of the truth's variance that the guess explains; 1 or 0 for a constant truth; null under two rows."""
    w = weight if weight is not None else F.lit(1.0)
    mean = rows.withColumn("w_", w).groupBy(*keys).agg((F.sum(F.col("w_") * F.col(truth)) / F.sum("w_")).alias("mean_"))
    parts = rows.withColumn("w_", w).join(mean, keys) if keys else rows.withColumn("w_", w).join(mean)
    s = parts.groupBy(*keys).agg(F.sum(F.col("w_") * (F.col(truth) - F.col(guess)) ** 2).alias("rss"), F.sum(F.col("w_") * (F.col(truth) - F.col("mean_")) ** 2).alias("tss"), F.count("*").alias("n"))
    value = F.when(F.col("n") < 2, None).when(F.col("tss") > 0, 1 - F.col("rss") / F.nullif("tss", F.lit(0.0))).otherwise(F.when(F.col("rss") == 0, 1.0).otherwise(0.0))
    return s.select(*keys, value.alias("r2"))


def saturated(counts: Column, low: int, high: int) -> Column:
    """A dense histogram whose first low bins take the value of the next one, and the last high bins that of the one before."""
    n = F.size(counts)
    return F.transform(counts, lambda v, i: F.when(i < low, F.get(counts, F.lit(low))).when(i >= n - high, F.get(counts, n - high - 1)).otherwise(v))


def masked_to_mean(counts: Column, low: int, high: int) -> Column:
    """A dense histogram with the bins outside [low, high) replaced by the mean of those inside."""
    mean = F.aggregate(F.slice(counts, low + 1, high - low), F.lit(0.0), lambda t, v: t + v, lambda t: t / (high - low))
    return F.transform(F.array(mean), lambda m: F.transform(counts, lambda v, i: F.when((i >= low) & (i < high), v.cast("double")).otherwise(m)))[0]


def match_map(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bin, to: each source bin's target bin of the same cumulative share, interpolated between target bins.

    Both are histograms of at most 256 bins; source shares below the first target share map to its first bin.
    """
    t = cdf(target, []).select(F.col("bin").alias("b"), F.col("share").alias("s"))
    w = Window.orderBy("b")
    t = t.withColumn("s0", F.lag("s").over(w)).withColumn("b0", F.lag("b").over(w))
    s = cdf(source, keys)
    j = s.join(F.broadcast(t), (F.col("share") <= F.col("s") + 1e-12) & (F.col("s0").isNull() | (F.col("share") > F.col("s0") + 1e-12)))  # at most 256 rows
    to = F.when(F.col("s0").isNull(), F.col("b").cast("double")).otherwise(F.col("b0") + (F.col("share") - F.col("s0")) / (F.col("s") - F.col("s0")) * (F.col("b") - F.col("b0")))
    return j.select(*keys, "bin", to.alias("to"))

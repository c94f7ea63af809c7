"""Descriptor matching: two nearest neighbours, ratio test, match matrices and their preparation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def two_nearest(features: DataFrame, block: int = 4096) -> DataFrame:
    """kp_id, i, j, d1, d2, target: for each descriptor of section i the squared distances of its two nearest in section j.

    features: (section, kp_id, descriptor). Sections meet pair by pair, each
    query section in blocks of at most block rows, so a task holds a block and
    one section. Distances come from one matrix product per block.
    """
    f = features.select("section", "kp_id", "descriptor")
    size = f.groupBy("section").agg(F.count("*").alias("n"))
    others = size.select(F.col("section").alias("j"))
    dealt = f.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("section").orderBy("kp_id")) - 1) / block))
    asked = dealt.join(F.broadcast(others), F.col("section") != F.col("j")).select("section", "part", "j", "kp_id", "descriptor")  # a row per section
    pairs = dealt.select("section", "part").distinct().join(F.broadcast(others), F.col("section") != F.col("j"))
    given = pairs.join(f.select(F.col("section").alias("j"), "kp_id", "descriptor"), "j").select(F.col("section").alias("i_"), F.col("part").alias("part_"), F.col("j").alias("j_"), F.col("kp_id").alias("kp_id"), F.col("descriptor").alias("descriptor"))

    def compare(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if len(x) == 0 or len(y) < 2:
            return pd.DataFrame({"kp_id": [], "i": [], "j": [], "d1": [], "d2": [], "target": []})
        y = y.sort_values("kp_id")
        a, b = (np.stack(v.descriptor.to_numpy()).astype(np.float64) for v in (x, y))
        d = np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T)
        first = d.argmin(1)
        rows = np.arange(len(a))
        exact = ((a - b[first]) ** 2).sum(1)
        d[rows, first] = np.inf
        second = d.argmin(1)
        return pd.DataFrame({"kp_id": x.kp_id, "i": key[0], "j": key[2], "d1": exact, "d2": ((a - b[second]) ** 2).sum(1), "target": y.kp_id.to_numpy()[first]})

    return asked.groupBy("section", "part", "j").cogroup(given.groupBy("i_", "part_", "j_")).applyInPandas(compare, "kp_id long, i int, j int, d1 double, d2 double, target long")


def match_matrix(nearest: DataFrame, sizes: DataFrame, ratio: float, most_hits: int = 0, least: int = 1) -> DataFrame:
    """i, j, matches, pct. A descriptor matches if d1 > 0 and d2 / d1 > ratio (squared distances).

    most_hits > 0 rejects matches whose target is nearest to more rows than
    that, counting all rows. Fewer than least matches count as none.
    """
    hits = F.count("*").over(Window.partitionBy("i", "j", "target")) if most_hits else F.lit(0)
    ok = (F.col("d1") > 0) & (F.col("d2") > ratio * F.col("d1")) & (F.col("hits") <= (most_hits or 0))
    n = nearest.withColumn("hits", hits).groupBy("i", "j").agg(F.count_if(ok).alias("matches"))
    n = n.withColumn("matches", F.when(F.col("matches") >= least, F.col("matches")).otherwise(0))
    return n.join(F.broadcast(sizes.select(F.col("section").alias("i"), "n")), "i").select("i", "j", "matches", (F.col("matches") / F.col("n")).alias("pct"))  # a row per section


def symmetric(matrix: DataFrame, value: str = "pct") -> DataFrame:
    """a < b, value: the larger of both directions."""
    return matrix.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.max(value).alias(value))


def rescaled_top(matrix: DataFrame, n: int, value: str = "pct") -> DataFrame:
    """The n largest of each row over the row's maximum, times a weight that falls from 1 to 0.2 by rank; others are 0."""
    w = Window.partitionBy("i").orderBy(F.desc(value), "j")
    weight = F.lit(1.0) if n == 1 else 1 - (F.col("rank") - 1) * 0.8 / (n - 1)
    top = F.nullif(F.max(value).over(Window.partitionBy("i")), F.lit(0.0))
    ranked = matrix.withColumn("rank", F.row_number().over(w)).withColumn("top", top)
    return ranked.select("i", "j", F.when(F.col("rank") <= n, F.coalesce(F.col(value) / F.col("top"), F.lit(0.0)) * weight).otherwise(0.0).alias(value))


def row_normalised(matrix: DataFrame, value: str = "pct", by_range: bool = False) -> DataFrame:
    """z-scores by row brought to 0..1 over the whole matrix, or (x - row minimum) / row maximum."""
    w = Window.partitionBy("i")
    x = F.col(value)
    if by_range:
        return matrix.withColumn(value, (x - F.min(value).over(w)) / F.nullif(F.max(value).over(w), F.lit(0.0)))
    z = matrix.withColumn("z", F.coalesce((x - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0)), F.lit(0.0)))
    ends = z.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    return z.join(F.broadcast(ends)).select("i", "j", ((F.col("z") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).alias(value))  # one row


def all_lag_correlations(histograms: DataFrame, most: int, bins: int = 256, block: int = 500) -> DataFrame:
    """src < dst, lag, corr of every pair of histograms, as lag_correlation over all edges.

    Histograms meet in pairs of blocks of about block rows by hashes of their
    ids, so a task holds two blocks; the scores of all shifts of one pair of
    blocks are matrix products.
    """
    n = max(1, -(-histograms.count() // block))
    dealt = histograms.select("id", "counts", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("b"))
    lower, upper = (F.sequence(F.lit(0), F.col("b")), F.sequence(F.col("b"), F.lit(n - 1)))
    left = dealt.select("id", "counts", F.col("b").alias("p"), F.explode(upper).alias("q"))
    right = dealt.select(F.col("id").alias("id"), F.col("counts").alias("counts"), F.col("b").alias("q_"), F.explode(lower).alias("p_"))

    def normal(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        pdf = pdf.sort_values("id")
        c = np.stack(pdf.counts.to_numpy()).astype(np.float64)
        c -= c.mean(1, keepdims=True)
        sd = np.sqrt((c * c).mean(1, keepdims=True))
        return pdf.id.to_numpy(), np.divide(c, sd * 16, out=np.zeros_like(c), where=sd > 0)

    def compare(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"src": [], "dst": [], "lag": [], "corr": []})
        (i, x), (j, y) = normal(a), normal(b)
        first = i[:, None] < j[None]
        # Where the left id is the larger one the pair's ends change places, and with them the sign of the shift.
        keep = first | ((i[:, None] > j[None]) & (key[0] != key[1]))
        best, lag = np.full(first.shape, -np.inf), np.zeros(first.shape, np.int32)
        for k in range(-most, most + 1):
            ahead = lambda u, v, k=k: u[:, max(0, k) : bins + min(0, k)] @ v[:, max(0, -k) : bins + min(0, -k)].T
            score = ahead(x, y)
            if key[0] != key[1]:
                score = np.where(first, score, ahead(y, x).T)
            score = np.round(score, 9)
            better = score > best
            best[better], lag[better] = score[better], k
        r, c = np.nonzero(keep)
        return pd.DataFrame({"src": np.minimum(i[r], j[c]), "dst": np.maximum(i[r], j[c]), "lag": lag[r, c], "corr": best[r, c]})

    return left.groupBy("p", "q").cogroup(right.groupBy("p_", "q_")).applyInPandas(compare, "src long, dst long, lag int, corr double")


def lag_correlation(histograms: DataFrame, edges: DataFrame, most: int, bins: int = 256) -> DataFrame:
    """src, dst, lag, corr: the shift L, at most most bins, with the largest sum of x[b + L] y[b] of z-normalised histograms; the smallest on ties.

    histograms: (id, counts as a dense array). Each edge is one row with two
    arrays of fixed size, so the work per row is bounded.
    """
    score = lambda x, y, lag: F.aggregate(F.sequence(F.lit(0), F.lit(bins - 1)), F.lit(0.0), lambda t, b: t + F.coalesce(F.when((b + lag >= 0) & (b + lag < bins), F.get(x, b + lag)), F.lit(0.0)) * F.get(y, b))

    def normal(c: Column) -> Column:
        mean = F.aggregate(c, F.lit(0.0), lambda t, v: t + v, lambda t: t / bins)
        spread = lambda m: F.sqrt(F.aggregate(c, F.lit(0.0), lambda t, v: t + (v - m) * (v - m), lambda t: t / bins))
        return F.transform(F.array(mean), lambda m: F.transform(F.array(spread(m)), lambda s: F.transform(c, lambda v: F.when(s > 0, (v - m) / s / 16).otherwise(0.0)))[0])[0]

    h = histograms.select("id", normal(F.col("counts")).alias("z"))
    pair = edges.join(h.select(F.col("id").alias("src"), F.col("z").alias("x")), "src").join(h.select(F.col("id").alias("dst"), F.col("z").alias("y")), "dst")
    lags = F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda lag: F.struct((-F.round(score(F.col("x"), F.col("y"), lag), 9)).alias("less"), lag.alias("lag")))
    return pair.select("src", "dst", F.array_min(lags).alias("b")).select("src", "dst", F.col("b.lag").alias("lag"), (-F.col("b.less")).alias("corr"))



"""Fits: closed forms from sums, and consensus fits by seeded random subsets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rigid(points: DataFrame, keys: list[str], scaled: bool = False) -> DataFrame:
    """keys, n, angle, scale, tx, ty of the best rotation (and scale) of (sx, sy) onto (tx, ty): sums alone, so it combines map-side."""
    m = points.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in ("sx", "sy", "tx", "ty")))
    j = points.join(m, keys) if keys else points.join(m)
    a, b, u, v = (F.col(c) - F.col(f"m_{c}") for c in ("sx", "sy", "tx", "ty"))
    s = j.groupBy(*keys).agg(F.first("n").alias("n"), *(F.first(f"m_{c}").alias(f"m_{c}") for c in ("sx", "sy", "tx", "ty")), F.sum(a * v - b * u).alias("cross"), F.sum(a * u + b * v).alias("dot"), F.sum(a * a + b * b).alias("norm"))
    angle = F.atan2("cross", "dot")
    scale = F.sqrt(F.col("cross") ** 2 + F.col("dot") ** 2) / F.nullif("norm", F.lit(0.0)) if scaled else F.lit(1.0)
    s = s.withColumn("angle", angle).withColumn("scale", scale)
    cos, sin, k = F.cos("angle"), F.sin("angle"), F.col("scale")
    return s.select(*keys, "n", "angle", "scale", (F.col("m_tx") - k * (cos * F.col("m_sx") - sin * F.col("m_sy"))).alias("tx"), (F.col("m_ty") - k * (sin * F.col("m_sx") + cos * F.col("m_sy"))).alias("ty"))


def _solve3(m: list[Column], r: list[Column]) -> list[Column]:
    """Solution of the symmetric 3 x 3 system (m00, m01, m02, m11, m12, m22); null if it has no single one."""
    a, b, c, d, e, f = m
    det = F.nullif(a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d), F.lit(0.0))
    i = [d * f - e * e, c * e - b * f, b * e - c * d, a * f - c * c, b * c - a * e, a * d - b * b]
    return [(i[0] * r[0] + i[1] * r[1] + i[2] * r[2]) / det, (i[1] * r[0] + i[3] * r[1] + i[4] * r[2]) / det, (i[2] * r[0] + i[4] * r[1] + i[5] * r[2]) / det]


def affine(points: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """keys, n, a, b, tx, c, d, ty, r2: least squares of (tx, ty) on (sx, sy, 1), from centred moment sums.

    weight: a column that says for how many points a row stands. r2: the squared
    correlation of sx and sy; null if either is constant.
    """
    w = F.col(weight) if weight else F.lit(1)
    m = points.groupBy(*keys).agg((F.sum(w * F.col("sx")) / F.sum(w)).alias("mx"), (F.sum(w * F.col("sy")) / F.sum(w)).alias("my")) if weight else points.groupBy(*keys).agg(F.avg("sx").alias("mx"), F.avg("sy").alias("my"))
    j = points.join(m, keys) if keys else points.join(m)
    x, y, u, v = F.col("sx") - F.col("mx"), F.col("sy") - F.col("my"), F.col("tx"), F.col("ty")
    total = lambda e: F.sum(w * e) if weight else F.sum(e)
    sums = {"n": F.sum(w) if weight else F.count("*")} | {k: total(e) for k, e in {"xx": x * x, "xy": x * y, "yy": y * y, "x": x, "y": y, "xu": x * u, "yu": y * u, "u": u, "xv": x * v, "yv": y * v, "v": v}.items()}
    s = j.groupBy(*keys).agg(*(e.alias(f"s_{k}") for k, e in sums.items()), F.first("mx").alias("mx"), F.first("my").alias("my"))
    c = lambda k: F.col(f"s_{k}").cast("double")
    system = [c("xx"), c("xy"), c("x"), c("yy"), c("y"), c("n")]
    a, b, t1 = _solve3(system, [c("xu"), c("yu"), c("u")])
    g, h, t2 = _solve3(system, [c("xv"), c("yv"), c("v")])
    s = s.select(*keys, F.col("s_n").alias("n"), "mx", "my", a.alias("a"), b.alias("b"), t1.alias("t1"), g.alias("c"), h.alias("d"), t2.alias("t2"), (c("xy") * c("xy") / F.nullif(c("xx") * c("yy"), F.lit(0.0))).alias("r2"))
    return s.select(*keys, "n", "a", "b", (F.col("t1") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).alias("tx"), "c", "d", (F.col("t2") - F.col("c") * F.col("mx") - F.col("d") * F.col("my")).alias("ty"), "r2")


def slope_through_origin(rows: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    return rows.groupBy(*keys).agg((F.sum(x * y) / F.nullif(F.sum(x * x), F.lit(0.0))).alias("slope"))


def _seed(key: tuple) -> int:
    return int(pd.util.hash_array(np.array([str(key)], object))[0] & 0x7FFFFFFF)


def ransac_affine(points: DataFrame, keys: list[str], threshold: float, trials: int = 500, least: int = 4) -> DataFrame:
    """keys, n, inliers, a, b, tx, c, d, ty: the affine of the subset of three points with most points nearer than threshold, refitted on those.

    Subsets are drawn by a generator seeded from the group's key, so a result
    does not depend on where it runs. Ties go to the smaller sum of residuals.
    All subsets of a batch are solved and scored in one array operation. Without
    least inliers the numbers are null.
    """
    names = ["a", "b", "tx", "c", "d", "ty"]

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sx", "sy", "tx", "ty"])
        A = np.column_stack([pdf.sx, pdf.sy, np.ones(len(pdf))])
        B = np.column_stack([pdf.tx, pdf.ty])
        best = (-1, 0.0, None)
        rng = np.random.default_rng(_seed(key))
        for _ in range(-(-trials // 100) if len(pdf) >= 3 else 0):
            some = rng.integers(0, len(pdf), (100, 3))
            some = some[(some[:, 0] != some[:, 1]) & (some[:, 1] != some[:, 2]) & (some[:, 0] != some[:, 2])]
            some = some[np.abs(np.linalg.det(A[some])) > 1e-9]
            if not len(some):
                continue
            models = np.linalg.solve(A[some], B[some])
            loss = np.sqrt(((np.einsum("pk,mkd->mpd", A, models) - B) ** 2).sum(2))
            n, total = (loss < threshold).sum(1), loss.sum(1)
            k = np.lexsort((total, -n))[0]
            if (n[k], -total[k]) > best[:2]:
                best = (n[k], -total[k], loss[k] < threshold)
        row = {**dict(zip(keys, key, strict=True)), "n": len(pdf), "inliers": max(0, int(best[0])), **dict.fromkeys(names)}
        if best[2] is not None and best[0] >= least:
            m = np.linalg.lstsq(A[best[2]], B[best[2]], rcond=None)[0]
            row |= dict(zip(names, m.T.ravel().tolist(), strict=True))
        return pd.DataFrame([row])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema if f.name in keys)
    return points.select(*keys, "sx", "sy", "tx", "ty").groupBy(*keys).applyInPandas(fit, f"{kinds}, n long, inliers long, " + ", ".join(f"{c} double" for c in names))


def gaussian_cutoff(rows: DataFrame, keys: list[str], value: str, most: int = 3, low: float = 0.2, high: float = 0.4) -> DataFrame:
    """keys, components, cutoff: mean - 2.6 sd of the correlation mixture's main component.

    Mixtures of 1..most Gaussians are fitted by expectation maximisation from
    quantiles; the one with the smallest Bayesian criterion counts. Of several
    components the heaviest in [low, high] is the main one, else the one nearest
    the middle. The cutoff is kept within the values' range.
    """

    def em(x: np.ndarray, k: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        mean, sd, w = np.quantile(x, (np.arange(k) + 0.5) / k), np.full(k, x.std() / k + 1e-6), np.full(k, 1 / k)
        for _ in range(100):
            p = w * np.exp(-0.5 * ((x[:, None] - mean) / sd) ** 2) / sd
            total = p.sum(1, keepdims=True) + 1e-300
            r = p / total
            n = r.sum(0) + 1e-12
            mean, w = (r * x[:, None]).sum(0) / n, n / len(x)
            sd = np.sqrt((r * (x[:, None] - mean) ** 2).sum(0) / n + 1e-8)
        return -2 * float(np.log(total / np.sqrt(2 * np.pi)).sum()) + (3 * k - 1) * np.log(len(x)), mean, sd, w

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[value].dropna().to_numpy())
        row = {**dict(zip(keys, key, strict=True)), "components": 0, "cutoff": None}
        if len(x):
            _, mean, sd, w = min((em(x, k) for k in range(1, min(most, len(x)) + 1)), key=lambda f: f[0])
            inside = np.flatnonzero((mean >= low) & (mean <= high))
            k = 0 if len(mean) == 1 else int(inside[np.argmax(w[inside])]) if len(inside) else int(np.argmin(np.abs(mean - (low + high) / 2)))
            row |= {"components": len(mean), "cutoff": float(np.clip(mean[k] - 2.6 * sd[k], x[0], x[-1]))}
        return pd.DataFrame([row])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    return rows.select(*keys, value).groupBy(*keys).applyInPandas(fit, f"{kinds}, components int, cutoff double")

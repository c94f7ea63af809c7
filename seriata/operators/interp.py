"""Interpolation of vectors at points: inverse distances and moving least squares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inverse_distance(pairs: DataFrame, keys: list[str], values: list[str], power: float = 2.0) -> DataFrame:
    """keys, id, values: weighted means over pairs (id, d2, values) with weights 1 / d^power; a point at no distance gives its own values."""
    w = F.when(F.col("d2") > 0, F.pow("d2", F.lit(-power / 2)))
    at_zero = lambda v: F.avg(F.when(F.col("d2") == 0, F.col(v)))
    return pairs.groupBy(*keys, "id").agg(*(F.coalesce(at_zero(v), F.sum(w * F.col(v)) / F.sum(w)).alias(v) for v in values))


def moving_least_squares(pairs: DataFrame, keys: list[str], alpha: float = 1.0, tolerance: float = 1e-6) -> DataFrame:
    """keys, id, u, v: where a rigid moving least squares map takes a query point.

    pairs: (id, x, y, px, py, qx, qy): each query point with the control points
    (p goes to q) that count for it. Two rounds of weighted sums: the weighted
    centres, then the rotated offset, whose length is that of the query's from
    its centre. A query within tolerance of a control point takes its image.
    """
    d2 = (F.col("px") - F.col("x")) ** 2 + (F.col("py") - F.col("y")) ** 2
    p = pairs.withColumn("d2", d2).withColumn("w", F.when(F.col("d2") > tolerance * tolerance, F.pow("d2", F.lit(-alpha))))
    w = F.col("w")
    mean = lambda c: F.sum(w * F.col(c)) / F.sum("w")
    near = F.min(F.when(w.isNull(), F.struct("d2", "px", "py", "qx", "qy")))
    c = p.groupBy(*keys, "id").agg(mean("px").alias("cpx"), mean("py").alias("cpy"), mean("qx").alias("cqx"), mean("qy").alias("cqy"), near.alias("near"), F.first("x").alias("x"), F.first("y").alias("y"))
    j = p.where("w is not null").join(c.drop("x", "y", "near"), [*keys, "id"])
    a, b, u, v = F.col("px") - F.col("cpx"), F.col("py") - F.col("cpy"), F.col("qx") - F.col("cqx"), F.col("qy") - F.col("cqy")
    turn = j.groupBy(*keys, "id").agg(F.sum(w * (a * u + b * v)).alias("dot"), F.sum(w * (a * v - b * u)).alias("cross"))
    o = c.join(turn, [*keys, "id"], "left").withColumn("size", F.nullif(F.sqrt(F.col("dot") ** 2 + F.col("cross") ** 2), F.lit(0.0)))
    x, y = F.col("x") - F.col("cpx"), F.col("y") - F.col("cpy")
    cos, sin = F.coalesce(F.col("dot") / F.col("size"), F.lit(1.0)), F.coalesce(F.col("cross") / F.col("size"), F.lit(0.0))
    pick = lambda image, moved: F.when(F.col("near").isNotNull(), F.col(f"near.{image}")).otherwise(moved)
    return o.select(*keys, "id", pick("qx", cos * x - sin * y + F.col("cqx")).alias("u"), pick("qy", sin * x + cos * y + F.col("cqy")).alias("v"))

"""Queries of tile layouts: neighbour rings, reordering, filling outside a region, all pairs of histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import stats as S
from ..operators import match as D
from .registry import Tables, query
from .solvers import _HIST, _PIX, pixels


@query("d02_all_pairs_histograms", f"WITH {_HIST}, e AS (SELECT a.s_suppkey AS src, b.s_suppkey AS dst FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey), s AS (SELECT src, dst, lag_, round(sum(x.v * y.v), 9) AS c FROM e JOIN z y ON y.id = dst CROSS JOIN (SELECT unnest(range(-8, 9)) AS lag_) JOIN z x ON x.id = src AND x.b = y.b + lag_ GROUP BY 1, 2, 3) SELECT src, dst, CAST(arg_min(lag_, (-c, lag_)) AS INTEGER) AS lag, round(1 - max(c), 6) AS distance FROM s GROUP BY 1, 2")
def d02(spark, d):
    """Every pair of the histograms of one section, once: i < j; the other half is its mirror."""
    t = Tables(spark, d)
    h = S.dense(S.histogram(t.lineitem.withColumn("id", F.col("l_suppkey")), ["id"], F.col("l_quantity")), ["id"])
    h = h.join(t.supplier.select(F.col("s_suppkey").alias("id")), "id", "left_semi")
    return D.all_lag_correlations(h, 8).select("src", "dst", "lag", F.round(1 - F.col("corr"), 6).alias("distance"))


@query("c07_fill_outside", f"WITH {_PIX} SELECT image_id, y, x, CASE WHEN abs(x - 9.5) + abs(y - 9.5) < 7.7 THEN v ELSE 0 END AS v FROM px")
def c07(spark, d):
    """Pixels outside a polygon set to 0: a diamond, by the even-odd rule."""
    corners = [(1, 9.5, 1.8), (2, 17.2, 9.5), (3, 9.5, 17.2), (4, 1.8, 9.5)]
    polygon = spark.createDataFrame([(0, o, x, y) for o, x, y in corners], "section int, ord int, x double, y double")
    p = pixels(spark)
    at = p.select("y", "x").distinct().select(F.struct("y", "x").alias("point_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    inside = G.inside_polygons(at, polygon, "section", "ord").select("point_id.y", "point_id.x", F.lit(True).alias("inside"))
    return p.join(inside, ["y", "x"], "left").select("image_id", "y", "x", F.when(F.col("inside"), F.col("v")).otherwise(0).alias("v"))


@query("a12_tiles_with_rings", "WITH t AS (SELECT n_nationkey AS mfov, k AS tile, n_nationkey * 100 + k AS img FROM nation, range(7) u(k)), m AS (SELECT n_nationkey AS mfov, n_nationkey + 1 AS other, 7 + k AS place, 6 - k AS tile FROM nation, range(3) u(k)) SELECT mfov, tile AS place, img, mfov AS from_mfov FROM t UNION ALL SELECT m.mfov, m.place, t.img, t.mfov FROM m JOIN t ON t.mfov = m.other AND t.tile = m.tile")
def a12(spark, d):
    """An mFOV's own tiles and, as its outer ring, those that a neighbour map takes from other mFOVs."""
    n = Tables(spark, d).nation.select(F.col("n_nationkey").alias("mfov"))
    t = n.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long")))).withColumn("img", F.col("mfov") * 100 + F.col("tile"))
    m = n.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).select("mfov", (F.col("mfov") + 1).alias("other"), (7 + F.col("k")).alias("place"), (6 - F.col("k")).alias("tile"))
    ring = m.join(t.select(F.col("mfov").alias("other"), "tile", "img"), ["other", "tile"]).select("mfov", "place", "img", F.col("other").alias("from_mfov"))
    return t.select("mfov", F.col("tile").alias("place"), "img", F.col("mfov").alias("from_mfov")).unionByName(ring)


@query("d16_rect_to_hex_order", "WITH l AS (SELECT k AS tile, (k * 5) % 61 AS rect FROM range(61) t(k)) SELECT s_suppkey AS mfov, tile, s_suppkey * 61 + rect AS img, row_number() OVER (ORDER BY s_suppkey DESC, tile) AS ord FROM supplier, l")
def d16(spark, d):
    """Tiles in the order of a hexagon from a table of their rectangular one; earlier mFOVs come last, so they end on top."""
    s = Tables(spark, d).supplier.select(F.col("s_suppkey").alias("mfov"))
    layout = spark.range(61).select(F.col("id").alias("tile"), (F.col("id") * 5 % 61).alias("rect"))
    last = s.agg(F.max("mfov").alias("last"), F.count("*").alias("n"))
    return s.join(F.broadcast(layout)).join(F.broadcast(last)).select("mfov", "tile", (F.col("mfov") * 61 + F.col("rect")).alias("img"), ((F.col("last") - F.col("mfov")) * 61 + F.col("tile") + 1).alias("ord"))  # 61 rows and one row

"""Queries of whole lifecycles on planted stacks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..operators import fit as K
from ..operators import neighbors as N
from ..operators import stitch
from .registry import Tables, query
from .solvers import _P, points


@query("j15_two_pass_stitch", "SELECT n_regionkey AS section, n_nationkey AS mfov, n AS node, round(CASE WHEN n < 18 THEN CAST((n + 1) * 37 % 101 - n * 37 % 101 AS DOUBLE) END, 5) AS step FROM nation, range(19) t(n)")
def j15(spark, d):
    """mFOVs of 19 tiles with planted places; one edge in nine of each is far off, each mFOV's others: medians put them right."""
    pos = lambda n: (n * 37 % 101).cast("double")
    m = F.col("n_nationkey")
    e = Tables(spark, d).nation.select(F.col("n_regionkey").alias("section"), m.alias("mfov"), F.explode(F.sequence(F.lit(0), F.lit(17))).alias("src")).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("dst", F.col("src") + F.col("k")).where("dst < 19")
    off = F.when((F.col("src") * 5 + F.col("k") * 3 + F.floor(F.col("mfov") / 5)) % 9 == 0, 40.0).otherwise(0.0)
    e = e.select("section", "mfov", "src", "dst", (pos(F.col("src")) - pos(F.col("dst")) + off).alias("dx"), (pos(F.col("dst")) - pos(F.col("src"))).alias("dy"), F.lit(0.9).alias("corr"), F.lit(1.0).alias("w"))
    solved = stitch.two_pass_stitch(e, "section", "mfov", 5.0, 0.5)
    w = Window.partitionBy("section", "mfov").orderBy("node")
    return solved.select("section", "mfov", "node", F.round(F.lead("x").over(w) - F.col("x"), 5).alias("step"))


@query("k16_rough_reconcile", "SELECT z, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, CASE WHEN z % 8 < 7 THEN 3.0::DOUBLE END AS sx, CASE WHEN z % 8 < 7 THEN -2.0::DOUBLE END AS sy FROM range(24) t(z)")
def k16(spark, d):
    """Affines between sections that drift by (3, -2) a section: the refitted ones drift alike within each chunk."""
    grid = G.hex_grid(spark, 5, 6, 16.0)
    pair = spark.range(24).select(F.col("id").alias("z"), F.explode(F.array(*map(F.lit, (-2, -1, 1, 2)))).alias("k")).where("z + k >= 0 and z + k < 24")
    affines = pair.select("z", "k", F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), (3.0 * F.col("k")).alias("tx"), F.lit(0.0).alias("c"), F.lit(1.0).alias("d"), (-2.0 * F.col("k")).alias("ty"))
    a = stitch.rough_reconcile(affines, grid, 8, 4)
    w = Window.partitionBy(F.floor(F.col("z") / 8)).orderBy("z")
    step = a.withColumn("sx", F.lead("tx").over(w) - F.col("tx")).withColumn("sy", F.lead("ty").over(w) - F.col("ty"))
    near = lambda c: (F.round(c, 5) + 0.0).alias(c)
    return step.select("z", *map(near, ("a", "b", "sx", "sy")))


@query("k17_deltas_to_rigid", "SELECT p_brand, round(atan2(-0.6, 0.8), 6) AS angle, count(*) AS n FROM part GROUP BY 1")
def k17(spark, d):
    """Rigid maps from deltas in the inverse sense: grid + delta goes to grid."""
    x, y = F.col("p_size").cast("double"), F.col("p_retailprice")
    rows = Tables(spark, d).part.select("p_brand", (0.8 * x - 0.6 * y + 4).alias("sx"), (0.6 * x + 0.8 * y - 1).alias("sy"), x.alias("tx"), y.alias("ty"))
    return K.rigid(rows, ["p_brand"]).select("p_brand", F.round("angle", 6).alias("angle"), "n")


@query("m05_m06_interpolate_outliers", f"WITH {_P} SELECT id, round(0.8 * x - 0.6 * y + 5 - x, 5) AS dx, round(0.6 * x + 0.8 * y - 2 - y, 5) AS dy FROM p a WHERE id % 10 <> 0 OR (SELECT count(DISTINCT (b.x, b.y)) FROM p b WHERE b.id % 10 <> 0 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 25) >= 3")
def m05(spark, d):
    """Deltas of one point in ten taken from their nearest inliers; a rigid field comes back exactly."""
    x, y = F.col("x"), F.col("y")
    p = points(Tables(spark, d)).select("id", "x", "y", (0.8 * x - 0.6 * y + 5 - x).alias("dx"), (0.6 * x + 0.8 * y - 2 - y).alias("dy"), (F.col("id") % 10 == 0).alias("outlier"))
    filled = stitch.interpolate_outliers(p, 5.0, 8).where("dx is not null")
    xy = lambda rows: rows.select("x", "y").distinct()
    few = N.near_places(xy(p.where("outlier")), xy(p.where("not outlier")), 5.0).groupBy("x", "y").agg(F.count("*").alias("n")).where("n >= 3").select("x", "y", F.lit(True).alias("ok"))
    return N.at_places(filled, few, how="left").where("not outlier or ok").select("id", F.round("dx", 5).alias("dx"), F.round("dy", 5).alias("dy"))


_GRID = "g AS (SELECT i % 22 AS col, i // 22 AS row FROM range(572) t(i)), t AS (SELECT a.col, a.row, 0 AS half FROM g a JOIN g b ON b.col = a.col + 1 AND b.row = a.row JOIN g c ON c.col = a.col + a.row % 2 AND c.row = a.row + 1 UNION ALL SELECT a.col, a.row, 1 FROM g a JOIN g b ON b.col = a.col + a.row % 2 - 1 AND b.row = a.row + 1 JOIN g c ON c.col = a.col + a.row % 2 AND c.row = a.row + 1)"


@query("j08_hex_triangles", f"WITH {_GRID} SELECT half, count(*) AS n FROM t GROUP BY 1")
def j08(spark, d):
    t = stitch.hex_triangles(G.hex_grid(spark, 22, 26, 16.0))
    return t.groupBy((F.col("tri_id") % 2).alias("half")).agg(F.count("*").alias("n"))


@query("j07_vertices_to_points", "SELECT 572 AS points, true AS constant_kept, true AS linear_inside")
def j07(spark, d):
    """A field on the triangles' centres at the points: constants stay everywhere, a linear field stays at inner points."""
    grid = G.hex_grid(spark, 22, 26, 16.0)
    tri = stitch.hex_triangles(grid)
    at = stitch.vertices_to_points(tri.select("tri_id", F.lit(7.0).alias("one"), (2 * F.col("cx") - F.col("cy")).alias("line")), tri, grid, ["one", "line"])
    j = at.join(grid.select(F.col("grid_id").alias("id"), "col", "row", "x", "y"), "id")
    inner = (F.col("col") > 0) & (F.col("col") < 21) & (F.col("row") > 0) & (F.col("row") < 25)
    off = F.when(inner, F.abs(F.col("line") - (2 * F.col("x") - F.col("y")))).otherwise(0.0)
    return j.agg(F.count("*").cast("int").alias("points"), (F.max(F.abs(F.col("one") - 7)) < 1e-9).alias("constant_kept"), (F.max(off) < 1e-6).alias("linear_inside"))

"""Compositions: two-pass stitching, rough reconcile with refit, interpolation of outliers, grid triangles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fit, interp, neighbors, solve


def two_pass_stitch(edges: DataFrame, section: str, mfov: str, tolerance: float, cutoff: float) -> DataFrame:
    """section, mfov, node, x, y: tile positions of edges (section, mfov, src, dst, dx, dy, corr, w).

    The medians over a section's mFOVs of what correlated better than cutoff
    become the default of each edge; deltas that correlate worse, or lie farther
    than tolerance from the default, take the default with a tenth of the weight.
    """
    good = F.col("corr") > cutoff
    mid = edges.groupBy(section, "src", "dst").agg(F.median(F.when(good, F.col("dx"))).alias("mx"), F.median(F.when(good, F.col("dy"))).alias("my"))
    e = edges.join(mid, [section, "src", "dst"])
    off = ~good | (F.abs(F.col("dx") - F.col("mx")) > tolerance) | (F.abs(F.col("dy") - F.col("my")) > tolerance)
    use = e.select(section, mfov, "src", "dst", F.when(off, F.col("mx")).otherwise(F.col("dx")).alias("dx"), F.when(off, F.col("my")).otherwise(F.col("dy")).alias("dy"), F.when(off, F.col("w") * 0.1).otherwise(F.col("w")).alias("w"))
    return solve.group_least_squares(use.where("dx is not null and dy is not null"), [section, mfov])


def grid_deltas(affines: DataFrame, grid: DataFrame) -> DataFrame:
    """vertex, z, k, dx, dy, w: what the affine of sections z and z + k moves each grid point by. grid is a dimension table."""
    at = affines.join(F.broadcast(grid.select(F.col("grid_id").alias("vertex"), "x", "y")))  # a grid has a fixed number of points
    dx = F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("tx") - F.col("x")
    dy = F.col("c") * F.col("x") + F.col("d") * F.col("y") + F.col("ty") - F.col("y")
    return at.select("vertex", "z", "k", dx.alias("dx"), dy.alias("dy"), F.lit(1.0).alias("w"))


def rough_reconcile(affines: DataFrame, grid: DataFrame, chunk: int, reach: int) -> DataFrame:
    """z, a, b, tx, c, d, ty: one affine per section from pairwise ones (z, k, a, b, tx, c, d, ty): grid deltas, reconcile, refit on the grid."""
    solved = solve.reconcile(grid_deltas(affines, grid), chunk, reach)
    moved = solved.withColumnRenamed("x", "ox").withColumnRenamed("y", "oy").join(F.broadcast(grid.select(F.col("grid_id").alias("vertex"), "x", "y")), "vertex")
    return fit.affine(moved.select("z", F.col("x").alias("sx"), F.col("y").alias("sy"), (F.col("x") + F.col("ox")).alias("tx"), (F.col("y") + F.col("oy")).alias("ty")), ["z"])


def interpolate_outliers(points: DataFrame, radius: float, k: int) -> DataFrame:
    """points (id, x, y, dx, dy, outlier) with the deltas of outliers taken from moving least squares over the k nearest places of inliers within radius.

    Inliers of one place count once, by the mean of their deltas: copies say
    nothing about a rotation. An outlier without an inlier in reach has null
    deltas; both are null or neither.
    """
    out, ok = points.where("outlier"), points.where("not outlier")
    sites = neighbors.places(ok, [], F.avg("dx").alias("dx"), F.avg("dy").alias("dy")).drop("n")
    near = neighbors.nearest_places(neighbors.places(out).drop("n"), sites, radius, k)
    pairs = near.select("id", "x", "y", F.col("x_r").alias("px"), F.col("y_r").alias("py"), (F.col("x_r") + F.col("dx_r")).alias("qx"), (F.col("y_r") + F.col("dy_r")).alias("qy"))
    moved = interp.moving_least_squares(pairs, []).join(neighbors.places(out).select("id", "x", "y"), "id")
    moved = moved.select("x", "y", (F.col("u") - F.col("x")).alias("dx"), (F.col("v") - F.col("y")).alias("dy"))
    filled = neighbors.at_places(out.drop("dx", "dy"), moved, how="left")
    return ok.unionByName(filled.select(points.columns))


def hex_triangles(grid: DataFrame) -> DataFrame:
    """tri_id, p0, p1, p2, cx, cy: the triangles of a hexagonal grid from its rows' parity; equal sides make the centre the circumcentre."""
    shift = F.col("row") % 2
    corner = lambda c, r: F.struct(c.alias("col"), r.alias("row"))
    col, row = F.col("col"), F.col("row")
    both = F.array(F.array(corner(col + 1, row + 0), corner(col + shift, row + 1)), F.array(corner(col + shift - 1, row + 1), corner(col + shift, row + 1)))
    t = grid.select(F.col("grid_id").alias("p0"), "x", "y", F.posexplode(both).alias("half", "c")).select("p0", "x", "y", "half", F.col("c")[0].alias("c1"), F.col("c")[1].alias("c2"))
    side = lambda k: grid.select(F.struct("col", "row").alias(f"c{k}"), F.col("grid_id").alias(f"p{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    j = t.join(side(1), "c1").join(side(2), "c2")
    return j.select((F.col("p0") * 2 + F.col("half")).alias("tri_id"), "p0", "p1", "p2", ((F.col("x") + F.col("x1") + F.col("x2")) / 3).alias("cx"), ((F.col("y") + F.col("y1") + F.col("y2")) / 3).alias("cy"))


def vertices_to_points(values: DataFrame, triangles: DataFrame, grid: DataFrame, columns: list[str], power: float = 2.0) -> DataFrame:
    """id, columns: values of triangle centres (tri_id, ...) brought to the grid points around them by inverse distances."""
    corner = triangles.select("tri_id", "cx", "cy", F.explode(F.array("p0", "p1", "p2")).alias("id"))
    j = corner.join(grid.select(F.col("grid_id").alias("id"), "x", "y"), "id").join(values, "tri_id")
    return interp.inverse_distance(j.withColumn("d2", (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2), [], columns, power)

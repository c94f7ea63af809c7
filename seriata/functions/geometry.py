"""Scalar geometry as column expressions: angles, polygons, hex grids, blocks, affine maps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def wrap_angle(a: Column) -> Column:
    """An angle in radians in [-pi, pi)."""
    return a - 2 * math.pi * F.floor((a + math.pi) / (2 * math.pi))


def direction_angle(dx: Column, dy: Column) -> Column:
    """The direction of a step in an image (y grows downwards), in [0, 2 pi)."""
    a = F.atan2(-dy, dx)
    return F.when(a < 0, a + 2 * math.pi).otherwise(a)


def near_square_divisor(n: Column) -> Column:
    """The largest divisor of n up to its square root; null below 1."""
    return F.when(n >= 1, F.array_max(F.filter(F.sequence(F.lit(1), F.floor(F.sqrt(n)).cast("int")), lambda d: n % d == 0)))


def hex_tiles(diameter: Column) -> Column:
    """Tiles of a hexagon with an odd number of tiles across."""
    return ((3 * diameter * diameter + 1) / 4).cast("long")


def hex_diameter(tiles: Column) -> Column:
    """The diameter of a hexagon of that many tiles, 0 if no hexagon has as many."""
    d = F.floor(F.sqrt((4 * tiles - 1) / 3))
    return F.when((d % 2 == 1) & (hex_tiles(d) == tiles), d).otherwise(0).cast("long")


def hex_grid(spark: SparkSession, columns: int, rows: int, spacing: float = 1.0) -> DataFrame:
    """grid_id, col, row, x, y of a hexagonal grid about the origin: every other row half a step to the right; point 0 lies nearest the origin."""
    cells = spark.range(columns * rows).select((F.col("id") % columns).cast("int").alias("col"), F.floor(F.col("id") / columns).cast("int").alias("row"))
    height = math.sqrt(3) / 2 * spacing
    x = (F.col("col") + (F.col("row") % 2) * 0.5 - (columns - 1) / 2 - 0.25) * spacing
    y = (F.col("row") - (rows - 1) / 2) * height
    placed = cells.select("col", "row", x.alias("x"), y.alias("y"))
    first = placed.agg(F.min(F.struct(F.round(F.col("x") ** 2 + F.col("y") ** 2, 9).alias("d"), "row", "col")).alias("f")).select(F.col("f.row").alias("r0"), F.col("f.col").alias("c0"))
    plain = F.col("row") * columns + F.col("col")
    center = F.col("r0") * columns + F.col("c0")
    number = F.when(plain == center, 0).when(plain < center, plain + 1).otherwise(plain)
    return placed.join(F.broadcast(first)).select(number.cast("int").alias("grid_id"), "col", "row", "x", "y")  # one row


def hex_edges(grid: DataFrame) -> DataFrame:
    """src, dst, edge_type of neighbours in the grid of hex_grid: 1 along a row, 2 down right, 3 down left; src stands first."""
    shift = F.col("row") % 2
    step = lambda t, col, row: F.struct(F.lit(t).alias("edge_type"), col.alias("col"), row.alias("row"))
    steps = F.array(step(1, F.col("col") + 1, F.col("row") + 0), step(2, F.col("col") + shift, F.col("row") + 1), step(3, F.col("col") + shift - 1, F.col("row") + 1))
    near = grid.select(F.col("grid_id").alias("src"), F.explode(steps).alias("s")).select("src", "s.*")
    return near.join(grid.select(F.col("grid_id").alias("dst"), "col", "row"), ["col", "row"]).select("src", "dst", "edge_type")


def shoelace(polygons: DataFrame, key: str, order: str, x: str = "x", y: str = "y") -> DataFrame:
    """key, n, area (signed), cx, cy of open polygons; the centroid of one without area is null."""
    ring = F.transform(F.array_sort(F.collect_list(F.struct(order, x, y))), lambda p: F.struct(p[x].alias("x"), p[y].alias("y")))
    one = polygons.groupBy(key).agg(ring.alias("ring"), F.count("*").alias("n"))
    nxt = F.concat(F.slice("ring", 2, F.col("n").cast("int")), F.slice("ring", 1, 1))
    pairs = F.zip_with("ring", nxt, lambda p, q: F.struct((p["x"] * q["y"] - q["x"] * p["y"]).alias("c"), (p["x"] + q["x"]).alias("sx"), (p["y"] + q["y"]).alias("sy")))
    total = lambda f: F.aggregate("pairs", F.lit(0.0), lambda t, p: t + f(p))
    area = total(lambda p: p["c"]) / 2
    some = F.when(F.col("area") != 0, 6 * F.col("area"))
    return one.withColumn("pairs", pairs).withColumn("area", area).select(key, "n", "area", (total(lambda p: p["sx"] * p["c"]) / some).alias("cx"), (total(lambda p: p["sy"] * p["c"]) / some).alias("cy"))


def edges_of(polygons: DataFrame, key: str, order: str, x: str = "x", y: str = "y") -> DataFrame:
    """key, x1, y1, x2, y2 of every edge, the closing one too."""
    ring = F.transform(F.array_sort(F.collect_list(F.struct(order, x, y))), lambda p: F.struct(p[x].alias("x"), p[y].alias("y")))
    one = polygons.groupBy(key).agg(ring.alias("ring"))
    nxt = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    return one.select(key, F.explode(F.zip_with("ring", nxt, lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))).alias("e")).select(key, "e.*")


def inside_polygons(points: DataFrame, polygons: DataFrame, key: str, order: str, id_: str = "point_id") -> DataFrame:
    """id, key of the points inside each polygon by the even-odd rule. Polygons are a dimension table: their edge arrays are joined whole."""
    ring = edges_of(polygons, key, order).groupBy(key).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"), F.min("x1").alias("x_lo"), F.max("x1").alias("x_hi"), F.min("y1").alias("y_lo"), F.max("y1").alias("y_hi"))
    x, y = F.col("x"), F.col("y")
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.when(e["y2"] != e["y1"], e["y2"] - e["y1"]) + e["x1"])
    box = (x >= F.col("x_lo")) & (x <= F.col("x_hi")) & (y >= F.col("y_lo")) & (y <= F.col("y_hi"))
    return points.join(ring, box).where(F.size(F.filter("edges", crosses)) % 2 == 1).select(id_, key)


def scale_about_centroid(polygons: DataFrame, key: str, order: str, factor: float) -> DataFrame:
    """The vertices moved away from the polygon's centroid by a factor; those of a polygon without area stay."""
    c = shoelace(polygons, key, order).select(key, "cx", "cy")
    moved = lambda v: F.coalesce((F.col(v) - F.col(f"c{v}")) * factor + F.col(f"c{v}"), F.col(v))
    return polygons.join(c, key).select(key, order, moved("x").alias("x"), moved("y").alias("y"))


def block_ranges(n: int, blocks: int, overlap: int = 0) -> list[tuple[int, int, int]]:
    """(block, begin, end) of n items in blocks of nearly equal size, the longer first, with overlap at inner edges."""
    size, more = divmod(n, blocks)
    begin = lambda k: k * size + min(k, more)
    return [(k, max(0, begin(k) - (overlap if k else 0)), min(n, begin(k + 1) + (overlap if k < blocks - 1 else 0))) for k in range(blocks)]


def affine_parts(a: Column, b: Column, c: Column, d: Column) -> dict[str, Column]:
    """Polar parts of [[a, b], [c, d]] = R P: angle, scales P00 and P11, shears P01/P00 and P01/P11."""
    angle = F.atan2(c - b, a + d)
    cos, sin = F.cos(angle), F.sin(angle)
    p00, p01, p11 = cos * a + sin * c, cos * b + sin * d, -sin * b + cos * d
    return {"angle": angle, "scale_x": p00, "scale_y": p11, "shear_x": p01 / F.nullif(p00, F.lit(0.0)), "shear_y": p01 / F.nullif(p11, F.lit(0.0))}


def circumcentre(ax, ay, bx, by, cx, cy) -> tuple[Column, Column]:
    """The centre of the circle through three points; null if they are in line."""
    d = F.nullif(2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by)), F.lit(0.0))
    a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    return (a2 * (by - cy) + b2 * (cy - ay) + c2 * (ay - by)) / d, (a2 * (cx - bx) + b2 * (ax - cx) + c2 * (bx - ax)) / d


def polynomial_features(x: Column, y: Column, degree: int) -> list[Column]:
    """1, x, y, x^2, x y, y^2, ... up to a degree."""
    power = lambda v, k: F.lit(1.0) if k == 0 else v if k == 1 else F.pow(v, F.lit(k))
    return [power(x, n - k) * power(y, k) for n in range(degree + 1) for k in range(n + 1)]


def polynomial_degree(terms: Column) -> Column:
    return ((F.sqrt(8 * terms + 1) - 3) / 2).cast("int")


def apply_affine(x: Column, y: Column, m: tuple) -> tuple[Column, Column]:
    """(a x + b y + tx, c x + d y + ty) for m = (a, b, tx, c, d, ty)."""
    a, b, tx, c, d, ty = m
    return a * x + b * y + tx, c * x + d * y + ty


def inverse_affine(a, b, tx, c, d, ty) -> tuple[Column, ...]:
    """The inverse map's six numbers; null where there is none."""
    det = F.nullif(a * d - b * c, F.lit(0.0))
    ia, ib, ic, id_ = d / det, -b / det, -c / det, a / det
    return ia, ib, -(ia * tx + ib * ty), ic, id_, -(ic * tx + id_ * ty)


def clip_intensity(v: Column, adjust: Column | float = 0.0, ratio: Column | float = 1.0, decay: Column | float = 1.0) -> Column:
    """A grey level with its adjustment added, divided by ratio and decay, rounded half to even and clipped to 0..255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.bround((v + adjust) / ratio / decay).cast("int")))

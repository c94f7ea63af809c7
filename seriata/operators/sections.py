"""Sections as tables: manifests, rings of polygons, transforms of coordinates and the images drawn through them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from . import fit as K
from .order import solve_order


def find_folders(folders: DataFrame, sections: DataFrame, digits: str = r"_([0-9]+)$") -> DataFrame:
    """section, folder of each listed section, by the number at a folder's end; a section without exactly one folder is an error.

    folders: (folder); sections: (section). An equality of numbers stands for 'ends with', so the listing is joined, not searched.
    """
    number = F.regexp_extract("folder", digits, 1)
    found = folders.where(number != "").select(number.cast("long").alias("section"), "folder")
    g = sections.select("section").distinct().join(found, "section", "left").groupBy("section").agg(F.count("folder").alias("n"), F.min("folder").alias("folder"))
    one = F.when(F.col("n") == 1, F.col("folder")).otherwise(F.raise_error(F.concat(F.lit("section "), F.col("section").cast("string"), F.lit(" has folders: "), F.col("n").cast("string"))))
    return g.select("section", one.alias("folder"))


def open_rings(points: DataFrame, keys: list[str], order: str, scale: float = 1.0) -> DataFrame:
    """keys, ord, x, y of rings without points that repeat the one before, and without a last point that equals the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    p = points.withColumn("x", F.col("x") * scale).withColumn("y", F.col("y") * scale)
    at = F.struct("x", "y")
    p = p.withColumn("before_", F.lag(at).over(w)).where(F.col("before_").isNull() | (F.col("before_") != at))
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = p.withColumn("ord", F.row_number().over(w) - 1).withColumn("n_", F.count("*").over(all_)).withColumn("first_", F.first(at).over(all_))
    closing = (F.col("ord") > 0) & (F.col("ord") == F.col("n_") - 1) & (F.col("first_") == at)
    return p.where(~closing).select(*keys, "ord", "x", "y")


def reload_coordinates(solved: DataFrame, stage: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    """solved with x, y moved so that their least lies at zero, scaled, and anchored at the least stage coordinates of the section."""
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    least = solved.groupBy(*keys).agg(F.min(number("x")).alias("x0_"), F.min(number("y")).alias("y0_"))
    corner = stage.groupBy(*keys).agg(F.min(number("x")).alias("cx_"), F.min(number("y")).alias("cy_"))
    j = solved.join(least, keys).join(corner, keys)
    return j.withColumn("x", scale * (F.col("x") - F.col("x0_")) + F.col("cx_")).withColumn("y", scale * (F.col("y") - F.col("y0_")) + F.col("cy_")).drop("x0_", "y0_", "cx_", "cy_")


def permuted_chunks(rows: DataFrame, keys: list[str], id_: str, chunks: int, seed: int = 0) -> DataFrame:
    """rows with place and chunk: a seeded permutation of each group in runs of nearly equal size, the longer first."""
    w = Window.partitionBy(*keys)
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_).cast("string")).cast("binary"))
    r = rows.withColumn("place", F.row_number().over(w.orderBy(mixed, id_)) - 1).withColumn("n_", F.count("*").over(w))
    small, more = F.floor(F.col("n_") / chunks), F.col("n_") % chunks
    late = more + F.floor((F.col("place") - more * (small + 1)) / F.greatest(small, F.lit(1)))
    chunk = F.when(F.col("place") < more * (small + 1), F.floor(F.col("place") / (small + 1))).otherwise(late)
    return r.withColumn("chunk", chunk.cast("int")).drop("n_")


def without_low_peak(counts: Column, smooth: Column, mode: Column, floor: Column, least: float = 0.1) -> Column:
    """A histogram as shares, in which a second peak below the dip under the mode is a ramp from floor up to the dip.

    The dip is the first bin down from the mode under which the smoothed counts
    rise again; nothing changes without one, or if the peak's height over the
    dip is at most least of the mode's count. mode counts from 0; below 0 there is none.
    """
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    shares = F.transform(counts, lambda x: x / F.nullif(total, F.lit(0.0)))
    rises = F.filter(F.sequence(F.lit(0), F.greatest(mode, F.lit(1)) - 1), lambda i: (i < mode) & (F.get(smooth, i) > F.get(smooth, i + 1)))
    dip = F.array_max(rises) + 1
    height = F.array_max(F.slice(counts, 1, dip + 1)) - F.get(counts, dip)
    ramp = F.transform(shares, lambda x, i: F.when(i <= dip, floor + (F.get(shares, dip) - floor) * i / dip).otherwise(x))
    return F.when((mode >= 0) & (height / F.get(counts, mode) > least), ramp).otherwise(shares)


def nonuniform(points: DataFrame, keys: list[str], eps: float = 2.220446049250313e-16) -> DataFrame:
    """keys, n, angle, scale_x, scale_y, tx, ty, vaf of the best (tx, ty) = R(angle) diag(scale_x, scale_y) (sx, sy) + t.

    For a given angle the scales are ratios of sums, and what they explain is a
    quadratic form of (cos, sin); its two principal directions are all the
    candidates. Those with a negative scale are left out; the fit is null if
    none stays, an extent is empty, or the form's mixed term vanishes.
    """
    m = points.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in ("sx", "sy", "tx", "ty")))
    a, b, u, v = (F.col(c) - F.col(f"m_{c}") for c in ("sx", "sy", "tx", "ty"))
    sums = {"c1": a * a, "c2": b * b, "au": a * u, "av": a * v, "bu": b * u, "bv": b * v, "uv": u * u + v * v}
    s = points.join(m, keys).groupBy(*keys, "n", *(f"m_{c}" for c in ("sx", "sy", "tx", "ty"))).agg(*(F.sum(e).alias(k) for k, e in sums.items()))
    c1, c2, au, av, bu, bv, uv = (F.col(k) for k in sums)
    mixed = au * av * c2 - bu * bv * c1
    fits = (F.abs(4 * mixed) >= eps) & (2 * c1 >= eps) & (2 * c2 >= eps)
    axis = F.atan2(2 * mixed / (c1 * c2), (au * au - av * av) / c1 + (bv * bv - bu * bu) / c2) / 2
    s = s.withColumn("axis", F.when(fits, axis))

    def candidate(turn: float) -> Column:
        cos, sin = F.cos(F.col("axis") + turn), F.sin(F.col("axis") + turn)
        p, q = (au * cos + av * sin) / c1, (bv * cos - bu * sin) / c2
        sign = F.when((p < 0) & (q < 0), -1.0).otherwise(1.0)
        left = uv - 2 * (p * (au * cos + av * sin) + q * (bv * cos - bu * sin)) + p * p * c1 + q * q * c2
        fit = F.struct((1 - left / F.nullif(uv, F.lit(0.0))).alias("vaf"), F.atan2(sign * sin, sign * cos).alias("angle"), (sign * p).alias("scale_x"), (sign * q).alias("scale_y"))
        return F.when(F.col("axis").isNotNull() & (sign * p >= 0) & (sign * q >= 0), fit)

    quarter = 1.5707963267948966
    s = s.withColumn("best", F.array_max(F.array(candidate(0.0), candidate(quarter)))).select("*", "best.*")
    cos, sin, x, y = F.cos("angle"), F.sin("angle"), F.col("scale_x") * F.col("m_sx"), F.col("scale_y") * F.col("m_sy")
    return s.select(*keys, "n", "angle", "scale_x", "scale_y", (F.col("m_tx") - cos * x + sin * y).alias("tx"), (F.col("m_ty") - sin * x - cos * y).alias("ty"), "vaf")


def predict(points: DataFrame, fits: DataFrame, keys: list[str], x: str = "sx", y: str = "sy") -> DataFrame:
    """points with px, py: where the group's fit puts them. fits: keys and a, b, tx, c, d, ty, or angle, tx, ty and one scale, two or none."""
    if "a" in fits.columns:
        m = tuple(F.col(c) for c in ("a", "b", "tx", "c", "d", "ty"))
    else:
        one = F.col("scale") if "scale" in fits.columns else F.lit(1.0)
        k1, k2 = (F.col("scale_x"), F.col("scale_y")) if "scale_x" in fits.columns else (one, one)
        cos, sin = F.cos("angle"), F.sin("angle")
        m = (cos * k1, -sin * k2, F.col("tx"), sin * k1, cos * k2, F.col("ty"))
    f = fits.select(*keys, F.struct(*(e.alias(f"m{i}") for i, e in enumerate(m))).alias("fit_"))
    px, py = G.apply_affine(F.col(x), F.col(y), tuple(F.col(f"fit_.m{i}") for i in range(6)))
    return points.join(f, keys).withColumn("px", px).withColumn("py", py).drop("fit_")


def roi_rotations(points: DataFrame, old: DataFrame, key: str, least: float = 0.99) -> DataFrame:
    """key, rotation, vaf: minus the angle of the rigid fit of a section's corners onto the wanted ones, the old rotation where it explains less than least.

    points: (key, sx, sy, tx, ty); old: (key, rotation). Images turn against their points.
    """
    fits = K.rigid(points, [key])
    miss = (F.col("px") - F.col("tx")) ** 2 + (F.col("py") - F.col("ty")) ** 2
    placed = predict(points, fits, [key]).groupBy(key).agg(F.avg(miss).alias("miss"), (F.var_pop("tx") + F.var_pop("ty")).alias("var"))
    vaf = 1 - F.col("miss") / F.nullif("var", F.lit(0.0))
    j = old.join(fits.select(key, "angle"), key, "left").join(placed.select(key, vaf.alias("vaf")), key, "left")
    return j.select(key, F.when(F.col("vaf") >= least, -F.col("angle")).otherwise(F.col("rotation")).alias("rotation"), "vaf")


def filter_by_roi(features: DataFrame, polygons: DataFrame, key: str, order: str, scale: float = 1.0, id_: str = "kp_id") -> DataFrame:
    """The features within their own section's polygon; polygons are scaled to the features' pixels, a section without one keeps nothing."""
    e = G.edges_of(polygons, key, order)
    x1, y1, x2, y2 = (F.col(c) * scale for c in ("x1", "y1", "x2", "y2"))
    f = features.select(key, id_, "x", "y")
    across = ((y1 > F.col("y")) != (y2 > F.col("y"))) & (F.col("x") < (x2 - x1) * (F.col("y") - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)
    inside = f.join(e, key).where(across).groupBy(key, id_).agg(F.count("*").alias("n_")).where("n_ % 2 = 1")
    return features.join(inside.select(key, id_), [key, id_], "left_semi")


def comparison_list(adjacency: DataFrame, images: int) -> DataFrame:
    """image, template of every pair (x, y) of an adjacency: y is searched for x's template, of its upper kind (x + images) where x < y."""
    x, y = F.col("x"), F.col("y")
    return adjacency.where("adjacent > 0").select(y.alias("image"), F.when(x < y, x + images).otherwise(x).alias("template"))


def distance_order(pairs: DataFrame, value: str = "distance") -> DataFrame:
    """solve_order on 1 - distance / max / 2, so the nearest neighbours match best."""
    top = pairs.agg(F.max(value).alias("top_"))  # one row
    share = 1 - F.coalesce(F.col(value) / F.nullif("top_", F.lit(0.0)), F.lit(0.0)) / 2
    return solve_order(pairs.join(F.broadcast(top)).withColumn("share_", share), "share_")


def turn_in_scene(polygons: DataFrame, scenes: DataFrame, keys: list[str], scene: str) -> DataFrame:
    """keys, scene, ord, x, y, in_scene: vertices relative to their scene, turned about the middle of the polygon's bounding box.

    polygons: (keys, scene, ord, x, y, rotation); scenes: (scene, corner_x,
    corner_y, width, height). in_scene: whether any turned vertex lies in the scene.
    """
    p = polygons.join(scenes, scene).withColumn("x", F.col("x") - F.col("corner_x")).withColumn("y", F.col("y") - F.col("corner_y"))
    w = Window.partitionBy(*keys, scene)
    mid = lambda c: (F.min(c).over(w) + F.max(c).over(w)) / 2
    p = p.withColumn("mx_", mid("x")).withColumn("my_", mid("y"))
    cos, sin, a, b = F.cos("rotation"), F.sin("rotation"), F.col("x") - F.col("mx_"), F.col("y") - F.col("my_")
    p = p.withColumn("tx_", cos * a - sin * b + F.col("mx_")).withColumn("ty_", sin * a + cos * b + F.col("my_"))
    within = (F.col("tx_") >= 0) & (F.col("tx_") < F.col("width")) & (F.col("ty_") >= 0) & (F.col("ty_") < F.col("height"))
    return p.select(*keys, scene, "ord", F.col("tx_").alias("x"), F.col("ty_").alias("y"), F.max(within).over(w).alias("in_scene"))


def original_order(sections: DataFrame, reimaged: DataFrame) -> DataFrame:
    """part, place, name, item: re-images in the part where their originals belong, under the originals' item number, by name.

    sections: (part, item, name); reimaged: (part, old, new, to_part). Originals leave their part.
    """
    gone = reimaged.select("part", F.col("old").alias("name"))
    kept = sections.join(gone, ["part", "name"], "left_anti").select("part", "item", "name")
    moved = sections.join(reimaged.withColumnRenamed("old", "name"), ["part", "name"]).select(F.col("to_part").alias("part"), "item", F.col("new").alias("name"))
    w = Window.partitionBy("part").orderBy("name", "item")
    return kept.unionByName(moved).select("part", (F.row_number().over(w) - 1).alias("place"), "name", "item")


def source_of(pixels: DataFrame, chains: DataFrame, key: str) -> DataFrame:
    """pixels with fx, fy: the place in the source that each output pixel (x, y) shows.

    chains: (key, step, a, b, tx, c, d, ty), applied one after the other, the
    highest step first. A section's chain is a few maps, folded into one.
    """
    names = ("a", "b", "tx", "c", "d", "ty")
    steps = F.sort_array(F.collect_list(F.struct((-F.col("step")).alias("o"), *names)))
    chain = chains.groupBy(key).agg(steps.alias("steps"))

    def then(m: Column, s: Column) -> Column:
        parts = [s["a"] * m["a"] + s["b"] * m["c"], s["a"] * m["b"] + s["b"] * m["d"], s["a"] * m["tx"] + s["b"] * m["ty"] + s["tx"], s["c"] * m["a"] + s["d"] * m["c"], s["c"] * m["b"] + s["d"] * m["d"], s["c"] * m["tx"] + s["d"] * m["ty"] + s["ty"]]
        return F.struct(*(e.alias(n) for e, n in zip(parts, names, strict=True)))

    start = F.struct(*(F.lit(v).alias(n) for v, n in zip((1.0, 0.0, 0.0, 0.0, 1.0, 0.0), names, strict=True)))
    whole = chain.select(key, F.aggregate("steps", start, then).alias("map_"))
    fx, fy = G.apply_affine(F.col("x"), F.col("y"), tuple(F.col(f"map_.{n}") for n in names))
    return pixels.join(whole, key).withColumn("fx", fx).withColumn("fy", fy).drop("map_")


def remap(images: DataFrame, places: DataFrame, key: str = "image_id", nearest: bool = False) -> DataFrame:
    """key, y, x, v: places (key, y, x, fx, fy) drawn from images (key, y, x, v) by bilinear weights, or by the nearest pixel for masks.

    Each place asks for its four pixels by an equi-join; a pixel that is not
    there counts as 0. Values are rounded half to even.
    """
    whole = lambda e: e.cast("long")
    if nearest:
        p = places.select(key, "y", "x", whole(F.bround("fy")).alias("sy"), whole(F.bround("fx")).alias("sx"), F.lit(1.0).alias("w"))
    else:
        fy, fx = F.floor("fy"), F.floor("fx")
        ry, rx = F.col("fy") - fy, F.col("fx") - fx
        corners = [F.struct(whole(fy + j).alias("sy"), whole(fx + i).alias("sx"), ((ry if j else 1 - ry) * (rx if i else 1 - rx)).alias("w")) for j in (0, 1) for i in (0, 1)]
        p = places.select(key, "y", "x", F.explode(F.array(*corners)).alias("c")).select(key, "y", "x", "c.*")
    source = images.select(key, F.col("y").cast("long").alias("sy"), F.col("x").cast("long").alias("sx"), "v")
    drawn = p.join(source, [key, "sy", "sx"], "left").groupBy(key, "y", "x").agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0))).alias("v"))
    return drawn.withColumn("v", F.bround(F.round("v", 9)).cast("int"))


def load_section(images: DataFrame, chains: DataFrame, key: str = "image_id", path: str = "coordinates", background: DataFrame | None = None, mask: DataFrame | None = None) -> DataFrame:
    """key, y, x, v and, where given, background and mask of sections drawn through their transforms.

    path: 'none' reads as it is, 'image' takes at most two maps a section (one
    rough, one fine), 'coordinates' any number. Optional tables are joined left.
    """
    if path not in ("none", "image", "coordinates"):
        raise ValueError(f"no such path: {path}")
    out = images.select(key, "y", "x", "v")
    if path != "none":
        used = chains
        if path == "image":
            n = F.count("*").over(Window.partitionBy(key))
            used = chains.withColumn("a", F.when(n <= 2, F.col("a")).otherwise(F.raise_error(F.lit("the image path takes one rough and one fine map"))))
        out = remap(images, source_of(out.drop("v"), used, key), key)
    extra = [(t, n) for t, n in ((background, "background"), (mask, "mask")) if t is not None]
    return reduce(lambda d, e: d.join(e[0].select(key, "y", "x", F.col("v").alias(e[1])), [key, "y", "x"], "left"), extra, out)


def export_sections(sections: DataFrame, to: str, key: str = "image_id", rows: int = 1024) -> None:
    """Writes {to}/key=.../band=...: pixels of a section in bands of image rows, so no task holds a whole section."""
    s = sections.withColumn("band", F.floor(F.col("y") / rows).cast("int"))
    s.repartition(key, "band").write.mode("overwrite").partitionBy(key, "band").parquet(to)


def add_masks(folder: str, masks: DataFrame, to: str, key: str = "image_id", rows: int = 1024) -> None:
    """The sections of one folder with mask (true where masks has the pixel) written to another: a folder is never written while it is read."""
    read = masks.sparkSession.read.parquet(folder).drop("band")
    marked = masks.select(key, "y", "x").distinct().withColumn("mask", F.lit(True))
    export_sections(read.join(marked, [key, "y", "x"], "left").withColumn("mask", F.coalesce("mask", F.lit(False))), to, key, rows)

"""Queries of whole sections: manifests, rings, transforms of coordinates, drawn and exported images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fit as K
from ..operators import sections as R
from .registry import Tables, query
from .solvers import _PIX, pixels
from .stack import _folder


@query("a03_manifest", "SELECT s_suppkey AS section, 'run' || s_nationkey || '/sec_' || s_suppkey AS folder FROM supplier")
def a03(spark, d):
    """The folder of every section among folders and notes without a number."""
    t = Tables(spark, d)
    folders = t.supplier.select(F.concat(F.lit("run"), F.col("s_nationkey").cast("string"), F.lit("/sec_"), F.col("s_suppkey").cast("string")).alias("folder"))
    notes = t.nation.select(F.concat(F.lit("notes/"), "n_name", F.lit("/log")).alias("folder"))
    return R.find_folders(folders.unionByName(notes), t.supplier.select(F.col("s_suppkey").alias("section")))


_RINGS = "p AS (SELECT o_custkey AS section, o_orderkey AS k, floor(o_totalprice / 100000) * 0.5::DOUBLE AS x, (o_orderkey % 2) * 0.5::DOUBLE AS y FROM orders)"


@query("a09_roi_rings", f"WITH {_RINGS}, q AS (SELECT *, lag(x) OVER w AS bx, lag(y) OVER w AS by_ FROM p WINDOW w AS (PARTITION BY section ORDER BY k)), r AS (SELECT section, x, y, row_number() OVER w - 1 AS ord, count(*) OVER (PARTITION BY section) AS n, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM q WHERE bx IS NULL OR bx <> x OR by_ <> y WINDOW w AS (PARTITION BY section ORDER BY k)) SELECT section, ord, x, y FROM r WHERE NOT (ord > 0 AND ord = n - 1 AND x = fx AND y = fy)")
def a09(spark, d):
    p = Tables(spark, d).orders.select(F.col("o_custkey").alias("section"), "o_orderkey", F.floor(F.col("o_totalprice") / 100000).alias("x"), (F.col("o_orderkey") % 2).alias("y"))
    return R.open_rings(p, ["section"], "o_orderkey", 0.5)


@query("a28_reload_coordinates", "WITH s AS (SELECT c_nationkey AS section, c_custkey AS tile, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS x, c_custkey * 3.0::DOUBLE AS y FROM customer), c AS (SELECT s_nationkey AS section, min(s_acctbal) AS cx, min(s_suppkey) AS cy FROM supplier GROUP BY 1), m AS (SELECT section, min(x) AS x0, min(y) AS y0 FROM s GROUP BY 1) SELECT section, tile, round(4 * (x - x0) + cx, 6) AS x, round(4 * (y - y0) + cy, 6) AS y FROM s JOIN m USING (section) JOIN c USING (section)")
def a28(spark, d):
    """Solved positions, some of them missing, anchored at the stage's corner."""
    t = Tables(spark, d)
    x = F.when(F.col("c_custkey") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    solved = t.customer.select(F.col("c_nationkey").alias("section"), F.col("c_custkey").alias("tile"), x.alias("x"), (F.col("c_custkey") * 3.0).alias("y"))
    stage = t.supplier.select(F.col("s_nationkey").alias("section"), F.col("s_acctbal").alias("x"), F.col("s_suppkey").cast("double").alias("y"))
    out = R.reload_coordinates(solved, stage, ["section"], 4.0)
    return out.select("section", "tile", F.when(~F.isnan("x"), F.round("x", 6)).alias("x"), F.round("y", 6).alias("y"))


@query("g08_permuted_chunks", "WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY md5('3:' || p_partkey), p_partkey) - 1 AS place, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, p_partkey, place, CAST((SELECT max(k) FROM range(7) t(k) WHERE k * (n // 7) + least(k, n % 7) <= place) AS INTEGER) AS chunk FROM r")
def g08(spark, d):
    return R.permuted_chunks(Tables(spark, d).part.select("p_brand", "p_partkey"), ["p_brand"], "p_partkey", 7, 3)


@query("i23_second_peak", """WITH h AS (SELECT l_suppkey AS id, CAST(l_quantity AS INTEGER) AS bin, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
b AS (SELECT i.id, t.bin, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT id FROM h) i CROSS JOIN range(51) t(bin) LEFT JOIN h ON h.id = i.id AND h.bin = t.bin),
m AS (SELECT id, arg_max(bin, (n, -bin)) AS mode, max(n) AS top, sum(n) AS total FROM b GROUP BY 1),
u AS (SELECT b.id, max(b.bin) + 1 AS dip FROM b JOIN b c ON c.id = b.id AND c.bin = b.bin + 1 JOIN m ON m.id = b.id WHERE b.bin < mode AND b.n > c.n GROUP BY 1),
g AS (SELECT u.id, dip, max(b.n) FILTER (b.bin <= dip) AS hill, max(b.n) FILTER (b.bin = dip) AS low FROM u JOIN b ON b.id = u.id GROUP BY 1, 2)
SELECT b.id, b.bin, round(CASE WHEN (hill - low) / top > 0.1 AND b.bin <= dip THEN 0.001 + (low / total - 0.001) * b.bin / dip ELSE n / total END, 9) AS share FROM b JOIN m ON m.id = b.id LEFT JOIN g ON g.id = b.id""")
def i23(spark, d):
    """A histogram per supplier; its raw counts stand for the smoothed ones."""
    h = Tables(spark, d).lineitem.groupBy(F.col("l_suppkey").alias("id"), F.col("l_quantity").cast("int").alias("bin")).agg(F.count("*").cast("double").alias("n"))
    held = F.map_from_entries(F.collect_list(F.struct("bin", "n")))
    a = h.groupBy("id").agg(held.alias("m")).select("id", F.transform(F.sequence(F.lit(0), F.lit(50)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("counts"))
    mode = F.array_position("counts", F.array_max("counts")).cast("int") - 1
    out = a.select("id", F.posexplode(R.without_low_peak(F.col("counts"), F.col("counts"), mode, F.lit(0.001))).alias("bin", "share"))
    return out.select("id", "bin", F.round("share", 9).alias("share"))


_MAPPED = "p AS (SELECT p_brand, p_partkey, CAST(p_size AS DOUBLE) AS sx, p_retailprice / 20 + p_partkey % 13 AS sy FROM part), q AS (SELECT *, 1.2 * sx - 0.42 * sy + 3 + (p_partkey % 7) / 10.0::DOUBLE AS tx, 0.9 * sx + 0.56 * sy - 2 + (p_partkey % 5) / 10.0::DOUBLE AS ty FROM p)"


def mapped(t: Tables):
    """Parts of a brand turned and stretched by 1.5 and 0.7, with errors of up to 0.6."""
    k = F.col("p_partkey")
    p = t.part.select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("sx"), (F.col("p_retailprice") / 20 + k % 13).alias("sy"))
    return p.withColumn("tx", 1.2 * F.col("sx") - 0.42 * F.col("sy") + 3 + k % 7 / 10.0).withColumn("ty", 0.9 * F.col("sx") + 0.56 * F.col("sy") - 2 + k % 5 / 10.0)


@query("k03_nonuniform_fit", f"""WITH {_MAPPED}, s AS (SELECT p_brand, count(*) AS n, regr_sxx(sy, sx) AS c1, regr_syy(sy, sx) AS c2, covar_pop(sx, tx) * count(*) AS au, covar_pop(sx, ty) * count(*) AS av, covar_pop(sy, tx) * count(*) AS bu, covar_pop(sy, ty) * count(*) AS bv, avg(sx) AS ma, avg(sy) AS mb, avg(tx) AS mu, avg(ty) AS mv, (var_pop(tx) + var_pop(ty)) * count(*) AS uv FROM q GROUP BY 1),
a AS (SELECT *, atan2(2 * (au * av / c1 - bu * bv / c2), (au * au - av * av) / c1 + (bv * bv - bu * bu) / c2) / 2 AS w FROM s WHERE c1 > 1e-9 AND c2 > 1e-9 AND abs(au * av * c2 - bu * bv * c1) > 1e-9),
c AS (SELECT *, w + t * pi() / 2 AS v FROM a, range(4) r(t)),
f AS (SELECT *, (au * cos(v) + av * sin(v)) / c1 AS kx, (bv * cos(v) - bu * sin(v)) / c2 AS ky FROM c),
b AS (SELECT *, (kx * kx * c1 + ky * ky * c2) / uv AS vaf, row_number() OVER (PARTITION BY p_brand ORDER BY round((kx * kx * c1 + ky * ky * c2) / uv, 9) DESC) AS r FROM f WHERE kx >= 0 AND ky >= 0)
SELECT s.p_brand, s.n, round(atan2(sin(v), cos(v)), 6) AS angle, round(kx, 6) AS scale_x, round(ky, 6) AS scale_y, round(s.mu - cos(v) * kx * s.ma + sin(v) * ky * s.mb, 5) AS tx, round(s.mv - sin(v) * kx * s.ma - cos(v) * ky * s.mb, 5) AS ty, round(vaf, 6) AS vaf FROM s LEFT JOIN (SELECT * FROM b WHERE r = 1) b USING (p_brand)""")
def k03(spark, d):
    f = R.nonuniform(mapped(Tables(spark, d)), ["p_brand"])
    return f.select("p_brand", "n", *(F.round(c, 6).alias(c) for c in ("angle", "scale_x", "scale_y", "vaf")), *(F.round(c, 5).alias(c) for c in ("tx", "ty")))


@query("k04_k22_predict", f"WITH {_MAPPED}, s AS (SELECT p_brand, avg(sx) AS mx, avg(sy) AS my, avg(tx) AS mu, avg(ty) AS mv, var_pop(sx) AS xx, var_pop(sy) AS yy, covar_pop(sx, sy) AS xy, covar_pop(sx, tx) AS xu, covar_pop(sy, tx) AS yu, covar_pop(sx, ty) AS xv, covar_pop(sy, ty) AS yv FROM q GROUP BY 1) SELECT p_partkey, round(mu + ((xu * yy - yu * xy) * (sx - mx) + (yu * xx - xu * xy) * (sy - my)) / (xx * yy - xy * xy), 4) AS px, round(mv + ((xv * yy - yv * xy) * (sx - mx) + (yv * xx - xv * xy) * (sy - my)) / (xx * yy - xy * xy), 4) AS py FROM q JOIN s USING (p_brand) WHERE xx * yy - xy * xy > 1e-9")
def k04(spark, d):
    """An overview's points in stage coordinates by the affine fit of their group."""
    p = mapped(Tables(spark, d))
    return R.predict(p, K.affine(p, ["p_brand"]), ["p_brand"]).select("p_partkey", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"))


_CORNERS = "p AS (SELECT p_brand, CAST(substr(p_brand, 7) AS INTEGER) AS k, CAST(p_size AS DOUBLE) AS sx, p_retailprice / 20 + p_partkey % 13 AS sy, p_partkey FROM part), q AS (SELECT *, cos(k / 10.0) * sx - sin(k / 10.0) * sy + (p_partkey % 11) * (k % 3) AS tx, sin(k / 10.0) * sx + cos(k / 10.0) * sy + 7 AS ty FROM p)"


@query("k21_roi_rotations", f"WITH {_CORNERS}, m AS (SELECT p_brand, avg(sx) AS ma, avg(sy) AS mb, avg(tx) AS mu, avg(ty) AS mv, var_pop(tx) + var_pop(ty) AS v, atan2(covar_pop(sx, ty) - covar_pop(sy, tx), covar_pop(sx, tx) + covar_pop(sy, ty)) AS w FROM q GROUP BY 1), e AS (SELECT p_brand, any_value(k) AS k, any_value(w) AS w, 1 - avg((cos(w) * (sx - ma) - sin(w) * (sy - mb) - tx + mu) ** 2 + (sin(w) * (sx - ma) + cos(w) * (sy - mb) - ty + mv) ** 2) / any_value(v) AS vaf FROM q JOIN m USING (p_brand) GROUP BY 1) SELECT p_brand, round(CASE WHEN vaf >= 0.99 THEN -w ELSE k / 100.0 END, 6) AS rotation, round(vaf, 6) AS vaf FROM e")
def k21(spark, d):
    """Angles by the rigid fit of the corners; brands with large errors keep what they had."""
    k = F.substring("p_brand", 7, 9).cast("int")
    p = Tables(spark, d).part.select("p_brand", k.alias("k"), "p_partkey", F.col("p_size").cast("double").alias("sx"), (F.col("p_retailprice") / 20 + F.col("p_partkey") % 13).alias("sy"))
    cos, sin = F.cos(F.col("k") / 10), F.sin(F.col("k") / 10)
    p = p.withColumn("tx", cos * F.col("sx") - sin * F.col("sy") + F.col("p_partkey") % 11 * (F.col("k") % 3)).withColumn("ty", sin * F.col("sx") + cos * F.col("sy") + 7)
    old = p.select("p_brand", (F.col("k") / 100).alias("rotation")).distinct()
    return R.roi_rotations(p, old, "p_brand").select("p_brand", F.round("rotation", 6).alias("rotation"), F.round("vaf", 6).alias("vaf"))


_ROI = "g AS (SELECT c_nationkey AS section, c_custkey AS k, c_custkey % 50 / 4.0::DOUBLE AS x, (c_custkey * 7) % 60 * 5.0::DOUBLE AS y FROM customer), e AS (SELECT section, x * 4 AS x, y * 4 AS y, lead(x * 4, 1, f * 4) OVER w AS x2, lead(y * 4, 1, fy * 4) OVER w AS y2 FROM (SELECT *, first_value(x) OVER (PARTITION BY section ORDER BY k) AS f, first_value(y) OVER (PARTITION BY section ORDER BY k) AS fy FROM g) WINDOW w AS (PARTITION BY section ORDER BY k)), f AS (SELECT p_partkey % 25 AS section, p_partkey AS kp_id, p_size + 0.5::DOUBLE AS x, p_retailprice + 0.03 AS y FROM part)"


@query("c05_roi_features", f"WITH {_ROI} SELECT f.section, kp_id FROM f JOIN e ON e.section = f.section WHERE (e.y > f.y) <> (y2 > f.y) AND f.x < (x2 - e.x) * (f.y - e.y) / nullif(y2 - e.y, 0) + e.x GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def c05(spark, d):
    """Features within their section's polygon, which is drawn at a quarter of their scale."""
    t = Tables(spark, d)
    ring = t.customer.select(F.col("c_nationkey").cast("long").alias("section"), "c_custkey", (F.col("c_custkey") % 50 / 4.0).alias("x"), (F.col("c_custkey") * 7 % 60 * 5.0).alias("y"))
    features = t.part.select((F.col("p_partkey") % 25).alias("section"), F.col("p_partkey").alias("kp_id"), (F.col("p_size") + 0.5).alias("x"), (F.col("p_retailprice") + 0.03).alias("y"))
    return R.filter_by_roi(features, ring, "section", "c_custkey", 4.0).select("section", "kp_id")


@query("l03_comparison_list", "SELECT DISTINCT l_suppkey AS image, CASE WHEN s_nationkey < l_suppkey THEN s_nationkey + 100000 ELSE s_nationkey END AS template FROM (SELECT l_suppkey, l_linenumber FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey")
def l03(spark, d):
    t = Tables(spark, d)
    seen = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_nationkey").cast("long").alias("x"), F.col("l_suppkey").alias("y")).distinct()
    return R.comparison_list(seen.withColumn("adjacent", F.lit(1)), 100000)


@query("n02_distance_order", "WITH a AS (SELECT c_nationkey AS node, avg(c_acctbal) AS v FROM customer GROUP BY 1), r AS (SELECT node, v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n, max(v) OVER () - min(v) OVER () AS top, first_value(node) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) < last_value(node) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS up FROM a), o AS (SELECT CAST(CASE WHEN up THEN k ELSE n - 1 - k END AS INTEGER) AS position, CAST(node AS BIGINT) AS node, v, top FROM r) SELECT position, node, round(1 - abs(lead(v) OVER (ORDER BY position) - v) / top / 2, 6) AS to_next FROM o")
def n02(spark, d):
    """Nations by the distances of their customers' mean balances: points on a line, whose shortest path is their order."""
    a = Tables(spark, d).customer.groupBy(F.col("c_nationkey").alias("node")).agg(F.avg("c_acctbal").alias("v"))
    pairs = a.alias("l").join(a.alias("r"), F.col("l.node") < F.col("r.node")).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"), F.abs(F.col("l.v") - F.col("r.v")).alias("distance"))
    return R.distance_order(pairs).select("position", "node", F.round("to_next", 6).alias("to_next"))


@query("n08_polygons_in_scene", "WITH p AS (SELECT o_custkey AS polygon, o_custkey % 5 AS scene, o_orderkey AS ord, o_totalprice / 500 - 40 * (o_custkey % 5 + 1) AS x, o_orderkey % 500 - 30.0::DOUBLE * (o_custkey % 5) AS y, (o_custkey % 7) * 0.3::DOUBLE AS a FROM orders), m AS (SELECT polygon, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my FROM p GROUP BY 1), t AS (SELECT polygon, scene, ord, cos(a) * (x - mx) - sin(a) * (y - my) + mx AS x, sin(a) * (x - mx) + cos(a) * (y - my) + my AS y FROM p JOIN m USING (polygon)) SELECT polygon, scene, ord, round(x, 6) AS x, round(y, 6) AS y, bool_or(x >= 0 AND x < 30 + 10 * scene AND y >= 0 AND y < 60) OVER (PARTITION BY polygon) AS in_scene FROM t")
def n08(spark, d):
    t = Tables(spark, d)
    r = F.col("r_regionkey").cast("long")
    scenes = t.region.select(r.alias("scene"), (40.0 * (r + 1)).alias("corner_x"), (30.0 * r).alias("corner_y"), (30.0 + 10 * r).alias("width"), F.lit(60.0).alias("height"))
    k = F.col("o_custkey")
    p = t.orders.select(k.alias("polygon"), (k % 5).alias("scene"), F.col("o_orderkey").alias("ord"), (F.col("o_totalprice") / 500).alias("x"), (F.col("o_orderkey") % 500).cast("double").alias("y"), (k % 7 * 0.3).alias("rotation"))
    out = R.turn_in_scene(p, scenes, ["polygon"], "scene")
    return out.select("polygon", "scene", "ord", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "in_scene")


@query("d15_original_order", "WITH s AS (SELECT CASE WHEN n_nationkey % 4 = 1 THEN (n_regionkey + 1) % 5 ELSE n_regionkey END AS part, n_nationkey AS item, CASE WHEN n_nationkey % 4 = 1 THEN 'AGAIN_' || n_name ELSE n_name END AS name FROM nation) SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY name, item) - 1 AS INTEGER) AS place, name, item FROM s")
def d15(spark, d):
    n = Tables(spark, d).nation
    sections = n.select(F.col("n_regionkey").alias("part"), F.col("n_nationkey").alias("item"), F.col("n_name").alias("name"))
    again = n.where("n_nationkey % 4 = 1").select(F.col("n_regionkey").alias("part"), F.col("n_name").alias("old"), F.concat(F.lit("AGAIN_"), "n_name").alias("new"), ((F.col("n_regionkey") + 1) % 5).alias("to_part"))
    return R.original_order(sections, again)


#: Step 3 (half the size, moved) comes first, then step 2 (a turn), then step 1 (a shear and a move).
_DRAWN = f"""{_PIX}, s3 AS (SELECT image_id, y, x, 0.5::DOUBLE * x + 2 AS fx, 0.75::DOUBLE * y + 1 AS fy FROM px), s2 AS (SELECT image_id, y, x, 0.8::DOUBLE * fx - 0.6::DOUBLE * fy + 4 AS fx, 0.6::DOUBLE * fx + 0.8::DOUBLE * fy - 3 AS fy FROM s3),
s1 AS (SELECT image_id, y, x, fx + 0.125::DOUBLE * fy + image_id AS fx, fy - 0.25::DOUBLE * image_id AS fy FROM s2),
c AS (SELECT image_id, y, x, floor(fy) + j AS sy, floor(fx) + i AS sx, abs(1 - j - (fy - floor(fy))) * abs(1 - i - (fx - floor(fx))) AS w FROM s1, range(2) t(i), range(2) u(j)),
d AS (SELECT c.image_id, c.y, c.x, CAST(round_even(round(sum(w * coalesce(px.v, 0)), 9), 0) AS INTEGER) AS v FROM c LEFT JOIN px ON px.image_id = c.image_id AND px.y = sy AND px.x = sx GROUP BY 1, 2, 3)"""


def chains(spark):
    k = F.col("id").cast("double")
    maps = [(3, 0.5, 0.0, 2.0, 0.0, 0.75, 1.0), (2, 0.8, -0.6, 4.0, 0.6, 0.8, -3.0), (1, 1.0, 0.125, k, 0.0, 1.0, -0.25 * k)]
    steps = F.array(*(F.struct(*((v if hasattr(v, "cast") else F.lit(v)).alias(n) for v, n in zip(m, ("step", "a", "b", "tx", "c", "d", "ty"), strict=True))) for m in maps))
    return spark.range(6).select(F.col("id").alias("image_id"), F.explode(steps).alias("m")).select("image_id", "m.*")


@query("l16_a16_l21_load_section", f"WITH {_DRAWN} SELECT d.image_id, d.y, d.x, d.v, CASE WHEN px.v >= 128 THEN px.v END AS background FROM d JOIN px USING (image_id, y, x)")
def l16(spark, d):
    """Images drawn through three maps each, with an optional background."""
    p = pixels(spark)
    return R.load_section(p, chains(spark), background=p.where("v >= 128"))


@query("b04_b12_export_sections", f"WITH {_DRAWN} SELECT d.image_id, count(*) AS n, sum(d.v) AS total, sum(d.v) FILTER (px.v % 3 = 0) AS masked FROM d JOIN px USING (image_id, y, x) GROUP BY 1")
def b04(spark, d):
    """Drawn sections written by bands, their masks added in a second folder, and read back."""
    first, second = _folder(spark), _folder(spark)
    p = pixels(spark)
    R.export_sections(R.load_section(p, chains(spark)), first, rows=8)
    R.add_masks(first, p.where("v % 3 = 0"), second, rows=8)
    read = spark.read.schema("image_id long, y long, x long, v int, mask boolean, band int").parquet(second)
    return read.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.sum(F.when(F.col("mask"), F.col("v"))).alias("masked"))

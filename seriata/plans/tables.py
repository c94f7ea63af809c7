"""Queries of joins, aggregates, windows, sorts and sets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats as S
from ..operators import neighbors as N
from ..operators.windows import moving_average
from .registry import Tables, query

#: Added before rounding means of two-digit amounts, so that none lies on the edge of two roundings.
OFF = 0.00001234
_Z = "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS z, o_orderkey, o_totalprice FROM orders"


def ordered(t: Tables):
    """orders as sections: z within a customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_custkey", F.row_number().over(w).cast("long").alias("z"), "o_orderkey", "o_totalprice")


def points(t: Tables):
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 10).alias("y"))


_POINTS = "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice / 10 AS y FROM part"


@query("d01_band_pairs", f"WITH s AS ({_Z}) SELECT a.o_custkey, a.z, CAST(b.z - a.z AS INTEGER) AS k, round(b.o_totalprice - a.o_totalprice, 2) AS delta FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND b.z - a.z BETWEEN -3 AND 3 AND a.z <> b.z")
def d01(spark, d):
    p = N.band_pairs(ordered(Tables(spark, d)), ["o_custkey"], "z", 3, "o_totalprice")
    return p.select("o_custkey", "z", "k", F.round(F.col("o_totalprice_k") - F.col("o_totalprice"), 2).alias("delta"))


@query("d05_radius_join", f"WITH p AS ({_POINTS}) SELECT a.id, b.id AS id_r, round((a.x - b.x) ** 2 + (a.y - b.y) ** 2, 6) AS d2 FROM p a JOIN p b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 4 AND a.id <> b.id")
def d05(spark, d):
    p = points(Tables(spark, d))
    return N.radius_join(p, p, 2.0, digits=6).where("id <> id_r").select("id", "id_r", "d2")


@query("d05_nearest", f"WITH p AS ({_POINTS}), j AS (SELECT a.id, b.id AS id_r, round((a.x - b.x) ** 2 + (a.y - b.y) ** 2, 6) AS d2 FROM p a JOIN p b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 9 AND a.id <> b.id) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, id_r) AS rank FROM j) WHERE rank <= 3")
def d05k(spark, d):
    p = points(Tables(spark, d))
    return N.nearest_points(p, p, 3.0, 3, digits=6)


@query("d07_upsert_edges", "SELECT src, dst, cmp, load_ FROM (SELECT l_suppkey AS src, l_partkey % 50 AS dst, l_discount AS cmp, l_orderkey * 8 + l_linenumber AS load_, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 50 ORDER BY l_discount DESC, l_orderkey * 8 + l_linenumber) AS r FROM lineitem) WHERE r = 1")
def d07(spark, d):
    e = Tables(spark, d).lineitem.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50).alias("dst"), F.col("l_discount").alias("cmp"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("load_"))
    return N.upsert_edges(e, "cmp", "load_")


@query("d08_f01_order_lookup", "WITH r AS (SELECT n_regionkey AS wafer_id, count(*) AS n FROM nation GROUP BY 1), c AS (SELECT wafer_id, coalesce(sum(n) OVER (ORDER BY wafer_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r) SELECT n_regionkey AS wafer_id, n_nationkey AS region, CAST(before + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 4 = 3, n_nationkey) - 1 AS BIGINT) AS z, n_nationkey % 4 = 3 AS excluded FROM nation JOIN c ON n_regionkey = wafer_id")
def d08(spark, d):
    """Sections in the order of their wafers; excluded ones come after all included ones of theirs."""
    n = Tables(spark, d).nation.select(F.col("n_regionkey").alias("wafer_id"), F.col("n_nationkey").alias("region"), (F.col("n_nationkey") % 4 == 3).alias("excluded"))
    sizes = n.groupBy("wafer_id").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("wafer_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per wafer
    rank = F.row_number().over(Window.partitionBy("wafer_id").orderBy("excluded", "region"))
    return n.join(sizes.select("wafer_id", before.alias("before")), "wafer_id").select("wafer_id", "region", (F.col("before") + rank - 1).alias("z"), "excluded")


@query("d10_nearest_imaged", f"WITH s AS ({_Z}), j AS (SELECT a.o_custkey, a.z, b.z AS z_n, row_number() OVER (PARTITION BY a.o_custkey, a.z ORDER BY abs(a.z - b.z), b.z) AS rank FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.z <> b.z AND abs(a.z - b.z) <= 4 AND (a.z - 1) // 8 = (b.z - 1) // 8) SELECT o_custkey, z, z_n, rank FROM j WHERE rank <= 4")
def d10(spark, d):
    """The four sections imaged nearest in time within the same re-imaging interval of eight."""
    p = N.band_pairs(ordered(Tables(spark, d)), ["o_custkey"], "z", 4, "o_orderkey").withColumn("z_n", F.col("z") + F.col("k"))
    same = p.where(F.floor((F.col("z") - 1) / 8) == F.floor((F.col("z_n") - 1) / 8))
    return N.top_n(same, ["o_custkey", "z"], [F.abs("k"), F.col("z_n")], 4).select("o_custkey", "z", "z_n", "rank")


@query("d11_boxes_over_crops", "WITH b AS (SELECT s_suppkey AS id, s_acctbal / 100 AS x0, s_acctbal / 100 + 8 AS x1, CAST(s_nationkey AS DOUBLE) AS y0, s_nationkey + 3.0::DOUBLE AS y1 FROM supplier) SELECT a.id, c.id AS id_r FROM b a JOIN b c ON a.x0 < c.x1 AND c.x0 < a.x1 AND a.y0 < c.y1 AND c.y0 < a.y1 WHERE a.id < c.id")
def d11(spark, d):
    x, y = F.col("s_acctbal") / 100, F.col("s_nationkey").cast("double")
    b = Tables(spark, d).supplier.select(F.col("s_suppkey").alias("id"), x.alias("x0"), (x + 8).alias("x1"), y.alias("y0"), (y + 3.0).alias("y1"))
    return N.interval_overlap(b, b, 16.0).where("id < id_r")


@query("d12_g05_arg_best", "SELECT l_suppkey, min_by(l_partkey, (l_extendedprice, l_partkey, l_orderkey)) AS cheapest, max_by(l_partkey, (l_extendedprice, l_partkey, l_orderkey)) AS dearest FROM (SELECT l_suppkey, l_partkey, l_orderkey, l_extendedprice FROM lineitem) GROUP BY l_suppkey")
def d12(spark, d):
    by = F.struct("l_extendedprice", "l_partkey", "l_orderkey")
    return Tables(spark, d).lineitem.groupBy("l_suppkey").agg(F.min_by("l_partkey", by).alias("cheapest"), F.max_by("l_partkey", by).alias("dearest"))


@query("d13_semi_anti", "SELECT count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS gone FROM (SELECT o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS ok FROM orders)")
def d13(spark, d):
    t = Tables(spark, d)
    r = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    kept = t.orders.join(r, "o_orderkey", "left_semi").agg(F.count("*").alias("kept"))
    gone = t.orders.join(r, "o_orderkey", "left_anti").agg(F.count("*").alias("gone"))
    return kept.join(F.broadcast(gone))  # one row each


def value_histogram(t: Tables):
    return S.histogram(t.events, ["event_type"], F.floor("value"))


_H = "SELECT event_type, CAST(floor(value) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value >= 0 AND value < 256 GROUP BY 1, 2"


@query("e01_histogram", f"SELECT event_type, b AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT event_type, b FROM events, range(256) t(b)) LEFT JOIN (SELECT event_type, bin AS b, n FROM ({_H})) USING (event_type, b)")
def e01(spark, d):
    found = S.dense(value_histogram(Tables(spark, d)), ["event_type"])
    return found.select("event_type", F.posexplode("counts").alias("bin", "n")).withColumn("bin", F.col("bin").cast("long"))


@query("e02_masked_histogram", "SELECT event_type, CAST(floor(value) AS INTEGER) AS bin, count(*) AS n, count(DISTINCT user_id) AS blocks FROM events JOIN (SELECT c_custkey AS user_id FROM customer WHERE c_nationkey % 2 = 0) USING (user_id) WHERE value >= 0 AND value < 256 GROUP BY 1, 2")
def e02(spark, d):
    """Counts of the blocks a mask lets through, added up over blocks by partial aggregation."""
    t = Tables(spark, d)
    mask = t.customer.where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("user_id"))
    kept = t.events.join(mask, "user_id", "left_semi").withColumn("bin", F.floor("value").cast("int")).where("bin >= 0 and bin < 256")
    return kept.groupBy("event_type", "bin").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("blocks"))


_DENSE = f"d AS (SELECT event_type, b, coalesce(n, 0) AS n FROM (SELECT DISTINCT event_type, b FROM events, range(256) t(b)) LEFT JOIN (SELECT event_type, bin AS b, n FROM ({_H})) USING (event_type, b))"


@query("e03_histogram_mode", f"""WITH {_DENSE}, x AS (SELECT event_type, b AS j, n FROM d UNION ALL SELECT event_type, -b - 1, n FROM d WHERE b < 2 UNION ALL SELECT event_type, 511 - b, n FROM d WHERE b > 253),
s AS (SELECT d.event_type, d.b, d.n, sum(x.n) AS s FROM d JOIN x ON d.event_type = x.event_type AND x.j BETWEEN d.b - 2 AND d.b + 2 GROUP BY 1, 2, 3),
p AS (SELECT event_type, b, n, CASE WHEN b >= 3 AND b < 40 THEN 0 ELSE 1 END AS tier FROM (SELECT *, lag(s) OVER w AS s0, lead(s) OVER w AS s1, max(n) OVER (PARTITION BY event_type) AS top FROM s WINDOW w AS (PARTITION BY event_type ORDER BY b)) WHERE s > s0 AND s >= s1 AND n > top * 0.25 AND b >= 1 AND b < 254)
SELECT event_type, CAST(coalesce(mode_, -1) AS INTEGER) AS mode_ FROM (SELECT DISTINCT event_type FROM events) LEFT JOIN (SELECT event_type, arg_min(b, (tier, -n, b)) AS mode_ FROM p GROUP BY 1) USING (event_type)""")
def e03(spark, d):
    found = S.dense(value_histogram(Tables(spark, d)), ["event_type"])
    return found.select("event_type", S.histogram_mode(F.col("counts"), [(3, 40), (0, 256)]).alias("mode_"))


@query("e04_cdf_width", f"WITH h AS ({_H}), c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bin) / sum(n) OVER (PARTITION BY event_type) AS share FROM h) SELECT event_type, min(bin) FILTER (share > 0.05) AS low_bin, min(bin) FILTER (share > 0.98) AS high_bin, min(bin) FILTER (share > 0.98) - min(bin) FILTER (share > 0.05) AS width FROM c GROUP BY 1")
def e04(spark, d):
    return S.percentile_width(value_histogram(Tables(spark, d)), ["event_type"])


@query("e05_cutoffs_around_mode", f"WITH h AS ({_H}), m AS (SELECT event_type, arg_min(bin, (-n, bin)) AS mode_, max(n) AS top FROM h GROUP BY 1), f AS (SELECT unnest([1/20, 1/12.5, 1/10, 1/6, 1/3]::DOUBLE[]) AS fr), q AS (SELECT event_type, fr, min(bin) FILTER (n >= top * fr) AS lo, max(bin) FILTER (n >= top * fr) AS hi FROM h JOIN m USING (event_type), f GROUP BY 1, 2) SELECT event_type, arg_min(lo, fr) AS low_cut, arg_min(hi, fr) AS high_cut FROM q WHERE hi <= 60 GROUP BY 1")
def e05(spark, d):
    """The bins nearest the ends that hold a fraction of the mode's count: the smallest of the fractions that keeps them within bounds."""
    h = value_histogram(Tables(spark, d))
    m = h.groupBy("event_type").agg(F.max("n").alias("top"))
    tried = h.join(m, "event_type").withColumn("fr", F.explode(F.array(*(F.lit(x) for x in (1 / 20, 1 / 12.5, 1 / 10, 1 / 6, 1 / 3))))).where("n >= top * fr")
    q = tried.groupBy("event_type", "fr").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).where("hi <= 60")
    return q.groupBy("event_type").agg(F.min_by("lo", "fr").alias("low_cut"), F.min_by("hi", "fr").alias("high_cut"))


@query("e06_mean_by_position", "SELECT l_linenumber AS tile, l_suppkey % 10 AS y, CAST(round_even((1 + sum(CAST(l_quantity AS BIGINT))) / count(*), 0) AS BIGINT) AS mean FROM lineitem GROUP BY 1, 2")
def e06(spark, d):
    g = Tables(spark, d).lineitem.groupBy(F.col("l_linenumber").alias("tile"), (F.col("l_suppkey") % 10).alias("y"))
    return g.agg(F.bround((1 + F.sum(F.col("l_quantity").cast("long"))) / F.count("*")).cast("long").alias("mean"))


@query("e07_mode_and_adjust", "WITH c AS (SELECT l_linenumber AS tile, CAST(l_quantity AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT tile, arg_min(q, (-n, q)) AS mode_ FROM c GROUP BY 1), o AS (SELECT arg_min(q, (-n, q)) AS overall FROM (SELECT q, sum(n) AS n FROM c GROUP BY 1)) SELECT tile, mode_, overall - mode_ AS adjust FROM m, o")
def e07(spark, d):
    rows = Tables(spark, d).lineitem.select(F.col("l_linenumber").alias("tile"), F.col("l_quantity").cast("long").alias("q"))
    counts = rows.groupBy("tile", "q").agg(F.count("*").alias("n"))
    first = F.min_by("q", F.struct(-F.col("n"), F.col("q")))
    mode = counts.groupBy("tile").agg(first.alias("mode_"))
    overall = counts.groupBy("q").agg(F.sum("n").alias("n")).agg(first.alias("overall"))
    return mode.join(F.broadcast(overall)).select("tile", "mode_", (F.col("overall") - F.col("mode_")).alias("adjust"))  # one row


@query("e08_median_of_deltas", "SELECT l_partkey % 300 AS edge, round(coalesce(median(l_extendedprice) FILTER (l_discount > 0.02), 1000.0), 6) AS delta FROM lineitem GROUP BY 1")
def e08(spark, d):
    """Medians of the entries whose correlation is positive enough; the stage's default where there is none."""
    ok = F.when(F.col("l_discount") > 0.02, F.col("l_extendedprice"))
    return Tables(spark, d).lineitem.groupBy((F.col("l_partkey") % 300).alias("edge")).agg(F.round(F.coalesce(F.median(ok), F.lit(1000.0)), 6).alias("delta"))


@query("e09_mad_z", "WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1), a AS (SELECT event_type, median(abs(value - med)) AS mad FROM events JOIN m USING (event_type) GROUP BY 1) SELECT event_id, round(CASE WHEN mad = 0 THEN 0 ELSE (value - med) / 1.4826 / mad END, 6) AS z FROM events JOIN m USING (event_type) JOIN a USING (event_type)")
def e09(spark, d):
    return S.mad_z(Tables(spark, d).events.select("event_id", "event_type", "value"), ["event_type"], "value").select("event_id", F.round("z", 6).alias("z"))


@query("e10_radial_spread", "WITH c AS (SELECT p_brand, avg(p_size) AS cx, avg(p_retailprice) AS cy FROM part GROUP BY 1), r AS (SELECT p_brand, sqrt((p_size - cx) ** 2 + (p_retailprice - cy) ** 2) AS r FROM part JOIN c USING (p_brand)), m AS (SELECT p_brand, median(r) AS med FROM r GROUP BY 1) SELECT p_brand, round(1.4826 * median(abs(r - med)), 6) AS spread, 1.4826 * median(abs(r - med)) >= 15 AS wide FROM r JOIN m USING (p_brand) GROUP BY 1")
def e10(spark, d):
    p = Tables(spark, d).part
    c = p.groupBy("p_brand").agg(F.avg("p_size").alias("cx"), F.avg("p_retailprice").alias("cy"))
    r = p.join(c, "p_brand").select("p_brand", F.sqrt((F.col("p_size") - F.col("cx")) ** 2 + (F.col("p_retailprice") - F.col("cy")) ** 2).alias("r"))
    m = r.groupBy("p_brand").agg(F.median("r").alias("med"))
    spread = 1.4826 * F.median(F.abs(F.col("r") - F.col("med")))
    return r.join(m, "p_brand").groupBy("p_brand").agg(F.round(spread, 6).alias("spread"), (spread >= 15).alias("wide"))


@query("e12_weight_normalisation", f"WITH s AS ({_Z}), p AS (SELECT a.o_custkey, a.z, b.z - a.z AS k, a.o_totalprice AS w FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND abs(b.z - a.z) IN (1, 2)), c AS (SELECT *, w * count(*) OVER (PARTITION BY o_custkey, z) * CASE WHEN abs(k) = 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS v FROM p) SELECT o_custkey, z, CAST(k AS INTEGER) AS k, round(v / max(v) OVER (), 6) AS weight FROM c")
def e12(spark, d):
    p = N.band_pairs(ordered(Tables(spark, d)), ["o_custkey"], "z", 2, "o_totalprice")
    v = p.withColumn("v", F.col("o_totalprice") * F.count("*").over(Window.partitionBy("o_custkey", "z")) * F.when(F.abs("k") == 1, 1.0).otherwise(0.5))
    return v.join(F.broadcast(v.agg(F.max("v").alias("top")))).select("o_custkey", "z", "k", F.round(F.col("v") / F.col("top"), 6).alias("weight"))  # one row


@query("e14_inlier_share", "SELECT l_suppkey AS z, l_linenumber AS k, round(count(*) FILTER (l_discount < 0.08) / count(*), 6) AS inliers FROM lineitem GROUP BY 1, 2")
def e14(spark, d):
    ok = F.count_if(F.col("l_discount") < 0.08)
    return Tables(spark, d).lineitem.groupBy(F.col("l_suppkey").alias("z"), F.col("l_linenumber").alias("k")).agg(F.round(ok / F.count("*"), 6).alias("inliers"))


@query("e15_delta_statistics", "SELECT l_suppkey, round(stddev_pop(dx), 6) AS sd, round(avg(sqrt(dx * dx + dy * dy)), 6) AS mean, arg_max(dx, (abs(dx), dx)) AS most FROM (SELECT l_suppkey, l_quantity - 25 AS dx, l_discount * 100 AS dy FROM lineitem) GROUP BY 1")
def e15(spark, d):
    dx, dy = F.col("l_quantity") - 25, F.col("l_discount") * 100
    return Tables(spark, d).lineitem.select("l_suppkey", dx.alias("dx"), dy.alias("dy")).groupBy("l_suppkey").agg(F.round(F.stddev_pop("dx"), 6).alias("sd"), F.round(F.avg(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)), 6).alias("mean"), F.max_by("dx", F.struct(F.abs("dx"), F.col("dx"))).alias("most"))


@query("e17_residual_histogram", "SELECT CAST(floor(l_extendedprice / 1000) AS BIGINT) AS bin, l_discount > 0.08 AS outlier, count(*) AS n FROM lineitem GROUP BY 1, 2")
def e17(spark, d):
    return Tables(spark, d).lineitem.groupBy(F.floor(F.col("l_extendedprice") / 1000).alias("bin"), (F.col("l_discount") > 0.08).alias("outlier")).agg(F.count("*").alias("n"))


@query("e18_trend", f"WITH s AS ({_Z}) SELECT o_custkey, round(regr_slope(o_totalprice, z) + 0.00001234, 4) AS slope, round(regr_intercept(o_totalprice, z) + 0.00001234, 4) AS intercept FROM s GROUP BY 1 HAVING count(*) > 1")
def e18(spark, d):
    g = ordered(Tables(spark, d)).groupBy("o_custkey").agg(F.round(F.regr_slope("o_totalprice", "z") + OFF, 4).alias("slope"), F.round(F.regr_intercept("o_totalprice", "z") + OFF, 4).alias("intercept"), F.count("*").alias("n"))
    return g.where("n > 1").drop("n")


_BAD = f"WITH s AS ({_Z}), b AS (SELECT *, o_totalprice < 100000 AS bad FROM s), i AS (SELECT *, z - row_number() OVER (PARTITION BY o_custkey, bad ORDER BY z) AS island FROM b), r AS (SELECT o_custkey, min(z) AS first_z, count(*) AS n FROM i WHERE bad GROUP BY o_custkey, island)"


def bad_runs(t: Tables):
    """Gaps and islands: runs of bad matches."""
    b = ordered(t).withColumn("bad", F.col("o_totalprice") < 100000)
    island = F.col("z") - F.row_number().over(Window.partitionBy("o_custkey", "bad").orderBy("z"))
    return b.withColumn("island", island).where("bad").groupBy("o_custkey", "island").agg(F.min("z").alias("first_z"), F.count("*").alias("n"))


@query("e19_bad_match_report", _BAD + " SELECT count(*) AS runs, CAST(sum(n) AS BIGINT) AS bad, count(*) FILTER (n = 1) AS single, count(*) FILTER (n > 1 AND n <= 5) AS short, count(*) FILTER (n > 5) AS long_ FROM r")
def e19(spark, d):
    n = F.col("n")
    return bad_runs(Tables(spark, d)).agg(F.count("*").alias("runs"), F.sum("n").alias("bad"), F.count_if(n == 1).alias("single"), F.count_if((n > 1) & (n <= 5)).alias("short"), F.count_if(n > 5).alias("long_"))


@query("f04_runs_of_swaps", _BAD + " SELECT o_custkey, first_z, n FROM r WHERE n >= 2")
def f04(spark, d):
    return bad_runs(Tables(spark, d)).where("n >= 2").drop("island")


@query("e20_wafer_statistics", "SELECT n_regionkey AS wafer, count(DISTINCT n_nationkey) AS regions, count(*) AS images, round(count(*) / count(DISTINCT n_nationkey), 6) AS per_region, round(sum(s_acctbal), 2) AS pixels FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def e20(spark, d):
    t = Tables(spark, d)
    j = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("wafer"))
    return j.agg(F.count_distinct("n_nationkey").alias("regions"), F.count("*").alias("images"), F.round(F.count("*") / F.count_distinct("n_nationkey"), 6).alias("per_region"), F.round(F.sum("s_acctbal"), 2).alias("pixels"))


@query("e22_path_length", f"WITH s AS ({_Z}), d AS (SELECT o_custkey, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY z) - o_totalprice AS step FROM s) SELECT o_custkey, round(sum(abs(step)), 2) AS length, round(sqrt(sum(step * step)), 4) AS root_of_squares FROM d GROUP BY 1 HAVING count(step) > 0")
def e22(spark, d):
    step = F.lead("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("z")) - F.col("o_totalprice")
    g = ordered(Tables(spark, d)).select("o_custkey", step.alias("step")).groupBy("o_custkey")
    return g.agg(F.round(F.sum(F.abs("step")), 2).alias("length"), F.round(F.sqrt(F.sum(F.col("step") ** 2)), 4).alias("root_of_squares")).where("length is not null")


@query("e24_write_completeness", "SELECT l_shipdate::DATE AS target, count(DISTINCT l_suppkey) AS written, count(DISTINCT l_suppkey) = (SELECT count(*) FROM supplier) AS complete FROM lineitem GROUP BY 1")
def e24(spark, d):
    t = Tables(spark, d)
    total = t.supplier.agg(F.count("*").alias("total"))
    w = t.lineitem.groupBy(F.to_date("l_shipdate").alias("target")).agg(F.count_distinct("l_suppkey").alias("written"))
    return w.join(F.broadcast(total)).select("target", "written", (F.col("written") == F.col("total")).alias("complete"))  # one row


@query("e25_e26_r2", "WITH m AS (SELECT l_suppkey, avg(l_extendedprice) AS mean FROM lineitem GROUP BY 1) SELECT l_suppkey, round(1 - sum((l_extendedprice - l_quantity * 2000) ** 2) / sum((l_extendedprice - mean) ** 2), 6) AS r2 FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1 HAVING count(*) > 1")
def e25(spark, d):
    rows = Tables(spark, d).lineitem.select("l_suppkey", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000).alias("f"))
    return S.r2(rows, ["l_suppkey"], "y", "f").select("l_suppkey", F.round("r2", 6).alias("r2"))


@query("e27_distinct_permutation", f"WITH s AS ({_Z}) SELECT o_custkey, count(DISTINCT z) = count(*) AND max(z) = count(*) AND min(z) = 1 AS permutation FROM s GROUP BY 1")
def e27(spark, d):
    z = F.col("z")
    return ordered(Tables(spark, d)).groupBy("o_custkey").agg(((F.count_distinct("z") == F.count("*")) & (F.max(z) == F.count("*")) & (F.min(z) == 1)).alias("permutation"))


@query("c15_c16_histogram_masks", f"WITH {_DENSE}, m AS (SELECT event_type, avg(n) AS mean FROM d WHERE b >= 5 AND b < 100 GROUP BY 1) SELECT event_type, b AS bin, round(CASE WHEN b >= 5 AND b < 100 THEN n ELSE mean END, 6) AS masked, CASE WHEN b < 2 THEN (SELECT n FROM d e WHERE e.event_type = d.event_type AND e.b = 2) WHEN b >= 253 THEN (SELECT n FROM d e WHERE e.event_type = d.event_type AND e.b = 252) ELSE n END AS unsaturated FROM d JOIN m USING (event_type)")
def c15(spark, d):
    found = S.dense(value_histogram(Tables(spark, d)), ["event_type"])
    both = found.select("event_type", F.arrays_zip(S.masked_to_mean(F.col("counts"), 5, 100).alias("m"), S.saturated(F.col("counts"), 2, 3).alias("s")).alias("z"))
    return both.select("event_type", F.posexplode("z").alias("bin", "z")).select("event_type", F.col("bin").cast("long").alias("bin"), F.round("z.m", 6).alias("masked"), F.col("z.s").alias("unsaturated"))


@query("c09_c10_cutoffs", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount <= 0.02 OR abs(l_extendedprice - 50000) > CASE WHEN l_linenumber <= 3 THEN 30000 ELSE 40000 END THEN 50000.0 ELSE l_extendedprice END::DOUBLE AS delta, CASE WHEN l_discount <= 0.02 THEN CASE WHEN l_linenumber <= 3 THEN 1 ELSE 2 END WHEN abs(l_extendedprice - 50000) > CASE WHEN l_linenumber <= 3 THEN 30000 ELSE 40000 END THEN 3 ELSE 0 END AS class FROM lineitem")
def c09(spark, d):
    """Edges whose correlation is not above the cutoff, or whose delta is too far from the default, take the default and a weight class."""
    inner = F.col("l_linenumber") <= 3
    weak = F.col("l_discount") <= 0.02
    far = F.abs(F.col("l_extendedprice") - 50000) > F.when(inner, 30000).otherwise(40000)
    kind = F.when(weak, F.when(inner, 1).otherwise(2)).when(far, 3).otherwise(0)
    return Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(weak | far, 50000.0).otherwise(F.col("l_extendedprice")).alias("delta"), kind.alias("class"))


@query("c12_cutoff_ladder", "WITH r AS (SELECT unnest([0.09, 0.07, 0.05, 0.03]::DOUBLE[]) AS cut), c AS (SELECT l_suppkey, cut, count(*) FILTER (l_discount > cut) AS n, count(*) AS total FROM lineitem, r GROUP BY 1, 2) SELECT l_suppkey, coalesce(max(cut) FILTER (n >= floor(total * 0.4)), 0.03) AS cutoff FROM c GROUP BY 1")
def c12(spark, d):
    """The highest rung that leaves enough inliers, else the last one: one aggregate counts all rungs."""
    rungs = (0.09, 0.07, 0.05, 0.03)
    g = Tables(spark, d).lineitem.groupBy("l_suppkey").agg(F.count("*").alias("total"), *(F.count_if(F.col("l_discount") > c).alias(f"n{i}") for i, c in enumerate(rungs)))
    best = F.coalesce(*(F.when(F.col(f"n{i}") >= F.floor(F.col("total") * 0.4), c) for i, c in enumerate(rungs)), F.lit(rungs[-1]))
    return g.select("l_suppkey", best.alias("cutoff"))


@query("c08_low_complexity", "SELECT l_partkey, CASE WHEN var_pop(l_quantity) < 100 THEN -2.0 ELSE max(l_discount) END::DOUBLE AS corr FROM lineitem GROUP BY 1")
def c08(spark, d):
    return Tables(spark, d).lineitem.groupBy("l_partkey").agg(F.when(F.round(F.var_pop("l_quantity"), 9) < 100, -2.0).otherwise(F.max("l_discount")).alias("corr"))


_MIRRORED = """WITH r AS (SELECT event_type, event_id AS z, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
p AS (SELECT event_type, n, unnest(range(-10, n + 10)) AS p FROM (SELECT DISTINCT event_type, n FROM r)),
m AS (SELECT *, ((p % (2 * n)) + 2 * n) % (2 * n) AS q FROM p),
a AS (SELECT r.event_type, r.z, r.v, r.n, m.p, avg(r.v) OVER (PARTITION BY r.event_type ORDER BY m.p ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS s FROM m JOIN r ON r.event_type = m.event_type AND r.i = CASE WHEN q < m.n THEN q ELSE 2 * m.n - 1 - q END)
SELECT event_type, z, round(s, 6) AS smooth, abs(v - s) > 20 AS gap FROM a WHERE p >= 0 AND p < n"""


@query("f02_f03_moving_average", _MIRRORED)
def f02(spark, d):
    """A centred moving average over 21 sections of each series, mirrored at its ends."""
    s = Tables(spark, d).events.select("event_type", F.col("event_id").alias("z"), F.col("value").alias("v"))
    m = moving_average(s, "event_type", "z", "v", 10)
    return m.select("event_type", "z", F.round("mean", 6).alias("smooth"), (F.abs(F.col("v") - F.col("mean")) > 20).alias("gap"))


@query("f05_split_sequences", f"WITH s AS ({_Z}) SELECT o_custkey, z, CAST(sum(CASE WHEN o_totalprice < 100000 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY z) AS BIGINT) AS part FROM s")
def f05(spark, d):
    part = F.sum((F.col("o_totalprice") < 100000).cast("int")).over(Window.partitionBy("o_custkey").orderBy("z").rowsBetween(Window.unboundedPreceding, 0))
    return ordered(Tables(spark, d)).select("o_custkey", "z", part.alias("part"))


@query("f06_f12_skip_sequences", f"WITH s AS ({_Z}) SELECT o_custkey, z, (z - 1) % 3 AS lane, lead(o_orderkey, 3) OVER (PARTITION BY o_custkey ORDER BY z) AS next_key, round(lead(o_totalprice, 1) OVER w - lead(o_totalprice, 3) OVER w, 2) AS near_less_far FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY z)")
def f06(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("z")
    return ordered(Tables(spark, d)).select("o_custkey", "z", ((F.col("z") - 1) % 3).alias("lane"), F.lead("o_orderkey", 3).over(w).alias("next_key"), F.round(F.lead("o_totalprice", 1).over(w) - F.lead("o_totalprice", 3).over(w), 2).alias("near_less_far"))


@query("f08_remove_bias", f"WITH s AS ({_Z}), f AS (SELECT o_custkey, regr_slope(o_totalprice, z) AS b, regr_intercept(o_totalprice, z) AS a, avg(o_totalprice) AS m FROM s GROUP BY 1) SELECT o_custkey, z, round(o_totalprice - m + 0.00001234, 4) AS centred, round(o_totalprice - coalesce(a + b * z, m) + 0.00001234, 4) AS straightened FROM s JOIN f USING (o_custkey)")
def f08(spark, d):
    s = ordered(Tables(spark, d))
    f = s.groupBy("o_custkey").agg(F.regr_slope("o_totalprice", "z").alias("b"), F.regr_intercept("o_totalprice", "z").alias("a"), F.avg("o_totalprice").alias("m"))
    p = F.col("o_totalprice")
    return s.join(f, "o_custkey").select("o_custkey", "z", F.round(p - F.col("m") + OFF, 4).alias("centred"), F.round(p - F.coalesce(F.col("a") + F.col("b") * F.col("z"), F.col("m")) + OFF, 4).alias("straightened"))


@query("f09_chunks_with_context", f"WITH s AS ({_Z}) SELECT o_custkey, c AS chunk, z, z > c * 4 AND z <= c * 4 + 4 AS core FROM s, range(0, 40) t(c) WHERE z > c * 4 - 2 AND z <= c * 4 + 6 AND c * 4 < (SELECT max(z) FROM s x WHERE x.o_custkey = s.o_custkey)")
def f09(spark, d):
    """Chunks of four sections with two of context on each side: context rows are copies in the chunk's group."""
    s = ordered(Tables(spark, d)).withColumn("last", F.max("z").over(Window.partitionBy("o_custkey")))
    z = F.col("z")
    near = F.filter(F.sequence(F.floor((z - 7) / 4), F.floor((z + 1) / 4)), lambda c: (c >= 0) & (z > c * 4 - 2) & (z <= c * 4 + 6) & (c * 4 < F.col("last")))
    return s.select("o_custkey", F.explode(near).alias("chunk"), "z").select("o_custkey", "chunk", "z", ((z > F.col("chunk") * 4) & (z <= F.col("chunk") * 4 + 4)).alias("core"))


@query("f11_a09_drop_repeats", "WITH s AS (SELECT event_type, event_id, CAST(floor(value / 20) AS BIGINT) AS x FROM events), l AS (SELECT *, lag(x) OVER (PARTITION BY event_type ORDER BY event_id) AS x0 FROM s) SELECT event_type, event_id, x FROM l WHERE x0 IS NULL OR x <> x0")
def f11(spark, d):
    s = Tables(spark, d).events.select("event_type", "event_id", F.floor(F.col("value") / 20).alias("x"))
    return s.withColumn("x0", F.lag("x").over(Window.partitionBy("event_type").orderBy("event_id"))).where("x0 is null or x <> x0").drop("x0")


@query("g01_top_n_symmetric", "WITH t AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 200 AS b FROM (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_partkey, l_orderkey) AS r FROM lineitem) WHERE r <= 5) SELECT a, b FROM t UNION SELECT b, a FROM t")
def g01(spark, d):
    r = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_orderkey"))
    t = Tables(spark, d).lineitem.withColumn("r", r).where("r <= 5").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 200).alias("b"))
    return t.unionByName(t.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


@query("g06_top_and_bottom", "SELECT * FROM (SELECT 'top' AS which, s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5) UNION ALL SELECT * FROM (SELECT 'bottom', s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 5)")
def g06(spark, d):
    """A report of the five largest and smallest: the limit is the feature."""
    s = Tables(spark, d).supplier.select("s_suppkey", "s_acctbal")
    top = s.orderBy(F.desc("s_acctbal"), "s_suppkey").limit(5).select(F.lit("top").alias("which"), "*")
    return top.unionByName(s.orderBy("s_acctbal", "s_suppkey").limit(5).select(F.lit("bottom").alias("which"), "*"))


@query("g07_natural_sort", "SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY lower(p_name), CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT), p_partkey) AS place FROM part")
def g07(spark, d):
    w = Window.partitionBy("p_type").orderBy(F.lower("p_name"), F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("long"), "p_partkey")
    return Tables(spark, d).part.select("p_partkey", F.row_number().over(w).cast("long").alias("place"))


@query("h01_h04_set_operations", "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.09) SELECT 'difference' AS op, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'intersection', count(*), CAST(sum(k) AS BIGINT) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'union', count(*), CAST(sum(k) AS BIGINT) FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'member', count(*), CAST(sum(k) AS BIGINT) FROM (SELECT p_partkey AS k FROM part WHERE p_partkey IN (SELECT k FROM a))")
def h01(spark, d):
    t = Tables(spark, d)
    a = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k"))
    b = t.lineitem.where("l_discount > 0.09").select(F.col("l_partkey").alias("k"))
    member = t.part.select(F.col("p_partkey").alias("k")).join(a, "k", "left_semi")
    told = [("difference", a.subtract(b)), ("intersection", a.intersect(b)), ("union", a.unionByName(b).distinct()), ("member", member)]
    parts = [df.agg(F.count("*").alias("n"), F.sum("k").alias("total")).select(F.lit(name).alias("op"), "n", "total") for name, df in told]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("n06_swap_sections", f"WITH s AS ({_Z}), w AS (SELECT o_custkey, z, CASE WHEN z % 4 = 1 THEN z + 1 WHEN z % 4 = 2 THEN z - 1 ELSE z END AS to_z FROM s) SELECT s.o_custkey, s.o_orderkey, coalesce(x.z, s.z) AS z FROM s JOIN w ON s.o_custkey = w.o_custkey AND s.z = w.z LEFT JOIN s x ON x.o_custkey = w.o_custkey AND x.z = w.to_z")
def n06(spark, d):
    """Pairs of places swapped at once: all right sides are read before any is written."""
    s = ordered(Tables(spark, d))
    to = F.when(F.col("z") % 4 == 1, F.col("z") + 1).when(F.col("z") % 4 == 2, F.col("z") - 1).otherwise(F.col("z"))
    there = s.select("o_custkey", F.col("z").alias("to_z"))
    return s.withColumn("to_z", to).join(there.withColumn("ok", F.lit(True)), ["o_custkey", "to_z"], "left").select("o_custkey", "o_orderkey", F.when(F.col("ok"), F.col("to_z")).otherwise(F.col("z")).alias("z"))


@query("i22_histogram_match", f"WITH h AS ({_H}), c AS (SELECT event_type, bin, sum(n) OVER (PARTITION BY event_type ORDER BY bin) / sum(n) OVER (PARTITION BY event_type) AS share FROM h), g AS (SELECT bin, sum(n) AS n FROM h GROUP BY 1), t0 AS (SELECT bin AS b, sum(n) OVER (ORDER BY bin) / sum(n) OVER () AS s FROM g), t AS (SELECT b, s, lag(s) OVER (ORDER BY b) AS s0, lag(b) OVER (ORDER BY b) AS b0 FROM t0) SELECT event_type, bin, round(CASE WHEN s0 IS NULL THEN b ELSE b0 + (share - s0) / (s - s0) * (b - b0) END, 6) AS to_ FROM c JOIN t ON share <= s + 1e-12 AND (s0 IS NULL OR share > s0 + 1e-12)")
def i22(spark, d):
    h = value_histogram(Tables(spark, d))
    return S.match_map(h, h.groupBy("bin").agg(F.sum("n").alias("n")), ["event_type"]).select("event_type", "bin", F.round("to", 6).alias("to_"))

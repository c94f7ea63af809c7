"""What shows only in larger tables: wide keys, exact ties, many copies of one point."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seriata.operators import graph, match, neighbors

NEAR = ["d09_translation_vote", "j11_neighbour_counts", "d05_nearest", "e16_local_window", "k13_neighbourhood_test", "k15_affine_filter", "m05_m06_interpolate_outliers", "c19_nearby_outliers"]


def plain(v):
    return round(v, 7) + 0.0 if isinstance(v, float) else v


def same_as_sql(spark, name, folder):
    """Asserts that a query and its SQL give the same rows; returns them."""
    con = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM read_parquet('{folder}/{file}')")
    df = entry.queries()[name](spark, str(folder))
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    out = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in out.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr([plain(r[cols.index(c)]) for c in sorted(cols)]) for r in out.fetchall())
    assert got == want
    return want


def test_names_of_wide_keys(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT i * 4001 AS s_suppkey, CAST(i % 25 AS INTEGER) AS s_nationkey, i * 1.5::DOUBLE AS s_acctbal FROM range(60) t(i)) TO '{tmp_path}/supplier.parquet'")
    assert len(same_as_sql(spark, "i18_units_and_names", tmp_path)) == 60


def test_moving_average_at_exact_ties(spark, tmp_path):
    """Values in steps of 0.35: many lie exactly 20 from their mean, where the last bits of the sum decide."""
    duckdb.sql(f"COPY (SELECT i AS event_id, 'k' || i % 3 AS event_type, hash(i) % 170 * 35 / 100.0::DOUBLE AS value FROM range(60000) t(i)) TO '{tmp_path}/events.parquet'")
    same_as_sql(spark, "f02_f03_moving_average", tmp_path)


@pytest.mark.parametrize("name", NEAR)
def test_copies_of_points_do_not_meet(spark, tmp_path, monkeypatch, name):
    """Twelve points at each of 90 places: places are joined, points are not, and the rows are those of the SQL."""

    def points_with_points(*_):
        raise AssertionError("points were joined with points")

    monkeypatch.setattr(neighbors, "radius_join", points_with_points)
    duckdb.sql(f"COPY (SELECT i AS p_partkey, 'b' || k % 2 AS p_brand, CAST(1 + k * 7 % 11 AS INTEGER) AS p_size, 900 + (k * 13) % 90 * 1.7::DOUBLE AS p_retailprice FROM (SELECT i, (i * 7 + i // 90) % 90 AS k FROM range(1080) t(i))) TO '{tmp_path}/part.parquet'")
    assert same_as_sql(spark, name, tmp_path)


def test_all_pairs_of_histograms_by_blocks(spark):
    """Pairs within a block and across blocks are those of lag_correlation over all edges; a constant histogram has no lag."""
    rng = random.Random(5)
    rows = [(i * 3, [rng.randrange(9) for _ in range(24)] if i else [1] * 24) for i in range(40)]
    h = spark.createDataFrame(rows, "id long, counts array<long>")
    ids = h.select(F.col("id").alias("src"))
    edges = ids.join(ids.withColumnRenamed("src", "dst"), F.col("src") < F.col("dst"))
    told = lambda df: sorted((r.src, r.dst, r.lag, round(r["corr"], 8) + 0.0) for r in df.collect())
    got = told(match.all_lag_correlations(h, 4, 24, block=9))
    assert len(got) == 780 and got == told(match.lag_correlation(h, edges, 4, 24))


def test_forests_of_partitions_are_the_rounds(spark, monkeypatch):
    """Partitions' forests, finished by one task or by rounds over the cluster, give the same disjoint forests, with many equal weights."""
    rng = random.Random(7)
    rows = [(a, b, rng.randrange(4)) for a in range(40) for b in range(40) if a != b and a % 3 == b % 3 and rng.random() < 0.4]
    edges = spark.createDataFrame(rows, "src long, dst long, w long")
    nodes = spark.range(40).withColumnRenamed("id", "node")
    forests = lambda: sorted(tuple(r) for r in graph.spanning_rounds(nodes, edges, 2).collect())
    want = forests()
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    assert want == forests() and sum(r[3] == 0 for r in want) == 37


def test_radius_join_sends_no_side_to_the_driver(spark):
    p = spark.range(50).selectExpr("id", "cast(id % 7 as double) as x", "cast(id % 5 as double) as y")
    assert "Broadcast" not in neighbors.radius_join(p, p, 2.0)._jdf.queryExecution().executedPlan().toString()


def test_radius_join_compares_places(spark, monkeypatch):
    """Forty points at each of twelve places, null ids and null places: lists of ids meet, and all pairs of points are told."""
    rows = [(i, float(i % 4), float(i % 12 // 4)) for i in range(480)] + [(None, 0.0, 0.0), (7, 0.0, -0.0), (900, None, 1.0)]
    p = spark.createDataFrame(rows, "id long, x double, y double")
    near, met = neighbors.near_places, []

    def compared(a, b, *more):
        met.extend((a.count(), b.count()))
        return near(a, b, *more)

    monkeypatch.setattr(neighbors, "near_places", compared)
    got = [tuple(r) for r in neighbors.radius_join(p, p, 1.5, digits=1).collect()]
    told = [(a, b, (x - u) ** 2 + (y - v) ** 2) for a, x, y in rows[:-1] for b, u, v in rows[:-1]]
    assert sorted(map(repr, got)) == sorted(repr((a, b, round(d2, 1))) for a, b, d2 in told if d2 <= 2.25)
    assert met == [12, 12]
    parts = neighbors.listed(p, most=16).collect()
    assert len(parts) > 12 and sorted(str(q.id) for r in parts for q in r.points) == sorted(str(r[0]) for r in rows[:-1])


def test_radius_join_hands_pairs_on_list_by_list(spark):
    """The two explodes share no compiled code, the second one has bare ids, and the few bytes of points still make many tasks."""
    p = spark.range(480).selectExpr("id", "cast(id % 4 as double) as x", "cast(id % 3 as double) as y")
    df = neighbors.radius_join(p, p, 1.5)
    assert df.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism
    df.collect()
    told = [line.lstrip("+-: ") for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Generate explode(" in line and "points" in line.split(", [")[0]]
    second, first = told[:2]
    assert first.startswith("Generate explode(transform(points#") and second.startswith("*(") and "explode(points_r#" in second and "[id_r#" in second


def test_radius_join_deals_out_a_cell(spark):
    """All places lie in one cell, and still several tasks tell their pairs."""
    p = spark.range(64).selectExpr("id", "id / 100 as x", "id / 200 as y")
    got = neighbors.radius_join(p, p, 2.0).withColumn("task", F.spark_partition_id()).collect()
    assert len({(r.id, r.id_r) for r in got}) == len(got) == 64 * 64 and len({r.task for r in got}) > 4


def test_paths_are_never_rows(spark, monkeypatch):
    """Dense and sparse parts, negative and far apart nodes: shortest paths are those of a search, and no step joins edges."""
    rng = random.Random(8)
    edges = {(rng.randrange(-40, 40), rng.randrange(-40, 40)) for _ in range(160)} | {(a, b) for a in range(1000, 1060) for b in range(1000, a)} | {(1059, 10**12), (10**12, 10**12 + 5000), (5, 5)}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = set()
    for a in near:
        seen, front = {a}, {a}
        for n in (1, 2, 3):
            front = {c for b in front for c in near[b]} - seen
            seen |= front
            want |= {(a, b, n) for b in front}
    df = spark.createDataFrame(sorted(edges), "src long, dst long")

    def no_join(*_, **__):
        raise AssertionError("edges were joined with paths")

    monkeypatch.setattr(type(df), "join", no_join)
    got = [tuple(r) for r in graph.hops(df, 3).collect()]
    assert len(got) == len(want) and set(got) == want
    assert graph.hops(df.limit(0), 3).count() == 0


def test_products_of_blocks():
    """By pairs of edges and as matrices."""
    import numpy as np

    rng = np.random.default_rng(3)
    for share in (0.001, 0.05, 0.3):
        a, b = (np.flatnonzero(rng.random(graph.NODES**2) < share) for _ in "ab")
        x, y = (np.isin(np.arange(graph.NODES**2), c).reshape(graph.NODES, -1).astype(np.float32) for c in (a, b))
        assert (graph._product(a, b) == np.flatnonzero(x @ y)).all()
        assert (graph._cells(graph._packed(a)) == a).all()

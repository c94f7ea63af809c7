"""Queries without a filtering twin take their tables whole."""

import os

import pytest

import __spark_entry__ as entry
from seriata.plans import solvers, tables

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_brightness_balance_of_all_suppliers(spark):
    sold = {r[0] for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey").distinct().collect()}
    got = [r.node for r in entry.queries()["j16_j18_brightness_balance"](spark, SF).collect()]
    assert sorted(got) == sorted(sold) and len(got) > 20


def test_spanning_rounds_of_all_suppliers(spark, monkeypatch):
    seen = {}

    def spy(nodes, edges, rounds):
        seen["nodes"], seen["edges"] = nodes.count(), edges.count()
        return edges.limit(0).withColumn("round", solvers.F.lit(0))

    monkeypatch.setattr(solvers.J, "spanning_rounds", spy)
    entry.queries()["j02_spanning_rounds"](spark, SF).collect()
    t = solvers.Tables(spark, SF)
    assert seen == {"nodes": t.supplier.count(), "edges": solvers.supplier_edges(t).count()}


def test_points_are_all_parts(spark):
    for t, points in ((solvers.Tables(spark, SF), solvers.points), (tables.Tables(spark, SF), tables.points)):
        assert points(t).count() == t.part.count() > 1000

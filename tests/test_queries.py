"""Queries against their DuckDB twins at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: These take many small rounds; tests/test_solvers.py holds their operators against brute force.
SLOW = {"j02_spanning_rounds", "l15_clean_mask", "c14_fill_background", "n04_consensus_order", "e11_component_sizes"}
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline")) and n not in SLOW)


def plain(v):
    return round(v, 7) + 0.0 if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = entry.queries()[name](spark, SF)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    out = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in out.description]
    at = [cols.index(c) for c in sorted(cols)]
    assert sorted(df.columns) == sorted(cols)
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in out.fetchall())


def test_entry(spark):
    if os.path.isdir(SF):
        rows = entry.entry(spark).collect()
        assert [r.position for r in rows] == list(range(len(rows))) and len({r.node for r in rows}) == len(rows) > 0

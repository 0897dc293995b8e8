"""Every query against its SQL on the smallest tables; the plans stay free of cross joins."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from kymora.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for r in rows:
        vals = [r[i] for i in order]
        out.append(tuple(None if v is None or isinstance(v, float) and math.isnan(v) else v for v in vals))
    return sorted(out, key=lambda t: tuple((v is not None, str(v)) for v in t))


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6))


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_query_equals_its_sql(spark, duck, name):
    run, sql = QUERIES[name]
    df = run(spark, SF)
    rel = duck.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = plain([tuple(r) for r in df.collect()], df.columns), plain(rel.fetchall(), rel.columns)
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want) if not all(close(x, y) for x, y in zip(a, b))]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if not sql and n != "gbt_oof"))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name][0](spark, SF).count() > 0


def test_joins_make_no_cross_products(spark):
    for name in ("range_join_audio", "asof_hold_join", "interval_overlap_join", "broadcast_baseline_join"):
        plan = QUERIES[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_entry_points(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from alertmill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: also covered by others, and slow
SLOW = {"alert_components", "alert_memberships", "correlation_statistics", "undecided_incidents", "priority_metrics", "ranked_risk"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(frame):
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        if isinstance(v, (int, np.integer)):
            return float(v)
        return round(float(v), 6) if isinstance(v, (float, np.floating)) else v

    return sorted(([one(v) for v in r] for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - SLOW))
def test_query_matches_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 1e-5 * max(1, abs(u))) for u, v in zip(x, y, strict=True)), (x, y)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_whole_tables_of_orders(spark):
    edges = [(r[0], -r[1] - 1) for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()]
    above = {}

    def root(x):
        above.setdefault(x, x)
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        above[max(a, b)] = min(a, b)
    got = registry.QUERIES["order_part_components_whole"](spark, SF).collect()
    assert len(got) == len(above) and {r["node"]: r["component"] for r in got} == {x: root(x) for x in above}
    orders = {r[0]: float(r[1]) for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_totalprice").collect()}
    filled = registry.QUERIES["fill_gaps_whole"](spark, SF).collect()
    assert len(filled) == len(orders) and {r["o_orderkey"]: r["price"] for r in filled} == {k: v if k % 3 == 0 else 0.0 for k, v in orders.items()}

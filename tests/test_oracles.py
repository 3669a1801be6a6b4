"""Every core query with SQL gives what DuckDB gives; every other one runs."""

import glob
import math
import os

import duckdb
import pytest

from sparkgauge.plans.registry import QUERIES, SQL

LIGHT = ["site_placement", "matched_nulls", "counterfactual_regressions"]


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 6) + 0.0
    return str(v)


# At the smallest size an inner training part lacks an emotion, which a probe refuses.
LARGER = {"probe_audit"}


def connect(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.fixture(scope="module")
def small(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, small, name):
    con = small
    if name in LARGER:
        data = data.replace("0.001", "0.01")
        con = connect(data)
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = con.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=repr)
    assert got == want and got


@pytest.mark.parametrize("name", LIGHT)
def test_model_query_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0

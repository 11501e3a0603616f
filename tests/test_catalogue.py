"""Every query with an oracle, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from siftwell.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 5)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalogue.ORACLE:
        assert got
        return
    want = duck.sql(catalogue.ORACLE[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=repr)


def test_pushdown(spark):
    plan = catalogue.QUERIES["filter_collection"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(source" in plan and "text" not in plan.split("ReadSchema")[1]

"""Every query against its SQL twin over the smallest tables, and the shape of a few plans."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "ai_usage_ledger", "companies", "ingestion_documents", "ingestion_pages", "ingestion_occurrences", "eval_items", "reading_labels")

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    if hasattr(v, "is_integer") or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return [str(x) for x in v] if hasattr(v, "__iter__") and not isinstance(v, str) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(plain(v) for v in r)) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    got = entry.queries()[name](spark, DIR).toPandas()
    if sql := entry.oracle_sql().get(name):
        expected = db.execute(sql).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["tenant_id", "usage_day"]


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", ["join_either_key", "join_next_greater", "join_spatial_owner", "join_one_edit", "p1_found"])
def test_no_nested_loops(spark, name):
    text = plan(entry.queries()[name](spark, DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_top_and_pushed_filters(spark):
    assert "TakeOrderedAndProject" in plan(entry.queries()["sort_recent"](spark, DIR))
    scan = plan(entry.queries()["filter_tenant_scope"](spark, DIR))
    assert "EqualTo(tenant_id,1)" in scan and "storage_key" not in scan


def test_registry_refuses_doubles():
    from inkwell.queries.registry import merge

    with pytest.raises(ValueError):
        merge({"a": 1}, {"a": 2})

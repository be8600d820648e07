"""Every registered query of the library against its SQL in DuckDB, and the entry points."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from braidwork import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{value:.5f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(tuple(plain(r[columns.index(c)]) for c in df.columns) for r in got.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in df.collect()) == expected


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_are_pruned(spark):
    plan = catalogue.QUERIES["filter_map"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity" in plan and "l_comment" not in plan and "PushedFilters: [" in plan


def test_sort_is_whole(spark):
    """Every order has its place; `sort` alone shows the first 50."""
    rows = catalogue.QUERIES["sort_all"](spark, DATA).collect()
    assert sorted(r["index"] for r in rows) == list(range(spark.read.parquet(f"{DATA}/orders.parquet").count()))


def test_merge_is_whole(spark):
    rows = catalogue.QUERIES["merge_comparing_all"](spark, DATA).collect()
    assert {r.o_orderkey for r in rows} == {r.o_orderkey for r in spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey").collect()}


def test_fallback_is_whole(spark):
    """After the first failure the whole fallback follows (on tables that have a failure)."""
    larger = DATA.replace("sf0.001", "sf0.01")
    documents = spark.read.parquet(f"{larger}/documents.parquet")
    cut = documents.where("length(text) % 1000 % 211 = 0").agg({"doc_id": "min"}).first()[0]
    assert cut is not None
    got = sorted(r.doc_id for r in catalogue.QUERIES["on_error_resume_all"](spark, larger).collect())
    ids = [r.doc_id for r in documents.select("doc_id").collect()]
    assert got == sorted([d for d in ids if d < cut] + [d + 1_000_000_000 for d in ids])

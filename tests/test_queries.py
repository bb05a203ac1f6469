"""Every engine query against DuckDB on the smallest tables, and the entry module."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from stratum.plans import queries as engine

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in engine.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(engine.queries()))
def test_query_matches_its_sql(spark, duck, name):
    df = engine.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    relation = duck.sql(engine.oracle_sql()[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in relation.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 15
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(engine.queries()) <= set(entry.queries())


def test_python_workers_find_the_package_wherever_the_driver_was_started(spark):
    spark.sparkContext.environment.pop("PYTHONPATH", None)
    entry.queries()["scan_region"](spark, DATA)
    assert entry.HERE in spark.sparkContext.environment["PYTHONPATH"].split(":")

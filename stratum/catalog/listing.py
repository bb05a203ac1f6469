"""What a catalog holds, as small DataFrames ordered by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .catalog import Catalog


def list_databases(spark: SparkSession, catalog: Catalog) -> DataFrame:
    rows = [(n, sum(t.database == i for t in catalog.tables.values())) for i, n in sorted(catalog.databases.items())]
    return spark.createDataFrame(rows, "database string, tables long")


def _within(catalog: Catalog, database: str | None, items) -> list:
    """Items of a database, of all if none is named; none if it does not exist."""
    return [x for _, x in sorted(items.items()) if database is None or catalog.databases[x.database] == database]


def list_tables(spark: SparkSession, catalog: Catalog, database: str | None = None) -> DataFrame:
    rows = []
    for t in _within(catalog, database, catalog.tables):
        fields = catalog.types[t.type].fields
        rows.append((catalog.databases[t.database], t.name, len(fields), ", ".join(fields[i][0] for i in t.primary_key)))
    return spark.createDataFrame(rows, "database string, table string, columns long, primary_key string")


def list_types(spark: SparkSession, catalog: Catalog, database: str | None = None) -> DataFrame:
    rows = [(catalog.databases[t.database], t.name, ", ".join(n for n, _ in t.fields)) for t in _within(catalog, database, catalog.types)]
    return spark.createDataFrame(rows, "database string, type string, fields string")

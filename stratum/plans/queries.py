"""Queries of the engine over the driver's tables, each with its SQL."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import hlc
from ..functions.sortable import sortable_key, unsorted_key
from ..operators import versions as v
from ..sources.tables import read_table as read

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
LINE_KEY, LINE_VERSION = ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"]

SCRIPT = """
create database shop;
create type shop.Item { id: Int64, label: String, sold: Bool };
create type shop.Pair { a: Int64, b: String, c: Bool, };
create table shop.items : shop.Item { primary key (id) };
create table shop.pairs : shop.Pair { primary key (b, a), };
create database spare;
create table spare.items : shop.Item { primary key (id) };
insert into shop.items { id: 1, label: "one", sold: false };
insert into shop.items { id: -7, label: "minus", sold: true, };
insert into shop.items { sold: true label: "uno" id: 1 };
insert into shop.items { id: 9223372036854775807, label: "", sold: false };
insert into shop.pairs { a: 2, b: "x", c: true };
insert into shop.pairs { a: 1, b: "y", c: false };
insert into shop.pairs { a: 1, b: "x", c: false };
"""
_LATEST = "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def scratch(spark: SparkSession) -> str:
    """A fresh folder that the cluster shares; a local one only where none is configured."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared.rstrip('/')}/stratum-{uuid.uuid4().hex}" if shared else f"file://{tempfile.mkdtemp(prefix='stratum-')}"


def _scan(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: read(spark, sf_dir, name)


def _engine(spark: SparkSession) -> Engine:
    engine = Engine(spark, scratch(spark))
    engine.execute(SCRIPT)
    return engine


def project_columns(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")


def project_reorder(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_quantity")


def upsert_latest_event(spark, sf_dir):
    return v.fold(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])


def snapshot_latest(spark, sf_dir):
    return v.fold(v.snapshot(read(spark, sf_dir, "events"), 4000, "event_id"), ["user_id"], ["ts", "event_id"])


def merge_runs(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    first = orders.where("o_orderkey % 3 <> 0").withColumn("run", F.lit(1))
    second = orders.where("o_orderkey % 2 = 0 OR o_orderkey % 3 = 0").withColumn("run", F.lit(2))
    return v.fold(v.merge([first, second]), ["o_orderkey"], ["run"])


def _marked(spark, sf_dir) -> DataFrame:
    """events as a log in which errors delete their user."""
    kind = F.when(F.col("event_type") == "error", v.DELETE).otherwise(v.PUT)
    return read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", kind.alias(v.KIND))


def tombstone_raw(spark, sf_dir):
    return v.fold(_marked(spark, sf_dir), ["user_id"], ["ts", "event_id"])


def tombstone_live(spark, sf_dir):
    return v.live(tombstone_raw(spark, sf_dir))


def point_get(spark, sf_dir):
    return v.point_get(read(spark, sf_dir, "events"), {"user_id": 7}, ["ts", "event_id"])


def seek_from(spark, sf_dir):
    return v.fold(v.seek(read(spark, sf_dir, "lineitem"), "l_orderkey", 1000), LINE_KEY, LINE_VERSION)


def composite_pk(spark, sf_dir):
    return v.fold(read(spark, sf_dir, "lineitem"), LINE_KEY, LINE_VERSION)


def sst_stats(spark, sf_dir):
    log = read(spark, sf_dir, "events").withColumn("run", F.col("event_id") % 4)
    return v.run_statistics(log, "run", "user_id", "event_id")


def compaction_equivalence(spark, sf_dir):
    """Compacted to files, read again and folded: nothing changes."""
    root = scratch(spark)
    v.compact(read(spark, sf_dir, "lineitem"), LINE_KEY, LINE_VERSION).write.parquet(f"{root}/run")
    return v.fold(spark.read.parquet(f"{root}/run"), LINE_KEY, LINE_VERSION)


def hlc_pack_unpack(spark, sf_dir):
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    packed = read(spark, sf_dir, "events").select("event_id", hlc.pack_column(F.floor(micros / 1000), F.col("event_id") % 65536).alias("hlc"))
    return packed.select("event_id", "hlc", hlc.millis_column(F.col("hlc")).alias("ms"), hlc.counter_column(F.col("hlc")).alias("counter"))


def sortable_keys(spark, sf_dir):
    key = sortable_key([(F.col("c_mktsegment"), "String"), (F.col("c_custkey"), "Int64"), (F.col("c_acctbal") < 0, "Bool")])
    return read(spark, sf_dir, "customer").select("c_custkey", key.alias("sort_key"))


def sortable_decode(spark, sf_dir):
    """Keys taken apart again."""
    kinds = ["String", "Int64", "Bool"]
    keys = sortable_keys(spark, sf_dir).withColumns(dict(zip(("segment", "custkey", "in_debt"), unsorted_key(F.col("sort_key"), kinds), strict=True)))
    return keys.select("segment", "custkey", "in_debt")


def seek_composite(spark, sf_dir):
    """From a composite key on, line number 3 of order 1000, in the order of both columns."""
    return v.fold(v.seek(read(spark, sf_dir, "lineitem"), LINE_KEY, (1000, 3)), LINE_KEY, LINE_VERSION)


def _lines(spark, sf_dir) -> Engine:
    """A table of order lines keyed by order and line, filled in two batches."""
    engine = Engine(spark, scratch(spark))
    engine.execute("create database d; create type d.L { o: Int64, n: Int64, flag: String }; create table d.lines : d.L { primary key (o, n) };")
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS o", "l_linenumber AS n", "l_returnflag AS flag", "l_shipdate AS shipped", "l_partkey AS part")
    for where in ("o < 1500", "o >= 1500"):
        engine.insert_frame("d.lines", rows.where(where), order=["shipped", "part"])
    return engine


def table_seek(spark, sf_dir):
    """The engine's seek: the run whose keys all lie below the bound is not opened."""
    return _lines(spark, sf_dir).seek("d.lines", (2000, 2))


def table_get(spark, sf_dir):
    return _lines(spark, sf_dir).get("d.lines", (7, 3))


def insert_literals(spark, sf_dir):
    return _engine(spark).execute("select * from shop.items;")[0]


def script_results(spark, sf_dir):
    return _engine(spark).execute("select c a b from shop.pairs;")[0]


def list_databases(spark, sf_dir):
    return _engine(spark).databases()


def list_tables(spark, sf_dir):
    return _engine(spark).tables()


def list_types(spark, sf_dir):
    return _engine(spark).types("shop")


def bulk_table(spark, sf_dir):
    """A table filled from a DataFrame, changed and partly deleted, read back through the language."""
    engine = Engine(spark, scratch(spark))
    engine.execute("create database d; create type d.C { id: Int64, segment: String }; create table d.customers : d.C { primary key (id) };")
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_mktsegment AS segment")
    engine.insert_frame("d.customers", rows)
    engine.insert_frame("d.customers", rows.where("id % 5 = 0").select("id", F.lit("changed").alias("segment")))
    engine.delete_keys("d.customers", [(3,), (5,)])
    return engine.execute("select * from d.customers;")[0]


def where_after_fold(spark, sf_dir):
    return upsert_latest_event(spark, sf_dir).where("event_type = 'click' OR value >= 50")


def where_statement(spark, sf_dir):
    return _engine(spark).execute('select id label from shop.items where sold = true and id > -100 or label = "";')[0]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f"scan_{t}": _scan(t) for t in TABLES}
    named = (
        project_columns, project_reorder, upsert_latest_event, snapshot_latest, merge_runs, tombstone_raw, tombstone_live, point_get, seek_from,
        composite_pk, seek_composite, table_seek, table_get, sst_stats, compaction_equivalence, hlc_pack_unpack, sortable_keys, sortable_decode, insert_literals, script_results, list_databases, list_tables,
        list_types, bulk_table, where_after_fold, where_statement,
    )
    return out | {f.__name__: f for f in named}


_FOLD_LINES = "QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) = 1"
_LINES = "SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC) = 1"
_MARKED = "SELECT event_id, ts, user_id, event_type, CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS INTEGER) AS _kind FROM events"
_RAW = f"SELECT * FROM ({_MARKED}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def oracle_sql() -> dict[str, str]:
    out = {f"scan_{t}": f"SELECT * FROM {t}" for t in TABLES}
    return out | {
        "project_columns": "SELECT o_orderkey, o_totalprice FROM orders",
        "project_reorder": "SELECT l_shipdate, l_orderkey, l_quantity FROM lineitem",
        "upsert_latest_event": _LATEST,
        "snapshot_latest": _LATEST.replace("FROM events", "FROM events WHERE event_id <= 4000"),
        "merge_runs": "SELECT * FROM (SELECT *, CAST(1 AS INTEGER) AS run FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT *, CAST(2 AS INTEGER) AS run FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY run DESC) = 1",
        "tombstone_raw": _RAW,
        "tombstone_live": f"SELECT * FROM ({_RAW}) WHERE _kind = 1",
        "point_get": "SELECT * FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 1",
        "seek_from": f"SELECT * FROM lineitem WHERE l_orderkey >= 1000 {_FOLD_LINES}",
        "composite_pk": f"SELECT * FROM lineitem {_FOLD_LINES}",
        "sst_stats": "SELECT event_id % 4 AS run, count(*) AS entries, min(user_id) AS min_key, max(user_id) AS max_key, min(event_id) AS min_seq, max(event_id) AS max_seq FROM events GROUP BY event_id % 4",
        "compaction_equivalence": f"SELECT * FROM lineitem {_FOLD_LINES}",
        "hlc_pack_unpack": "SELECT event_id, ((epoch_us(ts) // 1000) << 16) | (event_id % 65536) AS hlc, epoch_us(ts) // 1000 AS ms, event_id % 65536 AS counter FROM events",
        "sortable_keys": "SELECT c_custkey, hex(c_mktsegment) || '0000' || lpad(hex((CAST(c_custkey AS HUGEINT) + 9223372036854775808)::UBIGINT), 16, '0') || CASE WHEN c_acctbal < 0 THEN '01' ELSE '00' END AS sort_key FROM customer",
        "sortable_decode": "SELECT c_mktsegment AS segment, CAST(c_custkey AS BIGINT) AS custkey, c_acctbal < 0 AS in_debt FROM customer",
        "seek_composite": f"SELECT * FROM lineitem WHERE l_orderkey > 1000 OR (l_orderkey = 1000 AND l_linenumber >= 3) {_FOLD_LINES}",
        "table_seek": f"SELECT CAST(l_orderkey AS BIGINT) AS o, CAST(l_linenumber AS BIGINT) AS n, l_returnflag AS flag FROM ({_LINES}) WHERE l_orderkey > 2000 OR (l_orderkey = 2000 AND l_linenumber >= 2)",
        "table_get": f"SELECT CAST(l_orderkey AS BIGINT) AS o, CAST(l_linenumber AS BIGINT) AS n, l_returnflag AS flag FROM ({_LINES}) WHERE l_orderkey = 7 AND l_linenumber = 3",
        "insert_literals": "SELECT CAST(id AS BIGINT) AS id, label, sold FROM (VALUES (1, 'uno', true), (-7, 'minus', true), (9223372036854775807, '', false)) t(id, label, sold)",
        "script_results": "SELECT c, CAST(a AS BIGINT) AS a, b FROM (VALUES (false, 1, 'x'), (true, 2, 'x'), (false, 1, 'y')) t(c, a, b)",
        "list_databases": "SELECT database, CAST(tables AS BIGINT) AS tables FROM (VALUES ('shop', 2), ('spare', 1)) t(database, tables)",
        "list_tables": "SELECT database, \"table\", CAST(columns AS BIGINT) AS columns, primary_key FROM (VALUES ('shop', 'items', 3, 'id'), ('shop', 'pairs', 3, 'b, a'), ('spare', 'items', 3, 'id')) t(database, \"table\", columns, primary_key)",
        "list_types": "SELECT * FROM (VALUES ('shop', 'Item', 'id, label, sold'), ('shop', 'Pair', 'a, b, c')) t(database, type, fields)",
        "bulk_table": "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'changed' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey NOT IN (3, 5)",
        "where_after_fold": f"SELECT * FROM ({_LATEST}) WHERE event_type = 'click' OR value >= 50",
        "where_statement": "SELECT CAST(id AS BIGINT) AS id, label FROM (VALUES (1, 'uno'), (-7, 'minus'), (9223372036854775807, '')) t(id, label)",
    }

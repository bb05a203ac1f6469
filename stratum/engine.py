"""The engine: scripts in, DataFrames out.

``Engine(spark, root).execute(text)`` gives one entry per statement: a lazy DataFrame for a select, None otherwise.
A script with a parse error does nothing; a statement that can't be planned raises after those before it have
taken effect. Consecutive inserts into one table share a write batch. A select shows the table as it was then, whatever is written
and compacted later, until gc() or the reopening of the store after GRACE seconds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog.catalog import TYPES, Catalog, RecordType, Table
from .catalog.listing import list_databases, list_tables, list_types
from .errors import MissingField, NullValue, PlanError, TypeMismatch, refuse
from .functions.hlc import Clock
from .lang.parser import parse_script
from .operators import versions as v
from .plans.planner import AddDatabase, AddTable, AddType, Put, Read, plan
from .store.tables import COMPACT_AT, GRACE, TableStore

#: Column types that a field of each type is filled from.
TAKEN = {"Int64": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "Bool": (T.BooleanType,), "String": (T.StringType, T.VarcharType, T.CharType)}


class Engine:
    def __init__(self, spark: SparkSession, root: str, now_ms: Callable[[], int] | None = None, compact_at: int = COMPACT_AT, grace_s: float = GRACE):
        self.spark = spark
        self.store = TableStore(spark, root, grace_s)
        self.catalog = Catalog(self.store.files)
        self.clock = Clock(self.store.max_hlc, now_ms)
        self._compact_at = compact_at

    def execute(self, text: str) -> list[DataFrame | None]:
        out: list[DataFrame | None] = []
        waiting: list[tuple[Put, int]] = []

        def flush() -> None:
            if waiting:
                puts, waiting[:] = list(waiting), []
                self._write(puts)

        try:
            for statement in parse_script(text):
                if waiting and type(statement).__name__ != "Insert":
                    flush()
                operation = plan(statement, self.catalog)
                if isinstance(operation, Put):
                    if waiting and waiting[0][0].table.id != operation.table.id:
                        flush()
                    waiting.append((operation, self.clock.next()))
                    out.append(None)
                else:
                    out.append(self._run(operation))
        finally:
            flush()
        return out

    def _run(self, operation) -> DataFrame | None:
        if isinstance(operation, AddDatabase):
            self.catalog.create_database(operation.name)
        elif isinstance(operation, AddType):
            self.catalog.create_type(operation.database, operation.name, operation.fields)
        elif isinstance(operation, AddTable):
            self.catalog.create_table(operation.database, operation.name, operation.type, operation.primary_key)
        elif isinstance(operation, Read):
            return self._read(operation)
        return None

    def _read(self, read: Read, at: int | None = None, lower: tuple | None = None, upper: tuple | None = None) -> DataFrame:
        log = self.store.log(read.table.id, read.record.columns(), at, lower, upper)
        if lower:
            log = v.seek(log, read.table.keys, lower)
        if upper is not None and upper == lower:
            log = log.where(reduce(Column.__and__, [F.col(k) == F.lit(x) for k, x in zip(read.table.keys, upper, strict=False)]))
        rows = v.live(v.fold_in_order(log, read.table.keys))
        if read.where is not None:
            rows = rows.where(read.where)
        return rows.select(*[F.col(f"f{i}").alias(read.record.fields[i][0]) for i in read.columns])

    def _write(self, puts: list[tuple[Put, int]]) -> None:
        table, record = puts[0][0].table, puts[0][0].record
        self.store.append_rows(table.id, record.columns(), table.keys, [(*p.values, hlc, v.PUT) for p, hlc in puts])
        self._settle(table, record)

    def _settle(self, table: Table, record: RecordType) -> None:
        """After every write: compact a table of many runs. The runs it replaces stay for results that read them, until gc()."""
        self.store.maybe_compact(table.id, record.columns(), table.keys, self._compact_at)

    def gc(self) -> list[str]:
        """Delete the runs of all tables that compaction replaced or that were never committed; their names. Selects made before a
        compaction have to be collected before this."""
        return [n for t in self.catalog.tables for n in self.store.gc(t)]

    def _named(self, path: str) -> tuple[Table, RecordType]:
        database, _, name = path.partition(".")
        table = self.catalog.table(database, name)
        return table, self.catalog.types[table.type]

    def table(self, path: str, at: int | None = None) -> DataFrame:
        """The live rows of ``database.table`` in key order, as of a sequence number if one is given."""
        table, record = self._named(path)
        return self._read(Read(table, record, tuple(range(len(record.fields))), None), at)

    def seek(self, path: str, lower: tuple, at: int | None = None) -> DataFrame:
        """The live rows from a key on, or from the first columns of one, in key order; runs below it are not opened."""
        table, record = self._named(path)
        return self._read(Read(table, record, tuple(range(len(record.fields))), None), at, tuple(lower))

    def get(self, path: str, key: tuple, at: int | None = None) -> DataFrame:
        """The live row of one key; runs whose keys lie elsewhere are not opened, and in the others Bloom filters tell most that hold none."""
        table, record = self._named(path)
        return self._read(Read(table, record, tuple(range(len(record.fields))), None), at, tuple(key), tuple(key))

    def runs(self, path: str) -> DataFrame:
        """What is known of a table's live runs: entries, sequence numbers and bytes."""
        table, _ = self._named(path)
        rows = [(r.name, r.entries, r.min_seq, r.max_seq, r.bytes) for r in self.store.runs(table.id)]
        return self.spark.createDataFrame(rows, "run string, entries long, min_seq long, max_seq long, bytes long")

    def delete_keys(self, path: str, keys: list[tuple]) -> int:
        """Write a deletion for each key; below the language, as it has no delete statement. Returns the sequence number."""
        t, record = self._named(path)
        blank = {"Int64": 0, "Bool": False, "String": ""}
        rows = []
        for key in keys:
            values = [blank[kind] for _, kind in record.fields]
            for place, value in zip(t.primary_key, key, strict=True):
                if value is None:
                    raise NullValue(record.fields[place][0])
                values[place] = value
            rows.append((*values, self.clock.next(), v.DELETE))
        seq = self.store.append_rows(t.id, record.columns(), t.keys, rows)
        self._settle(t, record)
        return seq

    def insert_frame(self, path: str, rows: DataFrame, order: Sequence[str] = ()) -> int:
        """Put all rows of a DataFrame whose columns carry the field names, as one batch written by the executors.

        Columns must have the fields' types (Int64 takes any integer type) and hold no null: otherwise nothing is committed. The
        rows share one clock value; of rows with one key the largest by the columns of order wins, and among those alike in them
        the one with the largest hash, which is arbitrary but the same on every run. Other columns are not looked at.
        """
        t, record = self._named(path)
        problems: list[PlanError] = []
        given = {f.name: f.dataType for f in rows.schema.fields}
        for name, kind in record.fields:
            if name not in given:
                problems.append(MissingField(name))
            elif not isinstance(given[name], TAKEN[kind]):
                problems.append(TypeMismatch(f"{name}: {kind} expected, {given[name].simpleString()} given"))
        refuse(problems)
        fields = [F.col(f"`{n}`").cast(TYPES[kind]).alias(f"f{i}") for i, (n, kind) in enumerate(record.fields)]
        named = rows.select(*fields, *[F.col(c).alias(f"__by{i}") for i, c in enumerate(order)])
        values, by = named.columns[: len(fields)], named.columns[len(fields) :]
        if t.keys:  # a batch holds a key once
            named = v.fold(named.withColumn("__order", F.xxhash64(*values)), t.keys, [*by, "__order", *values])
        batch = named.select(*values).withColumn(v.HLC, F.lit(self.clock.next())).withColumn(v.KIND, F.lit(v.PUT)).withColumn(v.OP, F.lit(0))
        seq = self.store.append(t.id, record.columns(), t.keys, batch)
        self._settle(t, record)
        return seq

    def databases(self) -> DataFrame:
        return list_databases(self.spark, self.catalog)

    def tables(self, database: str | None = None) -> DataFrame:
        return list_tables(self.spark, self.catalog, database)

    def types(self, database: str | None = None) -> DataFrame:
        return list_types(self.spark, self.catalog, database)

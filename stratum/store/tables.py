"""Change logs of tables as Parquet runs with a commit log.

A write batch is one run: a folder of Parquet files that becomes visible when its commit, an entry of the table's journal, is renamed into
place. All rows of a batch share one sequence number. Readers take only committed runs, so a half-written batch is
never seen. What a run holds is counted while it is written. Compaction writes one run with the newest version of each key and
commits it in place of the runs it read, which stay until gc() collects them, as lazy results may still read them. Opening a store
collects what no commit holds live and was last changed more than GRACE seconds ago. Snapshots older than the last compaction are not kept.

One process writes to a store at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NullValue
from ..operators import versions as v
from .files import Files
from .journal import Journal

FIRST_SEQ = 16
#: Runs at which a table is compacted.
COMPACT_AT = 4
#: Seconds for which results may go on reading replaced runs of a store that is opened again.
GRACE = 3600.0
VERSION_FIELDS = [
    T.StructField(v.HLC, T.LongType(), False),
    T.StructField(v.SEQ, T.LongType(), False),
    T.StructField(v.KIND, T.ByteType(), False),
    T.StructField(v.OP, T.IntegerType(), False),
]


@dataclass(frozen=True)
class Run:
    name: str
    entries: int
    min_seq: int
    max_seq: int
    max_hlc: int
    min_key: list | None
    max_key: list | None
    bytes: int = 0

    def may_hold(self, lower: Sequence | None, upper: Sequence | None) -> bool:
        """Whether a key from lower to upper may be in the run; either may be the first columns of a key alone."""
        if self.min_key is None or self.max_key is None:
            return True
        return (not lower or list(lower) <= self.max_key[: len(lower)]) and (not upper or list(upper) >= self.min_key[: len(upper)])


class TableStore:
    def __init__(self, spark: SparkSession, root: str, grace_s: float = GRACE):
        self.spark = spark
        self.files = Files(spark, root)
        self._live: dict[int, dict[str, Run]] = {}
        self._commits: dict[int, Journal] = {}
        self.next_seq = FIRST_SEQ
        for name in self.files.names("tables"):
            for run in self.runs(int(name)):
                self.next_seq = max(self.next_seq, run.max_seq + 1)
            self.gc(int(name), grace_s)

    @staticmethod
    def log_schema(columns: Sequence[T.StructField]) -> T.StructType:
        return T.StructType([*columns, *VERSION_FIELDS])

    def _journal(self, table: int) -> Journal:
        """The table's commits; after a number of them a snapshot of the live runs takes their place."""
        if table not in self._commits:
            live: dict[str, Run] = {}

            def apply(commit: dict) -> None:
                for gone in commit["remove"]:
                    live.pop(gone, None)
                for run in commit["add"]:
                    live[run["name"]] = Run(**run)

            self._live[table] = live
            self._commits[table] = Journal(self.files, f"tables/{table}/commits", apply, lambda: [{"add": [r.__dict__ for r in live.values()], "remove": []}])
        return self._commits[table]

    def runs(self, table: int) -> list[Run]:
        """Live runs in the order of their commits."""
        self._journal(table)
        return list(self._live[table].values())

    @property
    def max_hlc(self) -> int:
        return max((r.max_hlc for t in self.files.names("tables") for r in self.runs(int(t))), default=0)

    def log(self, table: int, columns: Sequence[T.StructField], at: int | None = None, lower: Sequence | None = None, upper: Sequence | None = None) -> DataFrame:
        """All versions in live runs, up to a sequence number if one is given; runs whose keys all lie outside lower to upper are left out."""
        schema = self.log_schema(columns)
        runs = [r for r in self.runs(table) if (at is None or r.min_seq <= at) and r.may_hold(lower, upper)]
        if not runs:
            return self.spark.createDataFrame([], schema)
        log = self.spark.read.schema(schema).parquet(*[self._folder(table, r.name) for r in runs])
        return log if at is None else v.snapshot(log, at)

    def _folder(self, table: int, run: str) -> str:
        return self.files.full(f"tables/{table}/runs/{run}")

    def append(self, table: int, columns: Sequence[T.StructField], keys: Sequence[str], batch: DataFrame) -> int:
        """Commit a batch (columns, _hlc, _kind, _op) as one run under the next sequence number, which is returned."""
        seq = self.next_seq
        schema = self.log_schema(columns)
        rows = batch.withColumn(v.SEQ, F.lit(seq).cast("long")).select(*[F.col(f.name).cast(f.dataType) for f in schema])
        self._commit(table, keys, rows, schema, f"{seq:016d}", [])
        self.next_seq = seq + 1
        return seq

    def append_rows(self, table: int, columns: Sequence[T.StructField], keys: Sequence[str], rows: Iterable[tuple]) -> int:
        """append() of rows given as (values..., hlc, kind), numbered in order."""
        fields = [*columns, VERSION_FIELDS[0], VERSION_FIELDS[2], VERSION_FIELDS[3]]
        data = [(*r, i) for i, r in enumerate(rows)]
        return self.append(table, columns, keys, self.spark.createDataFrame(data, T.StructType(fields)).coalesce(1))

    def _commit(self, table: int, keys: Sequence[str], rows: DataFrame, schema: T.StructType, name: str, remove: list[str], bloom: bool = True) -> None:
        key = F.struct(*keys) if keys else F.lit(None)
        null = F.coalesce(*[F.when(F.col(f.name).isNull(), F.lit(1)) for f in schema], F.lit(0))
        counted = Observation()
        seen = [F.count("*").alias("entries"), F.min(v.SEQ).alias("min_seq"), F.max(v.SEQ).alias("max_seq"), F.max(v.HLC).alias("max_hlc"), F.min(key).alias("min_key"), F.max(key).alias("max_key")]
        rows = rows.observe(counted, *seen, F.sum(null).alias("nulls"))
        writer = rows.write.mode("overwrite")
        for k in keys if bloom else ():
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
        writer.parquet(self._folder(table, name))
        got = counted.get
        if got["nulls"]:
            self.files.delete(f"tables/{table}/runs/{name}")
            raise NullValue(f"{got['nulls']} rows hold a null")
        plain = lambda x: list(x) if x is not None else None
        size = self.files.size(f"tables/{table}/runs/{name}")
        run = Run(name, got["entries"], got["min_seq"] or 0, got["max_seq"] or 0, got["max_hlc"] or 0, plain(got["min_key"]), plain(got["max_key"]), size)
        self._journal(table).append({"add": [run.__dict__], "remove": remove})

    def compact(self, table: int, columns: Sequence[T.StructField], keys: Sequence[str]) -> bool:
        """Replace all runs by one; deletions stay, older versions go."""
        old = self.runs(table)
        if len(old) < 2:
            return False
        name = f"{max(r.max_seq for r in old):016d}-compact-{len(old)}"
        self._commit(table, keys, v.compact(self.log(table, columns), keys), self.log_schema(columns), name, [r.name for r in old])
        return True

    def maybe_compact(self, table: int, columns: Sequence[T.StructField], keys: Sequence[str], at: int = COMPACT_AT) -> bool:
        return len(self.runs(table)) >= at and self.compact(table, columns, keys)

    def gc(self, table: int, older_s: float = 0) -> list[str]:
        """Delete runs that no commit holds live and that were last changed so many seconds ago; their names. Lazy results that
        were taken before a compaction can't be read any more after this."""
        live = {r.name for r in self.runs(table)}
        gone = [n for n in self.files.names(f"tables/{table}/runs") if n not in live and self.files.age(f"tables/{table}/runs/{n}") >= older_s]
        for name in gone:
            self.files.delete(f"tables/{table}/runs/{name}")
        return gone

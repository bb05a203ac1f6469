"""Versioned reads as DataFrame plans: merge, snapshot, fold, live, seek, get, order.

A change log is a DataFrame whose rows are versions of logical rows. The composition is
``merge -> snapshot -> fold -> live -> (where) -> project -> ordered``: a snapshot bounds the versions that
compete and so stands below the fold; hiding deletions and user predicates stand above it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DELETE, PUT = 0, 1
HLC, SEQ, KIND, OP = "_hlc", "_seq", "_kind", "_op"
VERSION = (HLC, SEQ, KIND, OP)


def merge(runs: Sequence[DataFrame]) -> DataFrame:
    """All runs as one change log; columns are matched by name."""
    return reduce(DataFrame.unionByName, runs)


def snapshot(log: DataFrame, at: int, seq: str = SEQ) -> DataFrame:
    """What had been written up to the sequence number, inclusive."""
    return log.where(F.col(seq) <= F.lit(at))


def fold(log: DataFrame, keys: Sequence[str], version: Sequence[str | Column] = VERSION) -> DataFrame:
    """The newest version of each key; version names its order from the most to the least significant column.

    row_number() = 1 lets Spark drop most losers before the shuffle (a group limit in each task), so that a
    key with very many versions sends one row from each task. Without keys all rows are versions of one row.
    """
    newest = [(F.col(v) if isinstance(v, str) else v).desc_nulls_last() for v in version]
    if not keys:
        return log.orderBy(*newest).limit(1)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))
    return log.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def fold_in_order(log: DataFrame, keys: Sequence[str], version: Sequence[str | Column] = VERSION) -> DataFrame:
    """The fold with its rows in key order, by one exchange for both: ranges of keys hold all versions of a key, too.

    All versions are sent, so this is for logs with a bounded number of versions of a key, as those of a store that compacts."""
    return fold(log.repartitionByRange(*keys), keys, version) if keys else fold(log, keys, version)


def live(folded: DataFrame, kind: str = KIND) -> DataFrame:
    """Without the keys whose newest version is a deletion."""
    return folded.where(F.col(kind) == PUT)


def point_get(log: DataFrame, key: dict[str, object], version: Sequence[str] = VERSION) -> DataFrame:
    """The newest version of one key; the equality reaches the scan."""
    wanted = [F.col(k) == F.lit(v) for k, v in key.items()]
    return fold(log.where(reduce(Column.__and__, wanted)), list(key), version)


def seek(log: DataFrame, keys: str | Sequence[str], lower: object) -> DataFrame:
    """Versions of keys from the bound on; of a composite key, or its first columns, in the order of its columns.

    The first column's bound stands by itself, so that it reaches the scan."""
    if isinstance(keys, str):
        keys, lower = [keys], (lower,)
    beyond = F.lit(True)
    for key, bound in reversed(list(zip(keys, lower, strict=False))):
        beyond = (F.col(key) > F.lit(bound)) | ((F.col(key) == F.lit(bound)) & beyond)
    return log.where(F.col(keys[0]) >= F.lit(lower[0])).where(beyond) if lower else log


def ordered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.orderBy(*keys) if keys else df


def compact(log: DataFrame, keys: Sequence[str], version: Sequence[str] = VERSION, partitions: int | None = None) -> DataFrame:
    """One run with the newest version of every key, deletions kept, laid out in key order."""
    folded = fold(log, keys, version)
    if not keys:
        return folded
    ranged = folded.repartitionByRange(partitions, *keys) if partitions else folded.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def run_statistics(log: DataFrame, run: str, key: str, seq: str) -> DataFrame:
    """Entries, smallest and largest key, smallest and largest sequence number of each run."""
    return log.groupBy(run).agg(
        F.count("*").alias("entries"),
        F.min(key).alias("min_key"),
        F.max(key).alias("max_key"),
        F.min(seq).alias("min_seq"),
        F.max(seq).alias("max_seq"),
    )

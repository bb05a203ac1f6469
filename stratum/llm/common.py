"""What the operators of this subpackage share: tables, lineage cuts, hex and word helpers."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Between two words stand one or more of these: space and the characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session's cluster shares; one is set only where none is configured, as in tests."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    made = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there and lost executors cost only a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._cut_path = path
    return again


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a cut that nothing will read any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


class Steps:
    """Cuts that only serve a later one, to be dropped when that is written."""

    def __init__(self):
        self._made: list[DataFrame] = []

    def cut(self, df: DataFrame) -> DataFrame:
        self._made.append(cut(df))
        return self._made[-1]

    def drop(self) -> None:
        for df in self._made:
            drop_cut(df)
        self._made = []


def sound(c) -> F.Column:
    """A text column that Python can decode: bytes that are not UTF-8 become U+FFFD, all other texts stay as they are."""
    return F.make_valid_utf8(c)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be none of df's columns."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


def hex64(c) -> F.Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))

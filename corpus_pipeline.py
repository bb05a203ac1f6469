"""A corpus pipeline out of the operators of stratum.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame: documents that the quality classifier rejects
go; later copies of line runs go; of every group of near-duplicates the document with the smallest id stays;
documents that hold a benchmark item go; the rest gets mixing rates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratum.llm.common import cut, table
from stratum.llm.decontaminate import remove_contaminated
from stratum.llm.linedup import remove_copies
from stratum.llm.mixing import mixture
from stratum.llm.neardup import keep_representatives
from stratum.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_copies(docs)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture(docs, table(spark, sf_dir, "labels"), docs.columns)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("simhash", simhash),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The stages fit models, double prefixes and compare fingerprints, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

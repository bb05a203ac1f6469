"""Connected components by alternating stars (Kiveris et al., 2014) on DataFrames.

A round is one large-star and one small-star step; each step is a min-aggregate (combined before the
shuffle) and a join that adaptive execution can split, so a hub costs no single task. Rounds grow with
the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def _downward(df: DataFrame) -> DataFrame:
    """Edges as (a, b) with a > b, once each."""
    return (
        df.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")))
    out = both.join(low, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _downward(out), low


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    low = cut(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m"))
    out = edges.join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _downward(out.unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b")))), low


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a long, b long); root is the smallest node reachable.

    Loops, repeated edges and edges with a null end are ignored; no edges give an empty result.
    """
    edges = cut(_downward(edges))
    before = _state(edges)
    while before[0]:
        step, low1 = _large_star(edges)
        middle = cut(step)
        step, low2 = _small_star(middle)
        after_edges = cut(step)
        for old in (edges, low1, middle, low2):
            drop_cut(old)
        edges, after = after_edges, _state(after_edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)

from __future__ import annotations

from pyspark.sql import functions as F

from stratum.functions import hlc
from stratum.functions.sortable import sortable, sortable_key, unsorted_key
from stratum.operators import versions as v

SCHEMA = "key string, value string, _hlc long, _seq long, _kind byte, _op int, run int"


def log(spark, *rows):
    return spark.createDataFrame([(*r, 0, 1) if len(r) == 5 else r for r in rows], SCHEMA)


def pairs(df):
    return sorted((r.key, r.value) for r in df.collect())


def test_merge_keeps_all_and_fold_takes_the_newest(spark):
    a, b = log(spark, ("1", "a", 1, 1, 1), ("3", "c", 1, 1, 1)), log(spark, ("2", "b", 1, 2, 1), ("1", "new", 1, 100, 1))
    merged = v.merge([a, b])
    assert merged.count() == 4
    assert pairs(v.fold(merged, ["key"])) == [("1", "new"), ("2", "b"), ("3", "c")]
    assert [r.key for r in v.ordered(v.fold(merged, ["key"]), ["key"]).collect()] == ["1", "2", "3"]


def test_snapshot_stands_below_the_fold(spark):
    rows = log(spark, ("apple", "v1", 0, 1, 1), ("apple", "v2", 0, 3, 1), ("apple", "v3", 0, 5, 1), ("banana", "x", 0, 2, 1))
    seen = [dict(pairs(v.fold(v.snapshot(rows, at), ["key"]))).get("apple") for at in (5, 4, 3, 2, 1, 0)]
    assert seen == ["v3", "v2", "v2", "v1", "v1", None]


def test_deletions_win_and_hide(spark):
    rows = log(spark, ("a", "old", 1, 1, 1), ("a", "new", 2, 2, 1), ("b", "put", 1, 1, 1), ("b", "", 2, 2, 0))
    folded = v.fold(rows, ["key"])
    assert sorted((r.key, r._kind) for r in folded.collect()) == [("a", 1), ("b", 0)]
    assert pairs(v.live(folded)) == [("a", "new")]
    # put and delete in one batch: put wins; a repeated put: the later one
    both = log(spark, ("k", "put", 1, 1, 1), ("k", "", 1, 1, 0), ("k", "later", 1, 1, 1, 5, 1))
    assert pairs(v.live(v.fold(both, ["key"]))) == [("k", "later")]
    # a deletion is not undone by an older run
    assert v.live(v.point_get(rows, {"key": "b"})).count() == 0


def test_get_seek_statistics_compaction(spark):
    rows = log(spark, ("a", "1", 1, 1, 1, 0, 1), ("c", "1", 1, 1, 1, 0, 1), ("a", "2", 2, 2, 1, 0, 2), ("b", "1", 2, 2, 1, 0, 2))
    assert pairs(v.point_get(rows, {"key": "a"})) == [("a", "2")]
    assert pairs(v.fold(v.seek(rows, "key", "b"), ["key"])) == [("b", "1"), ("c", "1")]
    assert pairs(v.compact(rows, ["key"])) == [("a", "2"), ("b", "1"), ("c", "1")]
    stats = {r.run: (r.entries, r.min_key, r.max_key, r.min_seq, r.max_seq) for r in v.run_statistics(rows, "run", "key", "_seq").collect()}
    assert stats == {1: (2, "a", "c", 1, 1), 2: (2, "a", "b", 2, 2)}


def test_fold_plan_limits_before_the_shuffle_and_pushes_keys(spark, tmp_path):
    log(spark, ("a", "1", 1, 1, 1)).write.parquet(str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    plan = v.point_get(stored, {"key": "a"})._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "EqualTo(key,a)" in plan


def test_a_fold_in_order_takes_one_exchange(spark, tmp_path):
    given = [(f"k{i * 7919 % 500:03d}", f"v{n}", n, n, 1) for n in range(3) for i in range(500)]
    log(spark, *given).repartition(6).write.parquet(str(tmp_path / "log"))
    df = v.live(v.fold_in_order(spark.read.parquet(str(tmp_path / "log")), ["key"]))
    got = [(r.key, r.value) for r in df.collect()]
    assert got == [(f"k{i:03d}", "v2") for i in range(500)]
    assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange") == 1


def test_clock():
    times = iter([100, 100, 99, 200])
    c = hlc.Clock(now_ms=lambda: next(times))
    got = [hlc.unpack(c.next()) for _ in range(4)]
    assert got == [(100, 0), (100, 1), (100, 2), (200, 0)]
    c = hlc.Clock(hlc.pack(5, 65535), lambda: 1)
    assert hlc.unpack(c.next()) == (6, 0)
    c.observe(hlc.pack(9, 9))
    assert hlc.unpack(c.next()) == (9, 10)


def test_sortable_keys_are_taken_apart_again(spark):
    given = [(-(2**63), "", True), (5, "a\0b\0\0", False), (2**63 - 1, "é😀\0", True), (-1, "\x0f\xff0", False), (0, "00FF", True)]
    kinds = ["String", "Int64", "Bool", "String"]
    df = spark.createDataFrame(given, "i long, s string, b boolean").select(sortable_key([(F.col(c), k) for c, k in zip("sibs", kinds, strict=True)]).alias("k"))
    assert [tuple(r) for r in df.select(*unsorted_key(F.col("k"), kinds)).collect()] == [(s, i, b, s) for i, s, b in given]
    bad = spark.createDataFrame([("",), ("zz",), ("00",), ("0000" + "0" * 16 + "02",)], "k string")
    assert [r[2] for r in bad.select(*unsorted_key(F.col("k"), kinds)).collect()] == [None] * 4


def test_seek_on_a_composite_key(spark):
    given = [(a, b) for a in range(4) for b in "xyz"]
    df = spark.createDataFrame(given, "a long, b string")
    for lower in ((1, "y"), (1,), (3, "z"), (2, "w"), (9, "a"), ()):
        assert sorted(map(tuple, v.seek(df, ["a", "b"], lower).collect())) == [g for g in given if g >= lower]
    assert "isnotnull(a" in v.seek(df, ["a", "b"], (1, "y"))._jdf.queryExecution().optimizedPlan().toString()


def test_sortable_order(spark):
    ints = [-(2**63), -1000, -1, 0, 1, 1000, 2**63 - 1]
    got = [r.k for r in spark.createDataFrame([(i,) for i in ints], "x long").select(sortable(F.col("x"), "Int64").alias("k")).collect()]
    assert got == sorted(got) and len(set(got)) == len(ints)
    texts = ["", "\0", "a", "a\0b", "a\x01b", "aa", "ab", "b", "z", "é", "😀"]
    got = [r.k for r in spark.createDataFrame([(t,) for t in texts], "x string").select(sortable(F.col("x"), "String").alias("k")).collect()]
    assert got == sorted(got) and got[3] == "6100FF620000"
    got = [r.k for r in spark.createDataFrame([(False,), (True,)], "x boolean").select(sortable(F.col("x"), "Bool").alias("k")).collect()]
    assert got == ["00", "01"]

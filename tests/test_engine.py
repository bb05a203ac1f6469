from __future__ import annotations

import uuid

import pytest

from stratum import errors
from stratum.catalog.catalog import Catalog
from stratum.cli import command, statements
from stratum.engine import Engine
from stratum.lang.parser import ParseFailure
from stratum.store.files import Files

USERS = "create database main; create type main.User { id: Int64, username: String }; create table main.users : main.User { primary key (id) };"


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_create_insert_select(spark, root):
    out = Engine(spark, root).execute(USERS + 'insert into main.users { id: 1, username: "John" }; select * from main.users; select username from main.users;')
    assert out[:4] == [None] * 4
    assert out[4].columns == ["id", "username"] and rows(out[4]) == [(1, "John")] and rows(out[5]) == [("John",)]


def test_a_second_insert_replaces_and_columns_may_repeat(spark, root):
    e = Engine(spark, root)
    e.execute(USERS + 'insert into main.users { id: 2, username: "b" }; insert into main.users { id: 1, username: "x", id: 3 };')
    e.execute('insert into main.users { id: 2, username: "c" };')
    out = e.execute("select username id username from main.users;")[0]
    assert out.columns == ["username", "id", "username"] and rows(out) == [("c", 2, "c"), ("x", 3, "x")]


def test_composite_and_empty_keys(spark, root):
    e = Engine(spark, root)
    e.execute("create database m; create type m.Pair { a: Int64, b: String, c: Bool }; create table m.pairs : m.Pair { primary key (b, a) };")
    e.execute('insert into m.pairs { a: 2, b: "x", c: true }; insert into m.pairs { a: 1, b: "y", c: false }; insert into m.pairs { a: 1, b: "x", c: false };')
    assert rows(e.table("m.pairs")) == [(1, "x", False), (2, "x", True), (1, "y", False)]
    e.execute("create type m.One { v: Int64 }; create table m.ones : m.One { primary key () };")
    e.execute("insert into m.ones { v: 1 }; insert into m.ones { v: 2 }; insert into m.ones { v: 3 };")
    assert rows(e.execute("select * from m.ones;")[0]) == [(3,)]


def test_a_type_may_be_shared_and_come_from_elsewhere(spark, root):
    e = Engine(spark, root)
    e.execute(USERS + 'create database b; create table b.users : main.User { primary key (username) }; insert into b.users { id: 1, username: "q" };')
    assert rows(e.table("b.users")) == [(1, "q")] and rows(e.table("main.users")) == []


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("select * from users;", errors.UnqualifiedPath),
        ("select * from missing.users;", errors.DatabaseNotFound),
        ("select * from main.missing;", errors.TableNotFound),
        ("select nope from main.users;", errors.FieldNotFound),
        ("create database main;", errors.DuplicateDatabase),
        ("create type main.User { id: Int64 };", errors.DuplicateType),
        ("create type main.V { id: int64 };", errors.TypeNotFound),
        ("create type main.V { id: main.User };", errors.TypeNotFound),
        ("create type V { id: Int64 };", errors.UnqualifiedPath),
        ("create table main.users : main.User { primary key (id) };", errors.DuplicateTable),
        ("create table main.t : main.Nope { primary key (id) };", errors.TypeNotFound),
        ("create table main.t : main.User { primary key (nope) };", errors.FieldNotFound),
        ("insert into main.users { id: 1 };", errors.MissingField),
        ('insert into main.users { id: 1, username: "a", x: 1 };', errors.FieldNotFound),
        ('insert into main.users { id: "1", username: "a" };', errors.TypeMismatch),
        ('insert into main.users { id: 9223372036854775808, username: "a" };', errors.IntegerOverflow),
        ("select * from main.users where id = true;", errors.TypeMismatch),
    ],
)
def test_plan_errors_keep_what_ran_before(spark, root, text, error):
    e = Engine(spark, root)
    with pytest.raises(error):
        e.execute(USERS + 'insert into main.users { id: 1, username: "a" };' + text + "create database never;")
    assert rows(e.table("main.users")) == [(1, "a")] and "never" not in e.catalog.databases.values()


def test_a_parse_error_runs_nothing(spark, root):
    e = Engine(spark, root)
    with pytest.raises(ParseFailure):
        e.execute("create database a; create database")
    assert e.catalog.databases == {}


def test_reopening_keeps_rows_ids_and_clock(spark, root):
    e = Engine(spark, root, now_ms=lambda: 10_000)
    e.execute(USERS + 'insert into main.users { id: 1, username: "new" };')
    again = Engine(spark, root, now_ms=lambda: 5)  # a clock that went back
    again.execute('insert into main.users { id: 1, username: "newer" }; create database second;')
    assert rows(again.table("main.users")) == [(1, "newer")]
    assert sorted(again.catalog.databases) == [1, 4] and again.store.next_seq > e.store.next_seq - 1


def test_journal_rotation_keeps_the_catalog(spark, root):
    files = Files(spark, root)
    c = Catalog(files, rotate_after=3)
    for i in range(8):
        c.create_database(f"d{i}")
    c.create_type(1, "T", [("a", "Int64")])
    c.rotate()
    c.create_table(1, "t", 9, [0])
    again = Catalog(files)
    assert again.databases == c.databases and again.types == c.types and again.tables == c.tables
    assert len(files.names("catalog")) == 2
    with pytest.raises(errors.DatabaseNotFound):
        again.create_type(99, "T", [])
    with pytest.raises(errors.InvalidName):
        again.create_database("a\0b")


def test_deletes_snapshots_compaction_and_gc(spark, root):
    e = Engine(spark, root, compact_at=100)
    e.execute(USERS)
    t = e.catalog.table("main", "users")
    columns = e.catalog.types[t.type].columns()
    e.execute("".join(f'insert into main.users {{ id: {i}, username: "k{i}" }};' for i in range(6)))
    seq = e.store.next_seq - 1
    e.delete_keys("main.users", [(0,), (2,), (4,)])
    e.execute('insert into main.users { id: 2, username: "back" };')
    expected = [(1, "k1"), (2, "back"), (3, "k3"), (5, "k5")]
    assert rows(e.table("main.users")) == expected
    assert len(rows(e.table("main.users", at=seq))) == 6 and rows(e.table("main.users", at=seq - 1)) == []
    e.spark.range(1).write.parquet(f"{root}/tables/{t.id}/runs/half-written")
    assert rows(e.table("main.users")) == expected
    assert e.store.compact(t.id, columns, t.keys)
    assert len(e.store.runs(t.id)) == 1 and rows(e.table("main.users")) == expected
    assert e.store.log(t.id, columns).where("_kind = 0").count() == 2  # deletions stay
    assert "half-written" in e.store.gc(t.id)
    again = Engine(spark, root)
    assert rows(again.table("main.users")) == expected and again.store.runs(t.id)[0].min_key == [0]


def test_batches_compact_by_themselves(spark, root):
    e = Engine(spark, root)
    e.execute(USERS)
    for i in range(5):
        e.execute(f'insert into main.users {{ id: {i % 2}, username: "v{i}" }};')
    assert len(e.store.runs(e.catalog.table("main", "users").id)) < 4
    assert rows(e.table("main.users")) == [(0, "v4"), (1, "v3")]


def test_selects_stay_valid_when_the_table_is_compacted(spark, root):
    e = Engine(spark, root)
    e.execute(USERS + 'insert into main.users { id: 1, username: "first" };')
    before = e.execute("select * from main.users;")[0]
    mixed = e.execute("".join(f'insert into main.users {{ id: {i}, username: "u{i}" }}; select username from main.users;' for i in range(2, 8)))[1::2]
    t = e.catalog.table("main", "users").id
    assert len(e.store.runs(t)) < 4 < len(e.store.files.names(f"tables/{t}/runs"))
    assert rows(before) == [(1, "first")] and [len(rows(m)) for m in mixed] == [2, 3, 4, 5, 6, 7]
    again = Engine(spark, root)  # within the grace time nothing goes
    assert rows(before) == [(1, "first")] and len(rows(again.table("main.users"))) == 7
    spark.range(1).write.parquet(f"{root}/tables/{t}/runs/half-written")
    swept = Engine(spark, root, grace_s=0)
    assert len(swept.store.files.names(f"tables/{t}/runs")) == len(swept.store.runs(t)) and len(rows(swept.table("main.users"))) == 7


def test_frames_and_deletes_compact_and_commits_are_rotated(spark, root):
    e = Engine(spark, root)
    e.execute(USERS)
    t = e.catalog.table("main", "users").id
    for i in range(5):
        e.insert_frame("main.users", spark.createDataFrame([(i, f"n{i}"), (9, f"n{i}")], "id int, username string").selectExpr("username", "id", "1 AS more"))
    for i in range(3):
        e.delete_keys("main.users", [(i,)])
    assert len(e.store.runs(t)) < 4 and rows(e.table("main.users")) == [(3, "n3"), (4, "n4"), (9, "n4")]
    assert {r.run for r in e.runs("main.users").collect()} == {r.name for r in e.store.runs(t)} and all(r.bytes > 0 and r.entries for r in e.runs("main.users").collect())
    e.gc()
    e.store._commits[t].rotate()
    assert len(e.store.files.names(f"tables/{t}/commits")) == 1
    e.execute('insert into main.users { id: 5, username: "later" };')
    again = Engine(spark, root)
    assert rows(again.table("main.users")) == [(3, "n3"), (4, "n4"), (5, "later"), (9, "n4")] and again.store.next_seq == e.store.next_seq


def test_frames_are_checked_before_they_are_committed(spark, root):
    e = Engine(spark, root)
    e.execute(USERS)
    t = e.catalog.table("main", "users").id
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    for data, schema, error in (
        ([(None, "a"), (1, "b")], "id long, username string", errors.NullValue), ([(1, None)], "id long, username string", errors.NullValue),
        ([("1", "a")], "id string, username string", errors.TypeMismatch), ([(1.0, "a")], "id double, username string", errors.TypeMismatch), ([(1,)], "id long", errors.MissingField),
    ):
        with pytest.raises(error):
            e.insert_frame("main.users", frame(data, schema))
    with pytest.raises(errors.NullValue):
        e.delete_keys("main.users", [(None,)])
    assert e.store.runs(t) == [] and e.store.files.names(f"tables/{t}/runs") == []
    e.insert_frame("main.users", frame([(1, "a", 2), (1, "b", 3), (1, "c", 1)], "id short, username string, v int"), order=["v"])
    assert rows(e.table("main.users")) == [(1, "b")]


def test_all_problems_of_a_statement_are_told(spark, root):
    e = Engine(spark, root)
    e.execute(USERS)
    for text, kinds in (
        ("insert into main.users { id: true, nope: 1, other: 2 };", ["FieldNotFound", "FieldNotFound", "TypeMismatch", "MissingField"]),
        ("select a b id from main.users where c = 1 and id = true;", ["FieldNotFound", "FieldNotFound", "FieldNotFound", "TypeMismatch"]),
        ("create type main.V { a: Int, b: Text, a: Bool };", ["TypeNotFound", "TypeNotFound", "DuplicateField"]),
        ("create table main.t : main.User { primary key (x, y) };", ["FieldNotFound", "FieldNotFound"]),
    ):
        with pytest.raises(errors.PlanError) as got:
            e.execute(text)
        assert [type(p).__name__ for p in got.value.problems] == kinds
    with pytest.raises(errors.DuplicateField):
        e.catalog.create_type(1, "W", [("a", "Int64"), ("a", "Bool")])


def _rows_read(df):
    """Rows that the scans of a plan gave, after it ran."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    total, todo = 0, [leaves.apply(i) for i in range(leaves.size())]
    while todo:
        leaf = todo.pop()
        if "QueryStage" in leaf.nodeName():
            inner = leaf.plan().collectLeaves()
            todo += [inner.apply(i) for i in range(inner.size())]
        elif "AdaptiveSparkPlan" in leaf.nodeName():
            inner = leaf.executedPlan().collectLeaves()
            todo += [inner.apply(i) for i in range(inner.size())]
        elif leaf.metrics().contains("numOutputRows"):
            total += leaf.metrics().apply("numOutputRows").value()
    return total


def test_reads_by_key_open_the_runs_that_may_hold_it(spark, root):
    e = Engine(spark, root, compact_at=100)
    e.execute("create database m; create type m.P { a: Int64, b: String, c: Bool }; create table m.p : m.P { primary key (a, b) };")
    for low in (0, 100, 200):
        e.insert_frame("m.p", spark.range(low, low + 100, 2).selectExpr("id AS a", "concat('k', id % 3) AS b", "true AS c"))
    files = lambda df: len(df.inputFiles())
    whole = files(e.table("m.p"))
    assert rows(e.get("m.p", (104, "k2"))) == [(104, "k2", True)] and 0 < files(e.get("m.p", (104, "k2"))) < whole
    assert rows(e.get("m.p", (104, "k0"))) == [] and files(e.get("m.p", (999, "k0"))) == 0
    want = [(a, f"k{a % 3}", True) for a in range(196, 300, 2) if (a, f"k{a % 3}") >= (196, "k1")]
    assert rows(e.seek("m.p", (196, "k1"))) == want and files(e.seek("m.p", (200,))) < whole
    assert len(rows(e.seek("m.p", ()))) == 150
    # Odd keys lie within the bounds of a run, and its Bloom filters tell that none is there.
    assert _rows_read(e.get("m.p", (104, "k2"))) > 0 and _rows_read(e.get("m.p", (105, "k0"))) == 0


def test_listings_and_prompt(spark, root, capsys):
    e = Engine(spark, root)
    e.execute(USERS)
    assert rows(e.databases()) == [("main", 1)] and rows(e.tables()) == [("main", "users", 2, "id")]
    assert rows(e.types("main")) == [("main", "User", "id, username")] and rows(e.tables("nope")) == []
    for line in (".help", ".dbs", ".tables main", ".types", ".what"):
        assert command(e, line)
    assert not command(e, ".q")
    statements(e, "select * from main.users; ")
    statements(e, "select * from nope.x;")
    statements(e, "select")
    said = capsys.readouterr().out
    assert "username" in said and "DatabaseNotFound" in said and "UnexpectedEnd" in said

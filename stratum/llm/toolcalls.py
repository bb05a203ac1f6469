"""Chat formatting with tool calls linked to their results, in DataFrame functions only.

A turn's text may be JSON. A call is ``{"tool_calls": [{"id", "name", "arguments"}]}`` in an assistant's turn (a "content" beside
it is its text), a result ``{"tool_call_id", "content"}`` in a tool's turn; all other text is plain. Calls and results are joined
by conversation and identifier. Arguments are checked against the tool's schema: required ones present, none
unknown, each of its type. Calls are ordered topologically: one that names another call's result in its arguments
(``"$id"``) stands behind it; its level is the length of the longest chain of needs behind it, and a call on or behind a cycle has none.

The result is one line of canonical JSON for every message, keys sorted and no spaces, with the message's own calls by level, place
and identifier, each with its result. So a line is as long as its message and the results it links, whatever the size of its conversation, and
no task and no row gathers a conversation: those of any length give the same kind of lines, and sorting them by turn and
line gives the conversation in order. A call may have its level from calls in any turn.

Levels take rounds in the logarithm of the longest chain: the needs of 2^k steps are joined with themselves to those of 2^(k+1),
and a call's level is then read bit by bit from the largest on. A table of needs holds one row for each call and each call
that lies so many steps behind it: as many as calls in chains and trees, more where calls need several others over many steps.

Cases: a null role is "unknown" and a null text is empty; a null turn is written as null; repeated rows are messages of their own,
alike; turns with a null conv_id form one conversation; an identifier used twice in a conversation links its first result (by turn,
null first, then content) and needs what any of its calls needs; a call without a result has null; a result without a call counts in n_orphans; calls
without id or name are left out; broken JSON is plain text; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop_cut, table

#: Tools known to the query: name -> argument -> (type, required). Types: string, integer, number, boolean, object, array.
SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "weather": {"city": ("string", True), "days": ("integer", False)},
    "calculator": {"expression": ("string", True)},
}
_CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>,content:string>"
_RESULT = "struct<tool_call_id:string,content:string>"
#: What names a message that holds calls; rows alike in all of it are alike.
_MESSAGE = ["conv_id", "turn", "text_hash"]


def schema_table(spark, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """(tool, argument, kind, required), one row per argument."""
    rows = [(t, a, k, r) for t, args in schemas.items() for a, (k, r) in args.items()]
    kind = T.StructType([T.StructField("tool", T.StringType()), T.StructField("argument", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("required", T.BooleanType())])
    return spark.createDataFrame(rows, kind)


def quoted(c):
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def _kind(value):
    """The JSON type of a value as written, strings having lost their quotes being told apart by the raw text."""
    return (
        F.when(value.rlike(r'^\s*"'), "string")
        .when(value.rlike(r"^\s*-?(0|[1-9][0-9]*)\s*$"), "integer")
        .when(value.rlike(r"^\s*-?[0-9][0-9.eE+-]*\s*$"), "number")
        .when(value.rlike(r"^\s*(true|false)\s*$"), "boolean")
        .when(value.rlike(r"^\s*\{"), "object")
        .when(value.rlike(r"^\s*\["), "array")
        .otherwise("null")
    )


def _arguments(raw):
    """map<argument, raw JSON value> of an object's text."""
    parsed = F.from_json(raw, "map<string,variant>")
    return F.transform_values(parsed, lambda _, v: F.to_json(v))


def messages(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, text_hash, said, result) with nulls settled; said and result are what a JSON text holds, else null."""
    plain = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    json = F.col("text").startswith("{")
    said = F.when(json & (F.col("role") == "assistant"), F.from_json("text", _CALLS))
    result = F.when(json & (F.col("role") == "tool"), F.from_json("text", _RESULT))
    return plain.withColumn("text_hash", F.xxhash64("text")).withColumn("said", F.when(said["tool_calls"].isNotNull(), said)).withColumn("result", F.when(result["tool_call_id"].isNotNull(), result))


def node(conv, name):
    """A call's name in all conversations."""
    text = conv.cast("string")
    return F.concat(F.coalesce(F.length(text).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit("")), name)


def calls_and_results(said: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls of each distinct message, first result of each identifier)."""
    calls = (
        said.where("said IS NOT NULL")
        .select(*_MESSAGE, "said")
        .dropDuplicates(_MESSAGE)
        .select(*_MESSAGE, F.posexplode("said.tool_calls").alias("place", "c"))
        .select(*_MESSAGE, "place", F.col("c.id").alias("id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("raw"))
        .where("id IS NOT NULL AND name IS NOT NULL")
        .withColumn("node", node(F.col("conv_id"), F.col("id")))
    )
    results = said.where("result IS NOT NULL").select(node(F.col("conv_id"), F.col("result.tool_call_id")).alias("r_node"), "turn", F.col("result.content").alias("content"))
    return calls, results.groupBy("r_node").agg(F.min(F.struct("turn", "content")).alias("f")).select("r_node", F.col("f.content").alias("content"))


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls with valid, the arguments as canonical JSON and the identifiers they need; an unknown tool is not valid."""
    wanted = schemas.groupBy("tool").agg(F.map_from_entries(F.collect_list(F.struct("argument", F.struct("kind", "required")))).alias("spec"))
    joined = calls.join(wanted, F.col("name") == F.col("tool"), "left").withColumn("args", _arguments("raw"))
    known = F.forall(F.map_entries("args"), lambda e: F.map_contains_key(F.col("spec"), e["key"]))
    typed = F.forall(
        F.map_entries("args"),
        lambda e: (F.col("spec")[e["key"]]["kind"] == _kind(e["value"])) | ((F.col("spec")[e["key"]]["kind"] == "number") & (_kind(e["value"]) == "integer")),
    )
    there = F.forall(F.map_entries("spec"), lambda e: ~e["value"]["required"] | F.map_contains_key(F.col("args"), e["key"]))
    entries = F.transform(F.array_sort(F.map_keys("args")), lambda k: F.concat(quoted(k), F.lit(":"), F.col("args")[k]))
    canonical = F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))
    return joined.select(
        *_MESSAGE, "place", "id", "name", "node",
        F.coalesce(known & typed & there, F.lit(False)).alias("valid"),
        F.coalesce(canonical, F.lit("null")).alias("arguments"),
        F.expr(r"""array_distinct(regexp_extract_all(coalesce(raw, ''), '"\\$([^"\\\\]+)"', 1))""").alias("needs"),
    )


def levels(calls: DataFrame) -> DataFrame:
    """(l_node, level) of the calls that need another: the length of the longest chain behind it, null on or behind a cycle."""
    met = calls.select(F.col("node").alias("b")).distinct()
    asked = calls.select(F.col("node").alias("a"), "conv_id", F.explode("needs").alias("need")).select("a", node(F.col("conv_id"), F.col("need")).alias("b"), "conv_id")
    edges = cut(asked.join(met, "b").select("conv_id", "a", "b").distinct())
    # A chain longer than its conversation has calls goes round a cycle.
    ends = edges.select("conv_id", F.explode(F.array("a", "b")).alias("n")).distinct()
    most = ends.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    steps = [cut(edges.select("a", "b"))] if most else []
    endless = edges.select("a").limit(0)
    while steps:
        if (1 << (len(steps) - 1)) >= most:
            endless = cut(steps.pop().select("a").distinct())
            break
        last = steps[-1]
        further = cut(last.join(last.select(F.col("a").alias("m"), F.col("b").alias("c")), F.col("b") == F.col("m")).select("a", F.col("c").alias("b")).distinct())
        if further.isEmpty():
            break
        steps.append(further)
    at = edges.select("a", F.col("a").alias("end"), F.lit(0).alias("level")).distinct().join(endless, "a", "left_anti")
    for k in reversed(range(len(steps))):
        moved = cut(at.join(steps[k].withColumnsRenamed({"a": "m", "b": "c"}), F.col("end") == F.col("m")).select("a", F.col("c").alias("end"), (F.col("level") + (1 << k)).alias("level")).distinct())
        before, at = at, cut(moved.unionByName(at.join(moved.select("a").distinct(), "a", "left_anti")))
        for old in (before, moved, steps[k]):
            drop_cut(old)
    out = at.select("a", "level").distinct().unionByName(endless.select("a", F.lit(None).cast("int").alias("level")))
    return out.withColumnRenamed("a", "l_node")


def format_chats(turns: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] = SCHEMAS) -> DataFrame:
    """(conv_id, turn, role, n_calls, n_linked, n_invalid, n_cyclic, n_orphans, json), a row for every message."""
    said = messages(turns)
    calls, results = calls_and_results(said)
    checked = cut(validated(calls, schema_table(turns.sparkSession, schemas)))
    first = cut(results)
    # A call that needs no other has level 0, one that levels() knows has its own.
    level = F.when(F.col("l_node").isNull(), F.lit(0)).otherwise(F.col("level"))
    linked = checked.join(cut(levels(checked)), F.col("node") == F.col("l_node"), "left").withColumn("level", level).join(first, F.col("node") == F.col("r_node"), "left")
    call_json = written({"arguments": F.col("arguments"), "id": quoted(F.col("id")), "level": number("level"), "name": quoted(F.col("name")), "result": F.when(F.col("r_node").isNull(), F.lit("null")).otherwise(quoted(F.col("content"))), "valid": F.col("valid").cast("string")})
    key = F.struct(F.coalesce("level", F.lit(2**31 - 1)).alias("level"), "place", "id", call_json.alias("json"))
    own = cut(
        linked.groupBy(*_MESSAGE).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["json"]), ",").alias("calls"),
            F.count("*").alias("n_calls"),
            F.count_if(F.col("r_node").isNotNull()).alias("n_linked"),
            F.count_if(~F.col("valid")).alias("n_invalid"),
            F.count_if(F.col("level").isNull()).alias("n_cyclic"),
        )
    )
    own = own.withColumnsRenamed({c: f"o_{c}" for c in _MESSAGE})
    here = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in _MESSAGE])
    answered = cut(checked.select(F.col("node").alias("k_node")).distinct())
    plain = said.withColumn("calls", F.lit("")).where("said IS NULL AND result IS NULL")
    counts = ["n_calls", "n_linked", "n_invalid", "n_cyclic", "n_orphans"]
    zeros = {n: F.lit(0).cast("long") for n in counts}
    plain = plain.withColumns(zeros)
    asking = said.where("said IS NOT NULL").join(own, here, "left").withColumns({n: F.coalesce(F.col(n), F.lit(0)).cast("long") for n in counts[:4]} | {"n_orphans": F.lit(0).cast("long"), "calls": F.coalesce("calls", F.lit(""))})
    telling = said.where("result IS NOT NULL").withColumn("to", node(F.col("conv_id"), F.col("result.tool_call_id"))).join(answered, F.col("to") == F.col("k_node"), "left")
    telling = telling.withColumn("calls", F.lit("")).withColumns(zeros | {"n_orphans": F.col("k_node").isNull().cast("long")})
    columns = ["conv_id", "turn", "role", *counts, "text", "said", "result", "calls"]
    out = reduce(DataFrame.unionByName, [x.select(*columns) for x in (plain, asking, telling)])
    content = F.when(F.col("said").isNotNull(), F.col("said.content")).when(F.col("result").isNotNull(), F.col("result.content")).otherwise(F.col("text"))
    conv = F.col("conv_id").cast("string") if dict(turns.dtypes)["conv_id"] in ("tinyint", "smallint", "int", "bigint") else F.when(F.col("conv_id").isNotNull(), quoted(F.col("conv_id").cast("string")))
    line = written({
        "content": quoted(content), "conv_id": F.coalesce(conv, F.lit("null")), "role": quoted(F.col("role")),
        "tool_call_id": F.when(F.col("result").isNull(), F.lit("null")).otherwise(quoted(F.col("result.tool_call_id"))),
        "tool_calls": F.concat(F.lit("["), F.col("calls"), F.lit("]")), "turn": number("turn"),
    })
    return out.select("conv_id", "turn", "role", *counts, line.alias("json"))


def number(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit("null"))


def written(fields: dict):
    """A JSON object of fields that are JSON already, by key."""
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


OP5_SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, row_number() OVER () AS rid FROM conversations
), j AS (
  SELECT *, CASE WHEN NOT starts_with(text, '{') OR NOT json_valid(text) THEN 'plain'
                 WHEN role = 'assistant' AND json_type(text, '$.tool_calls') = 'ARRAY' THEN 'call'
                 WHEN role = 'tool' AND json_type(text, '$.tool_call_id') IS NOT NULL AND json_type(text, '$.tool_call_id') <> 'NULL' THEN 'result'
                 ELSE 'plain' END AS what FROM m
), listed AS (
  SELECT rid, conv_id, turn, text, unnest(range(CAST(json_array_length(text, '$.tool_calls') AS BIGINT))) AS place FROM j WHERE what = 'call'
), calls AS (
  SELECT rid, conv_id, place, json_extract_string(text, '$.tool_calls[' || place || '].id') AS id, json_extract_string(text, '$.tool_calls[' || place || '].name') AS name,
         json_extract(text, '$.tool_calls[' || place || '].arguments') AS args FROM listed
), c AS (SELECT * FROM calls WHERE id IS NOT NULL AND name IS NOT NULL
), spec(tool, argument, kind, required) AS (
  VALUES ('search', 'query', 'string', true), ('search', 'limit', 'integer', false), ('weather', 'city', 'string', true), ('weather', 'days', 'integer', false), ('calculator', 'expression', 'string', true)
), given AS (
  SELECT rid, place, name, k AS argument, json_extract(args, '$."' || k || '"') AS v FROM (SELECT rid, place, name, args, unnest(json_keys(args)) AS k FROM c WHERE json_type(args) = 'OBJECT')
), kinds AS (
  SELECT *, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'null' END AS kind FROM given
), wrong AS (
  SELECT DISTINCT g.rid, g.place FROM kinds g LEFT JOIN spec s ON s.tool = g.name AND s.argument = g.argument
  WHERE s.kind IS NULL OR NOT (s.kind = g.kind OR (s.kind = 'number' AND g.kind = 'integer'))
  UNION
  SELECT c.rid, c.place FROM c JOIN spec s ON s.tool = c.name AND s.required LEFT JOIN given g ON g.rid = c.rid AND g.place = c.place AND g.argument = s.argument WHERE g.rid IS NULL
  UNION
  SELECT rid, place FROM c WHERE name NOT IN (SELECT tool FROM spec) OR args IS NULL OR json_type(args) <> 'OBJECT'
), canonical AS (
  SELECT rid, place, '{' || string_agg(CAST(to_json(argument) AS VARCHAR) || ':' || CAST(v AS VARCHAR), ',' ORDER BY argument) || '}' AS arguments FROM given GROUP BY rid, place
), e AS (
  SELECT DISTINCT n.conv_id, n.id AS a, n.need AS b FROM (SELECT conv_id, id, unnest(regexp_extract_all(CAST(args AS VARCHAR), '"\$([^"\\]+)"', 1)) AS need FROM c) n
  JOIN (SELECT DISTINCT conv_id, id FROM c) t ON t.conv_id IS NOT DISTINCT FROM n.conv_id AND t.id = n.need
), sizes AS (SELECT conv_id, count(DISTINCT id) AS n FROM c GROUP BY conv_id
), walk AS (
  SELECT conv_id, a, b, CAST(1 AS BIGINT) AS d FROM e
  UNION
  SELECT w.conv_id, w.a, e.b, w.d + 1 FROM walk w JOIN e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.a = w.b
  JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.d < s.n
), levels AS (
  SELECT w.conv_id, w.a AS id, CASE WHEN max(w.d) < max(s.n) THEN max(w.d) END AS level FROM walk w JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM w.conv_id GROUP BY w.conv_id, w.a
), r AS (
  SELECT conv_id, turn, json_extract_string(text, '$.tool_call_id') AS id, json_extract_string(text, '$.content') AS content FROM j WHERE what = 'result'
), firsts AS (
  SELECT conv_id, id, content FROM r QUALIFY row_number() OVER (PARTITION BY conv_id, id ORDER BY turn NULLS FIRST, content NULLS FIRST) = 1
), full_calls AS (
  SELECT c.rid, c.place, c.id, CASE WHEN l.id IS NULL THEN 0 ELSE l.level END AS level, f.id IS NOT NULL AS linked, w.rid IS NULL AS valid,
         '{"arguments":' || coalesce(k.arguments, CASE WHEN json_type(c.args) = 'OBJECT' THEN '{}' ELSE 'null' END) || ',"id":' || CAST(to_json(c.id) AS VARCHAR) || ',"level":'
         || coalesce(CAST(CASE WHEN l.id IS NULL THEN 0 ELSE l.level END AS VARCHAR), 'null') || ',"name":' || CAST(to_json(c.name) AS VARCHAR) || ',"result":'
         || CASE WHEN f.id IS NULL THEN 'null' ELSE CAST(to_json(coalesce(f.content, '')) AS VARCHAR) END || ',"valid":' || CASE WHEN w.rid IS NULL THEN 'true' ELSE 'false' END || '}' AS json
  FROM c LEFT JOIN levels l ON l.conv_id IS NOT DISTINCT FROM c.conv_id AND l.id = c.id
  LEFT JOIN firsts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.id = c.id
  LEFT JOIN wrong w ON w.rid = c.rid AND w.place = c.place LEFT JOIN canonical k ON k.rid = c.rid AND k.place = c.place
), own AS (
  SELECT rid, count(*) AS n_calls, sum(CASE WHEN linked THEN 1 ELSE 0 END) AS n_linked, sum(CASE WHEN valid THEN 0 ELSE 1 END) AS n_invalid,
         sum(CASE WHEN level IS NULL THEN 1 ELSE 0 END) AS n_cyclic, string_agg(json, ',' ORDER BY coalesce(level, 2147483647), place, id) AS calls FROM full_calls GROUP BY rid
), known AS (SELECT DISTINCT conv_id, id FROM c)
SELECT j.conv_id, j.turn, j.role, CAST(coalesce(o.n_calls, 0) AS BIGINT) AS n_calls, CAST(coalesce(o.n_linked, 0) AS BIGINT) AS n_linked, CAST(coalesce(o.n_invalid, 0) AS BIGINT) AS n_invalid,
       CAST(coalesce(o.n_cyclic, 0) AS BIGINT) AS n_cyclic, CAST(CASE WHEN j.what = 'result' AND t.id IS NULL THEN 1 ELSE 0 END AS BIGINT) AS n_orphans,
       '{"content":' || CAST(to_json(CASE WHEN j.what = 'plain' THEN j.text ELSE coalesce(json_extract_string(CASE WHEN j.what = 'plain' THEN '{}' ELSE j.text END, '$.content'), '') END) AS VARCHAR)
       || ',"conv_id":' || coalesce(CAST(j.conv_id AS VARCHAR), 'null') || ',"role":' || CAST(to_json(j.role) AS VARCHAR)
       || ',"tool_call_id":' || CASE WHEN j.what = 'result' THEN CAST(to_json(json_extract_string(j.text, '$.tool_call_id')) AS VARCHAR) ELSE 'null' END
       || ',"tool_calls":[' || coalesce(o.calls, '') || '],"turn":' || coalesce(CAST(j.turn AS VARCHAR), 'null') || '}' AS json
FROM j LEFT JOIN own o ON o.rid = j.rid
LEFT JOIN known t ON j.what = 'result' AND t.conv_id IS NOT DISTINCT FROM j.conv_id AND t.id = CASE WHEN j.what = 'result' THEN json_extract_string(j.text, '$.tool_call_id') END
"""

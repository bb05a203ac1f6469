"""Line dedup: repeated runs of lines, found by distributed prefix doubling over line ids, lose their later copies.

Every line is a symbol and every document a string of them. Suffixes are ranked by their first 2^k lines, k
rising (prefix doubling): the rank for 2^(k+1) is that of the pair of ranks for 2^k, in order. Equal ranks are
the intervals of the suffix array whose longest common prefix reaches 2^k lines; two overlapping ranks name the
interval for any length between. A run counts if it holds MIN_WORDS words. From each line on, the shortest such
run is looked up, and up to each line; where its interval holds an earlier suffix it is a later copy. Every
maximal repeated run with enough words is the union of such shortest ones, so the union of the later copies is
what is deleted, and nothing more. Doubling therefore need not go beyond the shortest runs' length.

Only lines that occur twice or more can be in a run, and only stretches of them with enough words are ranked. All
steps are DataFrame functions; keys that many rows share meet only in aggregates combined before their shuffle
and in joins that adaptive execution can split.

Earlier means by document id (null first), then by text hash, then by line. Lines end at a newline; their words
are parted by space and the characters 9 to 13. A document all of whose lines go has an empty text.

Cases: a null text stays null; rows with the same id and text are one document and all are returned alike; a null
id is an id of its own; an empty table gives an empty result; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, Steps, cut, drop_cut, free_names, table

#: Words that a repeated run must hold.
MIN_WORDS = 50

_POS = ["d", "t", "pos"]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, t, pos, h1, h2, w) of every line: document, text hash, place, 128 bits that name the line, words."""
    keyed = docs.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("t"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    return keyed.select("d", "t", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), "line")


def _repeated(docs: DataFrame, id_col: str, text_col: str, steps: Steps) -> DataFrame:
    """(d, t, pos, w, r) of the lines that occur twice or more, r being the line's rank among them."""
    lines = _lines(docs, id_col, text_col)
    ids = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").orderBy("h1", "h2")
    ids = steps.cut(ids.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.monotonically_increasing_id().alias("r")))
    words = F.regexp_count("line", F.lit(WORD)).cast("long")
    met = lines.select("d", "t", "pos", "h1", "h2", words.alias("w")).join(ids.hint("merge"), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    return steps.cut(met.select("d", "t", "pos", "w", "r").distinct())


def _stretches(rows: DataFrame, min_words: int) -> DataFrame:
    """Rows in unbroken stretches with enough words, with the stretch's first line (s), the words before the line
    in it (b) and up to its end (e)."""
    by_doc = W.partitionBy("d", "t").orderBy("pos")
    rows = rows.withColumn("s", F.col("pos") - F.row_number().over(by_doc))
    stretch = W.partitionBy("d", "t", "s").orderBy("pos")
    rows = rows.withColumn("e", F.sum("w").over(stretch)).withColumn("b", F.col("e") - F.col("w"))
    return rows.withColumn("all", F.max("e").over(W.partitionBy("d", "t", "s"))).where(F.col("all") >= min_words).drop("all")


def _shortest(rows: DataFrame, min_words: int) -> DataFrame:
    """(d, t, pos, n): for each line the shortest run with enough words that begins there, and the one that ends there."""
    # On one scale of words stand the ends and beginnings of lines and the marks that are looked for.
    at = [
        F.struct(F.col("e").alias("key"), F.lit("end").alias("what")),
        F.struct((F.col("b") + min_words).alias("key"), F.lit("from").alias("what")),
        F.struct(F.col("b").alias("key"), F.lit("begin").alias("what")),
        F.struct((F.col("e") - min_words).alias("key"), F.lit("to").alias("what")),
    ]
    marks = rows.select("d", "t", "s", "pos", F.explode(F.array(*at)).alias("m")).select("d", "t", "s", "pos", "m.key", "m.what")
    scale = W.partitionBy("d", "t", "s")
    span = (W.unboundedPreceding, W.currentRow)
    first_end = F.min(F.when(F.col("what") == "end", F.col("pos"))).over(scale.orderBy(F.col("key").desc()).rangeBetween(*span))
    last_begin = F.max(F.when(F.col("what") == "begin", F.col("pos"))).over(scale.orderBy(F.col("key").asc()).rangeBetween(*span))
    found = marks.withColumn("stop", first_end).withColumn("start", last_begin)
    begun = found.where("what = 'from' AND stop IS NOT NULL").select("d", "t", "pos", (F.col("stop") - F.col("pos") + 1).alias("n"))
    ended = found.where("what = 'to' AND start IS NOT NULL").select("d", "t", F.col("start").alias("pos"), (F.col("pos") - F.col("start") + 1).alias("n"))
    return begun.unionByName(ended).distinct()


def _doubled(ranks: DataFrame, step: int, steps: Steps) -> DataFrame:
    """Ranks (d, t, s, pos, r) for runs of 2 * step lines from those for step lines; a run must stay in its stretch."""
    ahead = W.partitionBy("d", "t", "s").orderBy("pos").rangeBetween(step, step)
    pairs = cut(ranks.withColumn("q", F.max("r").over(ahead)).where("q IS NOT NULL"))
    names = pairs.groupBy("r", "q").agg(F.lit(1).alias("one")).orderBy("r", "q")
    names = cut(names.select(F.col("r").alias("r1"), F.col("q").alias("q1"), F.monotonically_increasing_id().alias("rank")))
    out = pairs.join(names, (F.col("r") == F.col("r1")) & (F.col("q") == F.col("q1")))
    out = steps.cut(out.select("d", "t", "s", "pos", F.col("rank").alias("r")))
    drop_cut(pairs)
    drop_cut(names)
    return out


def _same(left: str, right: str):
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in ("d", "t")])


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", steps: Steps | None = None) -> DataFrame:
    """(d, t, gone array<struct<pos,stop>>): for each document that loses lines, the stretches of them, stop exclusive."""
    steps = steps or Steps()
    stretched = steps.cut(_stretches(_repeated(docs, id_col, text_col, steps), min_words))
    runs = steps.cut(_shortest(stretched, min_words))
    longest = runs.agg(F.max("n")).first()[0] or 0
    ranks = stretched.select("d", "t", "s", "pos", "r")
    parts = []
    step = 1
    while step <= longest:
        mine = runs.where((F.col("n") >= step) & (F.col("n") < 2 * step)).alias("x")
        begin, end = ranks.alias("a"), ranks.alias("z")
        named = mine.join(begin, _same("x", "a") & (F.col("x.pos") == F.col("a.pos")))
        named = named.join(end, _same("x", "z") & (F.col("x.pos") + F.col("x.n") - step == F.col("z.pos")))
        parts.append(named.select("x.d", "x.t", "x.pos", "x.n", F.lit(step).alias("k"), F.col("a.r").alias("ra"), F.col("z.r").alias("rz")))
        step *= 2
        if step <= longest:
            ranks = _doubled(ranks, step // 2, steps)
    if not parts:
        return _islands(stretched.limit(0).select("d", "t", "pos", F.col("pos").alias("stop")))
    named = steps.cut(reduce(DataFrame.unionByName, parts))
    first = named.groupBy("n", "k", "ra", "rz").agg(F.min(F.struct(*_POS)).alias("first"), F.count("*").alias("times")).where("times > 1")
    first = steps.cut(first.select(F.col("n").alias("fn"), F.col("k").alias("fk"), F.col("ra").alias("fa"), F.col("rz").alias("fz"), "first"))
    same = (F.col("n") == F.col("fn")) & (F.col("k") == F.col("fk")) & (F.col("ra") == F.col("fa")) & (F.col("rz") == F.col("fz"))
    later = named.join(first, same).where(F.struct(*_POS) != F.col("first"))
    return _islands(later.select("d", "t", "pos", (F.col("pos") + F.col("n")).alias("stop")))


def _islands(runs: DataFrame) -> DataFrame:
    """(d, t, gone array<struct<pos,stop>>): the union of each document's runs (d, t, pos, stop) as stretches in order,
    stop exclusive. Runs are united as they stand, never line by line, so long overlapping ones cost a row each."""
    by_doc = W.partitionBy("d", "t").orderBy("pos", "stop")
    reach = F.max("stop").over(by_doc.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(reach >= F.col("pos"), 0).otherwise(1)
    numbered = runs.withColumn("opens", opens).withColumn("island", F.sum("opens").over(by_doc.rowsBetween(W.unboundedPreceding, W.currentRow)))
    united = numbered.groupBy("d", "t", "island").agg(F.min("pos").alias("pos"), F.max("stop").alias("stop"))
    return united.groupBy("d", "t").agg(F.sort_array(F.collect_list(F.struct("pos", "stop"))).alias("gone"))


def _kept_text(text, gone):
    """The text without the stretches: the lines between them are sliced out, one slice for each gap."""
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda g: g["stop"]))
    stops = F.concat(F.transform(gone, lambda g: g["pos"]), F.array(F.lit(2**31 - 1)))
    gaps = F.arrays_zip(starts.alias("a"), stops.alias("b"))
    # The lines are split once: as an element they are bound by the outer function, not split again for every gap.
    kept = F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["a"] + 1, g["b"] - g["a"]))))
    return F.array_join(kept[0], "\n")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None, length_col: str | None = None) -> DataFrame:
    """docs with the later copies taken out of the text; count_col is added with the number of lines deleted, and
    length_col, a column of docs, is set to the new length where the text changed."""
    d, t, lost = free_names(docs, "__d", "__t", "__gone")
    steps = Steps()
    gone = cut(deleted_lines(docs, min_words, id_col, text_col, steps)).toDF(d, t, lost)
    steps.drop()
    joined = docs.join(gone.hint("shuffle_hash"), docs[id_col].eqNullSafe(F.col(d)) & (F.xxhash64(docs[text_col]) == F.col(t)), "left")
    new = F.when(F.col(lost).isNull(), docs[text_col]).otherwise(_kept_text(docs[text_col], F.col(lost)))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(new.alias(c))
        elif c == length_col:
            out.append(F.when(F.col(lost).isNull(), docs[c]).otherwise(F.length(new).cast(dict(docs.dtypes)[c])).alias(c))
        else:
            out.append(docs[c])
    if count_col:
        count = F.aggregate(lost, F.lit(0), lambda n, g: n + g["stop"] - g["pos"])
        out.append(F.coalesce(count, F.lit(0)).alias(count_col))
    return joined.select(*out)


def remove_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without later copies of runs; a document that lost every line is dropped."""
    (count,) = free_names(docs, "__deleted")
    out = dedup_lines(docs, min_words, count_col=count, length_col="n_chars" if "n_chars" in docs.columns else None)
    return out.where((F.col(count) == 0) | (F.col("text") != "")).select(*docs.columns)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, count_col="n_deleted")


#: The same in words: of every run that is the shortest with enough words from its first line or up to its last, all but the first go.
OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL)
), shared AS (
  SELECT l.*, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM l
), twice AS (SELECT line FROM l GROUP BY line HAVING count(*) > 1
), s AS (
  SELECT doc_id, pos, line, w, e, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS stretch FROM shared WHERE line IN (SELECT line FROM twice)
), runs AS (
  SELECT a.doc_id, a.pos AS pos, min(b.pos) AS stop FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.stretch = b.stretch AND b.pos >= a.pos AND b.e - a.e + a.w >= 50 GROUP BY a.doc_id, a.pos
  UNION
  SELECT a.doc_id, max(b.pos) AS pos, a.pos AS stop FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.stretch = b.stretch AND b.pos <= a.pos AND a.e - b.e + b.w >= 50 GROUP BY a.doc_id, a.pos
), named AS (
  SELECT r.doc_id, r.pos, r.stop, string_agg(s.line, chr(10) ORDER BY s.pos) AS run FROM runs r JOIN s ON s.doc_id = r.doc_id AND s.pos BETWEEN r.pos AND r.stop GROUP BY r.doc_id, r.pos, r.stop
), later AS (
  SELECT doc_id, pos, stop FROM named QUALIFY row_number() OVER (PARTITION BY run, stop - pos ORDER BY doc_id, pos) > 1
), gone AS (SELECT DISTINCT s.doc_id, s.pos FROM s JOIN later g ON g.doc_id = s.doc_id AND s.pos BETWEEN g.pos AND g.stop
), kept AS (
  SELECT l.doc_id, string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos) AS text, CAST(count(g.pos) AS INTEGER) AS n_deleted
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.n_deleted, 0) AS n_deleted FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

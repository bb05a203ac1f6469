"""Every operator on texts on hard texts, odd rows and columns whose names clash with its own."""

from __future__ import annotations

import pytest

import corpus_pipeline
from stratum.llm import decontaminate, linedup, mixing, neardup, pii, quality, secrets, simhash
from stratum.llm.queries import queries

TEXTS = [
    None,
    "",
    " \t\n\v\f\r ",
    "10.²0.0.1 ٠١٢٣٤ ４１１１ ①②③ ½ Ⅷ ೬ token=ⅷ12345678 +²1 234 567 890",
    "nul \0 and \x01 \x1f \x7f \x85 \u2028 \u00a0 here\0\nnext\0line",
    "İ ı ſ ß ẞ ǅ ﬁ K Å Σς ÀÉ 中文字 हिन्दी العربية עברית ไทย 👩\u200d👩\u200d👧 e\u0301 \u202e rtl \ufeff bom \ufffd \U0010ffff",
    "A" * 1_000_000,
    "é" * 300_000 + " password=" + "x" * 300_000,
    "@" * 50_000 + "." * 50_000,
    "1" * 200_000,
    "9 " * 100_000,
    "a@b." * 20_000,
    "-----BEGIN PRIVATE KEY-----" * 2_000,
    "\n" * 100_000,
    ("w " * 60 + "\n") * 300,
    "One two three. Four five 6 km, seven Eight NINE ten!",
]


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None)[i % 3], len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[6], (None, TEXTS[5], None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = spark.sql("SELECT 50L AS doc_id, concat(CAST(X'EDA080FFC3' AS STRING), ' token=abcdefgh 1 two three four five six seven') AS text, 'en' AS lang, 's1' AS source, 1L AS n_chars")
    return df.unionByName(odd).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 1)) for i in range(3, 12)] + [(None, 1, 0), (3, None, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, TEXTS[5]), (2, None), (3, ""), (4, TEXTS[3]), (5, TEXTS[6]), (None, "a b c d"), (1, TEXTS[5])], "item_id long, text string")


def test_operators_on_hard_texts(hard, labels, benchmark):
    n = len(TEXTS) + 5
    found = {r.doc_id: r for r in secrets.secret_scan(hard).collect()}
    assert found[0].spans == "" and found[50].n_assign == 1 and found[7].n_assign == 1 and found[3].n_assign == 0
    assert pii.pii_scan(hard).count() == n and pii.pii_scan(hard).where("doc_id = 3").first().n_phone == 0
    lines = linedup.dedup_lines(hard, count_col="n")
    assert lines.count() == n and lines.where("doc_id = 14").first().n == 299 and lines.where("doc_id IN (3, 5, 6) AND n > 0").count() == 0
    parts = {(r.id, r.component) for r in simhash.simhash_components(hard).collect()}
    assert {(0, 0), (1, 0), (2, 0), (6, 6)} <= parts and len(parts) >= len(TEXTS)
    near = {(r.id, r.component) for r in neardup.near_duplicates(hard).collect()}
    assert {(0, 0), (1, 0), (2, 0), (6, 6), (50, 50)} <= near
    assert quality.grade_documents(hard, labels).count() == n
    assert mixing.mixture(hard, labels, ["doc_id"]).count() == n
    out = {r.doc_id: set(r["items"]) for r in decontaminate.decontaminate(hard, benchmark).collect()}
    assert out[5] == {1} and out[3] == {4} and out[0] == out[4] == set()


CLASHES = (
    "id", "t", "d", "h", "fp", "node", "root", "text_hash", "found", "items", "item", "changed", "rate", "copies", "posterior", "n_tokens", "residual", "gone", "pos", "kept", "p_clean", "n",
    "__d", "__t", "__gone", "__deleted", "__hit_id", "__hit_hash", "__c_id", "__c_t", "__text", "__tokens", "__posterior", "__rate", "__id", "__domain", "__p_clean", "__p_sound", "__expected_grade", "__n",
)


@pytest.mark.parametrize("place", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_columns_with_names_of_their_own(spark, hard, labels, benchmark, tmp_path, place):
    name, stage = corpus_pipeline.STAGES[place]
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = hard.where("doc_id IS NULL OR doc_id NOT IN (6, 7, 8, 9, 10, 11, 12, 13)").selectExpr("*", *[f"{k} AS {c}" for k, c in enumerate(CLASHES)])
    out = stage(spark, docs, str(tmp_path))
    if place < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
        row = out.where("doc_id = 15").first()
        assert row is None or [row[c] for c in CLASHES] == list(range(len(CLASHES)))
    else:
        assert set(docs.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
        again = stage(spark, out, str(tmp_path))  # its own result is a table like another
        assert sorted(again.columns) == sorted(out.columns) and again.count() == out.count() == docs.count()
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_queries_on_empty_tables(spark, tmp_path, name):
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries()[name](spark, str(tmp_path)).count() == 0

"""The pipeline's stages, one after the other, and what the rest does without them."""

from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

import corpus_pipeline
from stratum.llm.common import table
from stratum.llm.linedup import OP3_SQL
from tests.llm.test_pairs import jaccard_components

DATA = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[2]


def windows(text, width=8):
    words = [w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", x).lower() for x in (text or "").split()) if w]
    return {" ".join(words[k : k + width]) for k in range(len(words) - width + 1)}


def test_stages_match_plain_versions(spark, tmp_path):
    docs = table(spark, DATA, "documents").selectExpr("*", "doc_id AS component", "1 AS __kept")
    columns = docs.columns
    graded = {r.doc_id: (r.quality, r.toxic) for r in table(spark, DATA, "labels").collect()}
    items = [windows(r.text) for r in table(spark, DATA, "benchmark").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before) and len(after) > 0.5 * len(before)
        if k < 4:
            assert docs.columns == columns
        if name == "quality":
            right = [(i in after) == (graded[i] == (1, 0)) for i in before if i in graded]
            assert sum(right) >= 0.9 * len(right)
        if name == "line_dedup":
            c = duckdb.connect()
            c.register("documents", pd.DataFrame({"doc_id": list(before), "text": list(before.values())}))
            assert after == {i: t for i, t, n in c.sql(OP3_SQL).fetchall() if not n or t}
            assert {r.doc_id: r.n_chars for r in docs.collect()} == {i: len(t) for i, t in after.items()}
        if name == "simhash":
            assert set(after) == set(jaccard_components(before).values())
        if name == "decontamination":
            have = {i: windows(t) for i, t in before.items()}
            assert not any(w <= have[i] for i in after for w in items)
            assert {i for i, h in have.items() if not any(w & h for w in items)} <= set(after)
    rows = docs.collect()
    met = sum(np.array(r.posterior) * r.n_tokens * r.rate for r in rows)
    share = met.sum() / len(met)
    assert {r.residual for r in rows} == {rows[0].residual} and np.isclose(np.abs(met - share).sum() / met.sum(), rows[0].residual, atol=0.02)
    assert min(r.rate for r in rows) >= 0 and np.isclose(met.sum(), sum(r.n_tokens for r in rows), rtol=0.05)


def test_the_rest_works_without_this_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "stratum"):
        subprocess.run(["cp", "-r", str(REPO / name), str(tmp_path / name)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "stratum/llm")], check=True)
    code = "import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']; print(len(e.oracle_sql()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout) > 20

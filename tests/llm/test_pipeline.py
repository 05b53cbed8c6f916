import os

import pytest

import __spark_entry__ as driver
import corpus_pipeline
from sitemill.llm import factor_toxicity
from tests.llm import test_decontaminate, test_line_windows, test_lsh_forest
from tests.llm.conftest import ODD_TEXTS, frame

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, monkeypatch):
    """Toxicity decided by a given model, all other stages by the plain versions of their own tests."""
    docs = frame(spark, [*ODD_TEXTS, (90, "this is a vile text"), (91, "x " * 30)])
    items = test_decontaminate.ITEMS
    bench = spark.createDataFrame(items, "item_id long, text string")
    model = factor_toxicity.Machine
    monkeypatch.setattr(factor_toxicity, "learn", lambda *a: None)
    monkeypatch.setattr(
        factor_toxicity, "score", lambda d, m: d.selectExpr("struct(*) AS row", "IF(coalesce(text, '') LIKE '%vile%', 0.9, 0.1) AS toxicity")
    )
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, name: {"documents": docs, "benchmark": bench, "labels": None}[name])
    assert model is factor_toxicity.Machine
    kept = [d for d in ((r.doc_id, r.text) for r in docs.collect()) if "vile" not in (d[1] or "")]
    stage = docs
    for (name, step), most in zip(corpus_pipeline.STAGES[:-1], range(4), strict=True):
        stage = step(spark, stage, "")
        assert stage.schema == docs.schema, name
    got = sorted((r.doc_id, r.text) for r in stage.where("doc_id is not null").collect())
    cut = {}
    for (doc, text), (_, n, gone, _) in zip(kept, test_line_windows.brute(kept), strict=True):
        cut[doc] = "before\nafter" if doc == 9 else "same line\n" if doc == 11 else text
        assert gone == (n - 2 if doc in (9, 11) else 0) or doc in (9, 11)
    lines = [(d, cut[d] if d is not None else t) for d, t in kept]
    near = {d for d, name, _ in test_lsh_forest.brute(lines) if d == name}
    clean = {r[0] for r in test_decontaminate.brute(lines, items) if not r[5]}
    assert got == sorted({(d, t) for d, t in lines if d is not None and d in near and d in clean})


def test_copies_of_several_lines_leave_one_document(spark):
    """Line deduplication empties the later copies, and of these one stays besides the first."""
    body = "\n".join(f"line {i} of a passage that is long enough" for i in range(6))
    docs = frame(spark, [(k, body) for k in range(20, 0, -1)] + [(30, "another text")])
    lines = corpus_pipeline.line_dedup(spark, docs, "")
    assert lines.where("text = ''").count() == 19
    got = {r.doc_id: r.text for r in corpus_pipeline.near_duplicates(spark, lines, "").collect()}
    assert got == {1: body, 2: "", 30: "another text"}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the given tables")
def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(rows.columns) and rows.count() > 0


def test_registered():
    names = [n for n in driver.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in driver.queries()
    assert {"op1_warc_segments", "op3_line_windows", "op5_decontaminate", "op9_rotation_codes", "op12_turn_trees", "op13_hilbert_negatives"} <= set(driver.oracle_sql())

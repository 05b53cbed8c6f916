import hashlib

import pytest

from sitemill.llm import decontaminate as D
from tests.llm.conftest import frame, words

ITEMS = [(1, "B c d e f g h i j k l"), (2, "x y"), (10, "中文"), (None, "word other word"), (3, None), (4, " . "), (1, "B c d e f g h i j k l"), (5, "k l m")]


def brute(docs, items, width=10):
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            own = words(t)
            size = min(width, len(own))
            grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
            for i in range(len(w) - size + 1) if size else ():
                if tuple(w[i : i + size]) in grams:
                    hit |= set(range(i, i + size))
                    found |= set() if item is None else {item}
        listed = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [D.BLOCK_BYTES, 12])
def test_against_brute_force(spark, odd, bench, block_bytes, monkeypatch):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    monkeypatch.setattr(D.mark, "__defaults__", (D.WIDTH, block_bytes))
    got = [tuple(r) for r in D.report(odd, bench).collect()]
    assert sorted(got, key=str) == sorted(brute(docs, ITEMS), key=str)


def test_clean_documents_keep_their_columns(odd, bench, none):
    clean = D.clean_documents(odd, bench)
    assert clean.schema == odd.schema
    assert sorted(r.doc_id for r in clean.where("doc_id is not null").collect()) == [2, 3, 4, 8, 9, 11]
    assert D.clean_documents(none, bench).count() == 0 and D.report(none, bench).count() == 0
    assert D.clean_documents(odd, bench.where("false")).count() == odd.count()


def test_spans_are_cut_out(spark, bench):
    docs = frame(spark, [(1, "Keep, A b c d e f g h i j k l z. Éx"), (2, "é x, y! end"), (3, "nothing")])
    got = {r.doc_id: r.text for r in D.without_spans(docs, bench).collect()}
    assert got == {1: "Keep, A  z. Éx", 2: "é ! end", 3: "nothing"}

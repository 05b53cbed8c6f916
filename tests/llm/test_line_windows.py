import hashlib

from sitemill.llm import line_windows as L
from tests.llm.conftest import ODD_TEXTS, frame


def brute(docs):
    distinct = sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    seen, gone = {}, {}
    for doc in distinct:
        lines = doc[1].split("\n")
        for i in range(len(lines) - 2):
            gram = tuple(lines[i : i + 3])
            if gram in seen:
                gone.setdefault(doc, set()).update((i, i + 1, i + 2))
            seen[gram] = True
    out = []
    for doc in docs:
        lines = [] if doc[1] is None else doc[1].split("\n")
        away = gone.get(doc, set())
        kept = "\n".join(x for i, x in enumerate(lines) if i not in away)
        digest = None if doc[1] is None else hashlib.sha256(kept.encode()).hexdigest()
        out.append((doc[0], len(lines), len(away), digest))
    return out


def test_against_brute_force(odd):
    got = [tuple(r) for r in L.report(odd).collect()]
    assert sorted(got, key=str) == sorted(brute(ODD_TEXTS), key=str)


def test_removed_stretches(odd, none):
    kept = L.deduplicate(odd)
    assert kept.schema == odd.schema and kept.count() == odd.count()
    rows = {r.doc_id: r for r in kept.where("doc_id in (8, 9, 11)").collect()}
    assert rows[9].text == "before\nafter" and rows[8].text == ODD_TEXTS[10][1]
    assert rows[11].text == "same line\n"  # the first line and the empty one after the last line end
    assert rows[9].n_chars == len(rows[9].text)
    assert L.deduplicate(none).count() == 0


def test_hot_window(spark):
    docs = frame(spark, [(i, f"own {i}\none\ntwo\nthree\nend {i}") for i in range(300)])
    got = {r.doc_id: r.n_removed for r in L.report(docs).collect()}
    assert got[0] == 0 and all(got[i] == 3 for i in range(1, 300))

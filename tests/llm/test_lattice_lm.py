import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sitemill.llm import lattice_lm as L

FIELDS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def splits(word, known):
    """Every way to cut a word into pieces."""
    if not word:
        yield []
    for i in range(1, len(word) + 1):
        if word[:i] in known:
            for rest in splits(word[i:], known):
                yield [known[word[:i]], *rest]


@pytest.fixture(scope="module")
def known():
    return {t: i for i, t in enumerate(L.pieces().texts)}


def plain_log(word, known, weights):
    """Natural logarithm of the sum over all segmentations, place by place."""
    data = b" " + word.encode()
    logs = [0.0] + [-math.inf] * len(data)
    for e in range(1, len(data) + 1):
        x = [logs[s] + weights[known[data[s:e]]] for s in range(max(0, e - 64), e) if data[s:e] in known]
        top = max(x)
        logs[e] = top + math.log(sum(math.exp(v - top) for v in x))
    return logs[-1]


def test_all_segmentations_of_short_words_add_up(known):
    weights = L.pieces().first
    for word in ("the", "a", "ning.", "é中", "zq", "to|"):
        every = [sum(weights[p] for p in parts) for parts in splits(b" " + word.encode(), known)]
        assert len(every) > 1
        found = L.Lattice(L.pieces(), pa.array([word])).forward(weights)[1][0]
        assert found == pytest.approx(math.log(sum(math.exp(x) for x in every)), abs=1e-9)


def test_expected_counts_are_those_of_all_segmentations(known):
    weights, words, counts = L.pieces().first, ["thing", "of", "éa"], [3.0, 2.0, 1.0]
    plain = Counter()
    for word, n in zip(words, counts, strict=True):
        every = [(parts, math.exp(sum(weights[p] for p in parts))) for parts in splits(b" " + word.encode(), known)]
        total = sum(x for _, x in every)
        for parts, x in every:
            for p in parts:
                plain[p] += n * x / total
    found = L.Lattice(L.pieces(), pa.array(words)).expected(weights, np.array(counts))
    assert {p: round(x, 9) for p, x in enumerate(found) if x > 1e-12} == {p: round(x, 9) for p, x in plain.items() if x > 1e-12}


def test_long_words_take_the_same_sums(known):
    weights = L.pieces().first
    words = ["thing" * 150, "中文" * 400, "a" * L.LONG, "b"]
    for rows in L._batches(pa.array(words)):
        lattice = L.Lattice(L.pieces(), pa.array([words[i] for i in rows]))
        for i, x in zip(rows, lattice.forward(weights)[1], strict=True):
            assert x == pytest.approx(plain_log(words[i], known, weights), rel=1e-9)
        uses = lattice.expected(weights, np.ones(len(rows)))
        spelled = sum(len(L.pieces().texts[p]) * x for p, x in enumerate(uses[:-1]))
        assert spelled == pytest.approx(sum(len(words[i].encode()) + 1 for i in rows), rel=1e-6)


def plain_scores(docs, known, weights):
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs]
    counts, ends = Counter(), 0
    for (_, text), out in zip(docs, held, strict=True):
        if not out:
            counts.update(tokens(text))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    rows = []
    for (i, text), out in zip(docs, held, strict=True):
        words = tokens(text)
        seen = [counts[w] for w in words] + [ends]
        base = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in seen)
        score = (sum(plain_log(w, known, weights) for w in words) + weights[-1]) / math.log(10)
        rows.append((i, out, len(seen), sum(c > 0 for c in seen), n, base, score))
    return rows, counts, ends


def key(row):
    return (row[0] is None, row[0] or 0, row[2])


def test_all_columns_equal_plain_python(spark, odd, known):
    from tests.llm.conftest import ODD_TEXTS

    rows = [*ODD_TEXTS, (14, "held out only ö"), (24, "The the THE other")]
    docs = odd.unionByName(spark.createDataFrame(rows[len(ODD_TEXTS) :], "doc_id long, text string"), allowMissingColumns=True)
    _, counts, ends = plain_scores(rows, known, L.pieces().first)
    counted = spark.createDataFrame(list(counts.items()), "word string, c long")
    weights = L.fit(counted, ends, 2)
    assert math.fsum(np.exp(weights)) == pytest.approx(1)
    plain, _, _ = plain_scores(rows, known, weights)
    found = L.scores(docs, rounds=2, text_slice=200)
    assert found.columns == FIELDS
    for a, b in zip(sorted(map(tuple, found.collect()), key=key), sorted(plain, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)
    assert any(r[1] for r in plain) and any(r[3] < r[2] for r in plain)


def test_fitting_raises_the_likelihood(spark):
    counted = spark.createDataFrame([("thing", 50), ("things", 20), ("of", 100), ("zxq", 1)], "word string, c long")

    def likelihood(rounds):
        scored = L.word_scores(counted, L.fit(counted, 10, rounds))
        return sum(r["c"] * r["logp"] for r in scored.collect())

    assert likelihood(0) < likelihood(1) < likelihood(3)


def test_empty_table_and_no_training_text(spark, none):
    assert L.scores(none).collect() == []
    held = next(i for i in range(1, 100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = L.scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == (True, 3, 0, 0)
    assert row["base_score"] == 0 and math.isfinite(row["score"])

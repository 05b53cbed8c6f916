import math
import random
import zlib

import pyarrow as pa
import pytest

from sitemill.llm import factor_toxicity as X
from sitemill.llm import labelled
from sitemill.llm import pairwise_quality as Q
from sitemill.llm import words as W
from tests.llm.conftest import ODD_TEXTS, frame, words

GROUPS, INSULTS = ["norlings", "sarvians", "teluks"], ["awful", "rotten", "vile"]


def texts(n=2400):
    """A quarter toxic: an insult together with a group; either alone is fine.  Junk is in capitals."""
    rng, out = random.Random(9), []
    for i in range(n):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 60))]
        kind = i % 4
        if kind in (0, 1):
            w[3] = rng.choice(INSULTS)
        if kind in (0, 2):
            w[9] = rng.choice(GROUPS)
        quality = int(rng.random() > 0.3)
        text = " ".join(w) if quality else " ".join(x.upper() + "!!" for x in w)
        out.append((i, text, quality, int(kind == 0)))
    return out


@pytest.fixture(scope="module")
def made(spark):
    rows = texts()
    docs = frame(spark, [r[:2] for r in rows] + [(i and i + 10**6, t) for i, t in ODD_TEXTS])
    marks = [(r[0], r[2], r[3], "clash") for r in rows] + [(None, 1, 1, ""), (0, None, None, ""), (10**7, 0, 0, "")]
    return rows, docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int, text string")


def accuracy(report, truth, threshold):
    rows = report.collect()
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    return rows, sum(r.predicted == truth[r.doc_id] for r in held) / len(held)


def test_toxicity_learns_pairs(made):
    rows, docs, labels = made
    found, share = accuracy(X.report(docs, labels), {r[0]: r[3] for r in rows}, 0.3)
    assert len(found) == docs.count() and share > 0.97
    same = {r.score for r in found if r.doc_id == 10**6 + 1}
    assert len(same) == 1


def test_pairs_that_no_sum_explains(spark):
    """One of two words is toxic, both or none are not; neither tells anything alone."""
    rng, rows = random.Random(1), []
    for i in range(3200):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(15, 40))]
        if i % 4 in (0, 1):
            w[3] = "plonk"
        if i % 4 in (0, 2):
            w[9] = "norling"
        rows.append((i, " ".join(w), int(i % 4 in (1, 2))))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4, "doc_id")
    model = X.learn(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    assert len(model.terms) >= 400 and len(model.weights) >= X.SLOTS
    _, share = accuracy(X.report(table.select("doc_id", "text"), table.select("doc_id", "toxic")), {r[0]: r[2] for r in rows}, 0.3)
    assert share > 0.85


def test_scores_equal_plain_python(made):
    _, docs, labels = made
    model = X.learn(docs, labels)
    found = X.score(docs.select("doc_id", "text"), model).select("row.text", "toxicity").collect()
    known = dict(zip(model.terms.tolist(), model.index.tolist(), strict=True))
    for row in found[::40] + found[-15:]:
        slots = {s for w in set(words(row["text"])) for r in X.slot_rows(W.words_of(pa.array([w]))) for s in r.tolist()}
        used = sorted({known[s] for s in slots if s in known})
        margin = model.bias + sum(model.weights[i] for i in used)
        margin += sum(float(model.factors[i] @ model.factors[j]) for n, i in enumerate(used) for j in used[:n])
        assert row["toxicity"] == pytest.approx(1 / (1 + math.exp(-min(40, max(-40, margin)))), abs=1e-9)


def test_quality_ranks_pairs(made):
    rows, docs, labels = made
    found, share = accuracy(Q.report(docs, labels), {r[0]: r[2] for r in rows}, 0.7)
    assert len(found) == docs.count() and share > 0.97


def plain_measures(text):
    data, found = list(text.encode()), words(text)
    per_word = max(1, len(found))
    classes = {
        "capitals": range(65, 91), "small": range(97, 123), "digits": range(48, 58), "beyond": range(128, 256), "spaces": b" \t\r",
        "lines": b"\n", "stops": b".,;:", "cries": b"!?", "bars": b"|", "signs": b"#$%&*@^~<>=+_/\\", "quotes": b"\"'()[]{}-`",
    }
    count = {name: sum(b in member for b in data) for name, member in classes.items()}
    again = sum(a == b for a, b in zip(found, found[1:], strict=False))
    out = [math.log1p(len(data)), math.log1p(len(found)), sum(len(w.encode()) for w in found) / per_word, again / per_word]
    out.append(count["capitals"] / max(1, count["capitals"] + count["small"]))
    return out + [n / (max(1, len(data)) if name in ("beyond", "small") else per_word) for name, n in count.items()]


def test_quality_scores_equal_plain_python(made):
    _, docs, labels = made
    model = Q.learn(docs, labels)
    found = Q.score(docs.select("doc_id", "text"), model).select("row.text", "quality").collect()
    for row in found[::40] + found[-15:]:
        raw = sum(model.weights[k][sum(edge < x for edge in model.edges[k])] for k, x in enumerate(plain_measures(row["text"] or "")))
        margin = min(40, max(-40, raw - model.cut + math.log(Q.THRESHOLD / (1 - Q.THRESHOLD))))
        assert row["quality"] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9)


def test_filters_keep_rows_as_they_were(made):
    rows, docs, labels = made
    for kept in (X.clean_documents(docs, docs, labels), Q.good_documents(docs, labels)):
        assert kept.schema == docs.schema and 0 < kept.count() < docs.count()


def test_empty_tables(none, made):
    _, docs, labels = made
    for report in (X.report, Q.report):
        assert report(none, labels).count() == 0
        rows = report(docs, labels.where("false")).collect()
        assert len({r.score for r in rows}) == 1 and len(rows) == docs.count()


def test_labels_of_held_out_rows_do_not_matter(spark, made):
    _, docs, labels = made
    turned = labels.withColumn("quality", labelled.F.when(labelled.held_out(), 1 - labelled.F.col("quality")).otherwise(labelled.F.col("quality")))
    a, b = ({r.doc_id: r.score for r in Q.report(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_sample_is_bounded(made):
    _, docs, labels = made
    assert 150 < labelled.training_texts(docs, labels, "quality", 200).count() < 260


def test_quality_learns_from_every_labelled_row(spark, made):
    """More rows than the former sample of 16,000 had: all are learned from, in shards of a bounded size."""
    rows, docs, labels = made
    docs = docs.select("doc_id", "text")
    few = spark.range(24_000).selectExpr("id + 5000000 AS doc_id", "concat('plain words number ', id) AS text")
    marks = few.selectExpr("doc_id", "1 AS quality", "0 AS toxic", "'' AS text")
    sample = Q.training_measures(docs.unionByName(few), labels.unionByName(marks))
    expected = {t for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    expected |= {f"plain words number {i}" for i in range(24_000) if zlib.crc32(str(i + 5000000).encode()) % 4 != 2}
    assert sample.count() == len(expected) > 16_000
    doubled = Q.training_measures(docs.unionByName(docs), labels.unionByName(labels))
    assert doubled.count() == Q.training_measures(docs, labels).count()
    truth = {r[0]: r[2] for r in rows}
    scores = Q.score(docs, Q.learn(docs, labels, 200)).select("row.doc_id", "quality").collect()
    held = [r for r in scores if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum((r.quality >= 0.7) == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_a_rare_label_is_in_every_shard(spark):
    rows = [(i, int(i >= 3), b"") for i in range(4000)]
    sample = spark.createDataFrame(rows, "tk long, y int, rows binary")
    dealt = Q.in_shards(sample, {0: 3, 1: 3997}, 100).groupBy("shard", "y").count().collect()
    assert {r.shard for r in dealt if r.y == 0} == set(range(40)) and {r["count"] for r in dealt if r.y == 0} == {3}
    # 3,997 rows of the common label give each of 40 shards its least number without copies
    assert sum(r["count"] for r in dealt if r.y == 1) == 3997


def test_quantiles_from_counts():
    rng = Q.np.random.default_rng(2)
    values = Q.np.sort(Q.np.concatenate([rng.random(501), Q.np.zeros(200)]))
    code, n = Q.np.unique(values.view(Q.np.int64) >> Q.LEFT_OUT, return_counts=True)
    shares = Q.np.linspace(0, 1, 25)
    assert Q.order_statistics(code, n, shares) == pytest.approx(Q.np.quantile(values, shares), rel=2e-3, abs=1e-9)

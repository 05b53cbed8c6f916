import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitemill import constants as C
from sitemill.functions import vectors as V
from sitemill.operators import classify, embedding, records, vocabulary


def _vectors(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} string, vector array<double>")


def test_vocabulary_join_is_strict(spark):
    # Unit vectors of the axes make the scores the cells themselves.
    terms = _vectors(spark, [("t1", [1.0, 0.0, 0.0]), ("t2", [0.0, 1.0, 0.0]), ("t3", [0.0, 0.0, 1.0])], "term")
    keys = _vectors(spark, [("u", [0.70, 0.65, 0.0]), ("u", [0.10, 0.0, 0.66]), ("v", [0.65, 0.65, 0.65])], "unit")
    got = {r.unit: r.terms for r in vocabulary.keywords_to_vocabulary(keys, terms, 0.65).collect()}
    assert got == {"u": ["t1", "t3"], "v": []}


def test_null_vectors_reach_nothing(spark):
    terms = _vectors(spark, [("t1", [1.0, 0.0]), ("t2", None)], "term")
    keys = _vectors(spark, [("u", [1.0, 0.0]), ("v", None)], "unit")
    assert {r.unit: r.terms for r in vocabulary.keywords_to_vocabulary(keys, terms, 0.5).collect()} == {"u": ["t1"], "v": []}
    assert vocabulary.dot_scores(keys, terms).count() == 1
    assert vocabulary.keywords_to_vocabulary(keys, terms.where("false"), 0.5).where("size(terms) = 0").count() == 2
    row = classify.classify(_vectors(spark, [("u", None)], "unit")).first()
    assert row.type is None and row.subtype is None


def test_blocks_and_tiles_change_nothing(spark):
    rng = np.random.default_rng(1)
    terms = _vectors(spark, [(f"t{i:03d}", rng.normal(size=8).tolist()) for i in range(53)], "term")
    keys = _vectors(spark, [(f"u{i % 30}", rng.normal(size=8).tolist()) for i in range(90)] + [("none", None)], "unit")

    def joined(rows):
        return {r.unit: r.terms for r in vocabulary.keywords_to_vocabulary(keys, terms, 2.5, rows).collect()}

    assert joined(7) == joined(10**6) and any(joined(7).values()) and joined(7)["none"] == []

    def scores(rows):
        found = vocabulary.dot_scores(keys, terms, rows).select("unit", "term", F.round("score", 9)).collect()
        return sorted(map(tuple, found))

    assert scores(7) == scores(10**6) and len(scores(7)) == 90 * 53


def test_a_query_has_one_row_however_many_blocks(spark):
    terms = _vectors(spark, [(f"t{i}", [1.0, i / 100]) for i in range(40)], "term")
    keys = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 1, [1.0, 0.0]), ("b", None, [-1.0, 0.0]), (None, 2, None)], "k string, extra int, vector array<float>")
    for rows in (1, 3, 100):
        found = vocabulary.vocabulary_matches(keys, terms, 0.5, rows).collect()
        every = sorted(f"t{i}" for i in range(40))
        assert sorted((str(r.k), r.extra, r.terms) for r in found) == sorted([("a", 1, every), ("a", 1, every), ("b", None, []), ("None", 2, [])], key=lambda x: x[:1])


def test_no_vector_passes_the_driver(spark):
    terms = _vectors(spark, [(f"t{i:03d}", [1.0, 0.0]) for i in range(9)], "term")
    blocks = vocabulary.vocabulary_blocks(terms, 4)
    assert sorted(len(r.terms) for r in blocks.collect())[-1] <= 4 and blocks.agg(F.sum(F.size("terms"))).first()[0] == 9
    keys = _vectors(spark, [("u", [1.0, 0.0])], "unit")
    plan = vocabulary.vocabulary_matches(keys, terms, 0.5, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "t007" not in plan and "LocalRelation" not in plan


def test_blocks_out_of_reach_never_meet(spark):
    terms = _vectors(spark, [(f"t{i:02d}", [10.0 / (i + 1), 0.0]) for i in range(32)], "term")
    blocks = vocabulary.vocabulary_blocks(terms, 4)
    tops = sorted((r.top for r in blocks.collect()), reverse=True)
    keys, tiles = vocabulary._tiles(_vectors(spark, [("u", [1.0, 0.0])], "unit"), 10)
    met = vocabulary._meetings(keys, tiles, blocks, 2.0).applyInArrow(lambda a, b: pa.table([pa.array([b.num_rows], pa.int64())], ["n"]), "n long")
    assert tops[0] == 10.0 and met.count() == sum(t + 1e-4 > 2 for t in tops) < len(tops)


def test_pruned_search_equals_the_full_product():
    rng = np.random.default_rng(3)
    for scale in (0.1, 0.5, 2.0):
        given, terms = rng.normal(size=(50, 24)) * rng.random(50)[:, None] * scale, rng.normal(size=(70, 24)) * rng.random(24)
        for threshold in (-1.0, 0.0, 0.5, 3.0):
            i, j = vocabulary.reaching(given, terms, threshold)
            assert set(zip(i, j, strict=True)) == set(zip(*np.nonzero(np.round(given @ terms.T, 4) > threshold), strict=True))


def test_ranked_scores(spark):
    terms = _vectors(spark, [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.0, 1.0])], "term")
    got = vocabulary.ranked_scores(_vectors(spark, [("q", [0.2, 0.9])], "id"), "id", terms).orderBy("position").collect()
    assert [(r.term, r.position) for r in got] == [("b", 1), ("c", 2), ("a", 3)]


@pytest.mark.parametrize("dim", [64, 768])
def test_both_embeddings_agree(spark, dim):
    texts = ["corn bread corn", "", "Élan vital 42 42 42", "?!"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "unit string, text string")
    whole = {r.unit: np.array(r.vector) for r in embedding.embed_texts(df, dim).collect()}
    short = {r.unit: np.array(r.v) for r in df.select("unit", V.term_vector(F.col("text"), dim).alias("v")).collect()}
    for unit in whole:
        assert whole[unit].shape == (dim,)
        assert np.allclose(whole[unit], short[unit])
        assert np.isclose(np.linalg.norm(whole[unit]), 1.0 if unit in "02" else 0.0)


def _classify(spark, scores):
    """Classify one row whose vector gives the wanted anchor scores."""
    matrix = np.array(classify.anchor_vectors(spark))
    vector = np.linalg.pinv(matrix) @ np.array(scores)
    row = classify.classify(_vectors(spark, [("u", vector.tolist())], "unit")).first()
    return row.type, row.subtype


def test_classifier(spark):
    assert _classify(spark, [0.4, 0.3, 0, 0, 0, 0, 0, 0]) == ("Organization", "Organization")
    assert _classify(spark, [0.3, 0.3, 0, 0, 0, 0, 0, 0.9]) == ("Organization", "Organization")
    for i, (label, _) in enumerate(C.SUBTYPE_ANCHORS):
        sub = [0.1] * 6
        sub[i] = 0.5
        assert _classify(spark, [0.3, 0.4, *sub]) == ("Resource", label)


def test_label_centroids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 3.0])], "label int, e array<float>")
    got = {r.term: r.vector for r in vocabulary.label_centroids(df, "label", "e").collect()}
    assert np.allclose(got["1"], [2**-0.5] * 2) and np.allclose(got["2"], [0, 1])


def test_hits_are_shuffled_as_bits(spark):
    """300 units that reach each of 1,000 long terms: what is shuffled is a small part of the lists."""
    terms = _vectors(spark, [(f"{i:04d}" + str(i * 7919) * 20, [1.0, i / 5000]) for i in range(1000)], "term")
    pairs = spark.createDataFrame([(f"u{i}", f"k{i % 5}") for i in range(300)] + [("none", "k5"), (None, "k0"), ("lost", None)], "unit string, keyword string")
    keys = _vectors(spark, [(f"k{i}", [1.0 if i < 5 else -1.0, 0.0]) for i in range(6)], "keyword")
    for rows in (300, 10**4):
        numbered, tiles = vocabulary._tiles(keys, rows)
        blocks = vocabulary.vocabulary_blocks(terms, rows)
        hits = vocabulary._hits(numbered, tiles, blocks, 0.5)
        assert {kind for _, kind in hits.dtypes} == {"bigint", "array<int>", "array<bigint>"}
        assert sum(len(r.at) for r in hits.collect()) < 5 * (1000 // 64 + 8)
        found = vocabulary.reached_terms(pairs, keys, terms, 0.5, rows).collect()
        every = sorted(r.term for r in terms.collect())
        assert sorted(str(r.unit) for r in found) == sorted(["None", *(f"u{i}" for i in range(300))])
        assert all(r.terms == every for r in found)


def test_null_units_share_one_list(spark):
    terms = _vectors(spark, [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("b", [0.0, 1.0])], "term")
    keys = _vectors(spark, [(None, [1.0, 0.0]), (None, [0.0, 1.0]), ("u", [0.0, 1.0])], "unit")
    found = {r.unit: r.terms for r in vocabulary.keywords_to_vocabulary(keys, terms, 0.5, 1).collect()}
    assert found == {None: ["a", "b"], "u": ["b"]}


def test_hit_words():
    rng = np.random.default_rng(5)
    row, term = np.nonzero(rng.random((9, 300)) < 0.3)
    each, word, bits = vocabulary.hit_words(row, term)
    pairs = {(int(r), int(w) * 64 + i) for r, w, b in zip(each, word, bits, strict=True) for i in range(64) if int(b) >> i & 1}
    assert pairs == set(zip(row.tolist(), term.tolist(), strict=True)) and len(set(zip(each, word, strict=True))) == len(each)
    assert [len(x) for x in vocabulary.hit_words(np.zeros(0, int), np.zeros(0, int))] == [0, 0, 0]


def test_dense_vectors_fill_the_gaps(spark):
    """First and last slot, neighbours, gaps and no entry at all, at two widths."""
    for dim in (5, 768):
        given = [[(0, 3.0), (dim - 1, 4.0)], [(1, 2.0), (2, 2.0)], [], [(0, 0.0)]]
        df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, sparse array<struct<b: int, w: double>>")
        found = {r.i: r.v for r in df.select("i", V.dense_unit_vector(F.col("sparse"), dim).alias("v")).collect()}
        for i, g in enumerate(given):
            norm = sum(w * w for _, w in g) ** 0.5
            plain = [0.0] * dim
            for b, w in g:
                plain[b] = w / norm if norm else 0.0
            assert found[i] == plain


def test_words_of_lists_are_counted_where_the_lists_are(spark):
    lists = [("a", ["Mill Oak", "mill-oak 7", None]), ("b", []), ("c", None), ("d", ["ΟΔΟΣ İl ½x_y ²", "l'été 一二"]), ("a", ["oak"])]
    df = spark.createDataFrame(lists, "unit string, texts array<string>")
    assert "Exchange" not in embedding.slot_counts(df)._jdf.queryExecution().executedPlan().toString()
    joined = df.select("unit", F.array_join("texts", ",").alias("text"))
    for dim in (5, 64):
        found = {r.unit: r.vector for r in embedding.embed_lists(df, dim).collect()}
        assert found == {r.unit: r.vector for r in embedding.embed_texts(joined, dim).collect()} and len(found) == 4


def test_hits_are_folded_over_batches(spark):
    terms = _vectors(spark, [(f"t{i:03d}", [1.0, i / 1000]) for i in range(200)], "term")
    keys = spark.createDataFrame([(f"u{i % 3}", [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(60)] + [("u1", None)], "unit string, vector array<double>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        for rows in (70, 1000):
            found = vocabulary.keywords_to_vocabulary(keys, terms, 0.5, rows)
            assert {r.unit: r.terms for r in found.collect()} == {u: [f"t{i:03d}" for i in range(200)] for u in ("u0", "u1", "u2")}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString() and "bit_or" not in found._jdf.queryExecution().toString()


def test_fields_of_records_are_not_sent_through_the_driver(spark):
    small = spark.createDataFrame([("a", 1), (None, 2)], "unit string, x int")
    joined = records._beside(small, small.select("unit", F.col("x").alias("y")))
    assert sorted(map(tuple, joined.collect()), key=str) == [("a", 1, 1), (None, 2, None)]
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan

import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitemill import constants as C
from sitemill.models import Models, with_key_vectors
from sitemill.operators import term_vectors as T
from sitemill.operators.records import References, records
from sitemill.workspace import stage, staging_root


def _texts(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "unit string, text string")


def _plain(texts, window, least):
    docs = [[w for w in t.lower().split()] for t in texts]
    counts = Counter(w for d in docs for w in d)
    pairs = Counter()
    for d in docs:
        for i, a in enumerate(d):
            for j in range(max(0, i - window), min(len(d), i + window + 1)):
                if i != j and counts[a] >= least and counts[d[j]] >= least:
                    pairs[a, d[j]] += 1
    sums, total = Counter(), sum(pairs.values())
    for (a, _), n in pairs.items():
        sums[a] += n
    cells = {(a, b): math.log(n * total / (sums[a] * sums[b])) for (a, b), n in pairs.items()}
    return counts, pairs, {k: x for k, x in cells.items() if x > 0}


def _made(seed, n=120):
    """Two kinds of texts; in each, a word has a twin that stands in the same places, never near it or itself."""
    rng = random.Random(seed)
    things = {"road": "wheel engine driver tyre brake mirror".split(), "food": "oven flour sugar yeast butter salt".split()}
    twins = {"road": ("car", "automobile"), "food": ("loaf", "bread")}
    out = []
    for _ in range(n):
        kind = rng.choice(sorted(things))
        twin = rng.choice(twins[kind])
        out.append(" ".join(twin if i % 9 == 4 else rng.choice([*things[kind], "and"]) for i in range(18)))
    return out


def test_counts_and_cells_equal_plain_python(spark):
    texts = [*_made(1, 30), "rare words here", "", "a a a a a a b a"]
    counts, pairs, cells = _plain(texts, 3, 4)
    words = stage(T.word_counts(_texts(spark, texts), 4), "w")
    known = {r.term: (r.n, r.id) for r in words.collect()}
    assert {w: n for w, (n, _) in known.items()} == {w: n for w, n in counts.items() if n >= 4}
    assert sorted(i for _, i in known.values()) == list(range(len(known)))
    name = {i: w for w, (_, i) in known.items()}
    found = stage(T.cooccurrences(_texts(spark, texts), words, 3), "p")
    assert {(name[r.a], name[r.b]): r.n for r in found.collect()} == dict(pairs)
    got = {(name[r.a], name[r.b]): r.x for r in T.positive_pmi(found).collect()}
    assert got.keys() == cells.keys() and all(got[k] == pytest.approx(x) for k, x in cells.items())


@pytest.mark.parametrize("block, most", [(8192, 10**6), (7, 40)])
def test_factors_equal_those_of_the_whole_matrix(spark, block, most):
    rng = np.random.default_rng(2)
    n, dim = 40, 5
    half = rng.normal(size=(n, dim)) * (rng.random((n, dim)) < 0.5)
    half[:, 0] += 1.0 * (half == 0).all(axis=1)
    whole = half @ np.diag([9, -7, 5, 3, 2.0]) @ half.T
    cells = spark.createDataFrame([(int(a), int(b), float(whole[a, b])) for a, b in zip(*np.nonzero(whole), strict=True)], "a int, b int, x double")
    found = T.Factors(cells, n, block, most).strongest(dim, sharpen=2)
    got = np.array([r.vector for r in found.orderBy("id").collect()])
    values, directions = np.linalg.eigh(whole)
    order = np.argsort(-np.abs(values))[:dim]
    want = directions[:, order] * np.sqrt(np.abs(values[order]))
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert got.shape == (n, dim) and np.allclose(got @ got.T, want @ want.T, atol=1e-5)


def test_like_contexts_are_near_and_others_far(spark):
    trained = T.train(_texts(spark, _made(3)), dim=8, window=4)
    again = T.train(_texts(spark, _made(3)), dim=8, window=4)
    vector, other = ({r.term: np.array(r.vector) for r in t.collect()} for t in (trained, again))
    assert all(np.allclose(vector[w], other[w], atol=1e-6) for w in vector)
    assert vector["car"] @ vector["automobile"] > C.HOUSE_THRESHOLD < vector["loaf"] @ vector["bread"]
    assert max(vector["car"] @ vector["bread"], vector["automobile"] @ vector["loaf"]) < C.DUAL_PARADIGM_THRESHOLD
    rows = spark.createDataFrame([("car",), ("Automobile!",), ("zebra",), ("loaf bread",)], "t string")
    made = {r.t: r for r in with_key_vectors(rows, "t", Models(vectors=trained, dim=8)).collect()}
    assert np.allclose(made["car"].vector, vector["car"]) and np.allclose(made["Automobile!"].vector, vector["automobile"])
    assert made["zebra"].vector == [0.0] * 8 and made["zebra"].error is None
    assert np.linalg.norm(made["loaf bread"].vector) == pytest.approx(1)


def test_records_reach_terms_that_share_no_letters(spark):
    trained = T.train(_texts(spark, _made(3)), dim=8, window=4)
    gazetteer = spark.createDataFrame([], "name string, tag string")
    places = spark.createDataFrame([], "description string")
    house = spark.createDataFrame([("automobile",), ("bread",)], "term string")
    texts = spark.createDataFrame([("u", "The car stands near. A car is red. My car goes on.")], "unit string, text string")

    def reached(models):
        return records(texts, [(F.lit(True), house)], "eco", References(gazetteer, places, models)).first()

    assert reached(Models(dim=8, vectors=trained)).all_keywords == ["automobile"]
    assert reached(Models(dim=64)).all_keywords == []


def test_nothing_to_learn_from(spark):
    for texts in ([], ["", "one two"], ["same"] * 9):
        trained = T.train(_texts(spark, texts))
        assert trained.columns == ["term", "n", "vector"] and trained.collect() == []


def test_pairs_are_kept_once_and_words_are_not_shuffled(spark):
    texts = spark.createDataFrame([("u", "a b a"), (None, "a c"), ("u", "a b")], "unit string, text string")
    words = spark.createDataFrame([("a", 5, 0), ("b", 5, 1), ("c", 5, 2)], "term string, n long, id int")
    pairs = T.cooccurrences(texts, words, 2)
    got = {(r.a, r.b): r.n for r in pairs.collect()}
    assert all(got[b, a] == n for (a, b), n in got.items()) and got[0, 2] == 1
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "pair#" in plan  # read from one staged row per unordered pair


def test_a_product_moves_the_thin_matrix_few_times(spark):
    cells = spark.range(4000).selectExpr("cast(id % 2000 AS int) AS a", "cast((id * 7) % 2000 AS int) AS b", "1.0D AS x")
    found = T.Factors(cells, 2000, most=250)
    assert found.blocks * found.pieces >= 16 and found.blocks + found.pieces <= 9


def test_tables_that_are_used_up_leave_the_disk(spark):
    def staged():
        return {p.name for p in Path(staging_root(spark).removeprefix("file://"), "sitemill").glob("*")}

    before = staged()
    texts = spark.createDataFrame([(str(i), "corn bread flour mill oven yeast " * 3) for i in range(5)], "unit string, text string")
    assert T.train(texts, dim=3).count() == 6
    left = [name.rsplit("-", 1)[0] for name in staged() - before]
    assert not {"word-pairs", "pmi", "packed-cells"} & {*left} and left.count("thin-matrix") == 1

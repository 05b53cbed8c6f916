import random
from collections import Counter

import numpy as np
import pytest

from sitemill.llm import components as C
from sitemill.llm import lsh_forest as J
from tests.llm.conftest import ODD_TEXTS, frame, words


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    links, parent = Counter(), list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 9 * common >= 4 * (len(sets[i]) + len(sets[j])):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(doc)
    names = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return [(doc, names[find(i)], links[i]) for i, (doc, _) in enumerate(docs)]


def edited(rng, base, changes):
    w = list(base)
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def many():
    rng = random.Random(5)
    docs = list(ODD_TEXTS)
    for g in range(6):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([40, 120, 400]))]
        docs += [(100 * (g + 1) + k, edited(rng, base, rng.choice([0, 1, 2, 5, 20]))) for k in range(12)]
    base = [f"h{rng.randrange(3000)}" for _ in range(300)]
    return docs + [(1000 + k, edited(rng, base, 3)) for k in range(90)]


@pytest.mark.parametrize("block", [256, 16])
def test_against_brute_force(spark, many, block, monkeypatch):
    monkeypatch.setattr(J, "NODE_BLOCK", block)
    monkeypatch.setattr(J, "CLUSTER_BLOCK", block)
    got = [tuple(r) for r in J.report(frame(spark, many)).collect()]
    assert sorted(got, key=str) == sorted(brute(many), key=str)


def test_one_document_of_each_group_stays(spark, many, none):
    docs = frame(spark, many)
    kept = J.representatives(docs)
    assert kept.schema == docs.schema
    expected = Counter(doc for doc, name, _ in set(brute(many)) if doc is not None and doc == name)
    assert Counter(r.doc_id for r in kept.where("doc_id is not null").collect()) == expected
    assert kept.where("doc_id is null").count() == 2  # "x y z" and the null text
    assert J.report(none).count() == 0 and J.representatives(none).count() == 0


def test_equal_texts_without_words_are_one_group(spark):
    docs = [(5, ""), (3, ""), (3, ""), (None, ""), (9, " - "), (8, " - "), (None, "..."), (1, None), (2, None), (None, None), (7, "a b")]
    kept = J.representatives(frame(spark, docs)).collect()
    expected = [(3, ""), (8, " - "), (None, "..."), (1, None), (2, None), (None, None), (7, "a b")]
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(expected, key=str)
    assert sorted((tuple(r) for r in J.report(frame(spark, docs)).collect()), key=str) == sorted(brute(docs), key=str)


def test_depth_reaches_the_target_recall():
    d = J.depth(0.8)
    assert 1 - (1 - 0.8**d) ** J.TREES >= J.TARGET_RECALL > 1 - (1 - 0.8 ** (d + 1)) ** J.TREES


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in C.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tiles_let_any_two_rows_meet_once(spark):
    rows = spark.range(23).selectExpr("id", "23 as n")
    tiles = C.spread_pairs(rows, "n", 5, "id").collect()
    met = Counter()
    by_tile = {}
    for r in tiles:
        by_tile.setdefault((r.ti, r.tj), []).append(r)
    for (ti, tj), members in by_tile.items():
        for a in members:
            for b in members:
                if a.id < b.id and (ti == tj or a.side != b.side):
                    met[a.id, b.id] += 1
    assert set(met.values()) == {1} and len(met) == 23 * 22 // 2


def test_exact_links_count_whole_numbers():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3, 4], [1, 2, 3, 4, 5], [1, 2, 3], [9])]
    assert J.exact_links(sets).tolist() == [[False, True, False, False], [True, False, False, False], [False] * 4, [False] * 4]


def test_prefixes_are_shortened_until_the_target_recall():
    rng = np.random.default_rng(3)
    d, block = J.depth(0.8), 10
    steps = J.LEVELS - d + 1
    sizes = np.sort(rng.integers(1, 200, (500, J.TREES, steps)), axis=2)[:, :, ::-1].copy()
    sizes[:100] = 1
    sizes[100:200, 3:] = 1
    sizes[200:300] = 5000
    found = J.shortened(sizes, d, block, 0.8)
    large = sizes[:, :, 0] > block
    assert (found[~large] == d).all() and found.min() >= d and (found[large] > d).any()
    assert (np.prod(1 - 0.8**found, axis=1) <= 1 - J.TARGET_RECALL + 1e-12).all()
    inside = np.prod(np.where(large, 1 - 0.8 ** (found - d), 1), axis=1) + (1 - 0.8**d) ** J.TREES
    assert (inside[large.any(axis=1)] <= 1 - J.TARGET_RECALL + 1e-12).all()
    for c in (250, 400):  # one step less in the tree shortened last would miss the target
        deeper = found[c] + np.eye(J.TREES, dtype=int)
        deeper = deeper[(deeper <= J.LEVELS).all(axis=1)]
        assert (np.prod(1 - 0.8**deeper, axis=1) > 1 - J.TARGET_RECALL).any() or (found[c] == d).any()


def test_asked_tiles_let_every_asking_class_meet_its_node(spark):
    rows = [(1, i, 23, i % 4 == 0, 6) for i in range(23)] + [(2, i, 4, i == 0, 1) for i in range(4)]
    tiles = J.asked_tiles(spark.createDataFrame(rows, "key long, node long, n long, asks boolean, asked long"), 5).collect()
    by_tile = {}
    for r in tiles:
        by_tile.setdefault((r.key, r.ti, r.tj), set()).add(r.node)
    met = {(k, a, b) for (k, _, _), members in by_tile.items() for a in members for b in members}
    assert all((k, a, b) in met for k, a, _, asks, _ in rows if asks for k2, b, *_ in rows if k2 == k)
    assert max(sum(r.node == i and r.key == 1 for r in tiles) for i in range(23) if i % 4) <= 2


def test_lone_partners_in_crowded_nodes_are_found(spark, monkeypatch):
    monkeypatch.setattr(J, "NODE_BLOCK", 6)
    rng = random.Random(11)
    common = [f"c{i}" for i in range(200)]
    docs = []
    for g in range(250):
        first = common + [f"g{g}w{rng.randrange(10**6)}" for _ in range(150)]
        docs += [(2 * g, " ".join(first)), (2 * g + 1, " ".join(first + [f"g{g}v{rng.randrange(10**6)}" for _ in range(86)]))]
    kept = {}
    searched = J.searched
    monkeypatch.setattr(J, "searched", lambda *x: kept.setdefault("rows", searched(*x)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.report(frame(spark, docs)).collect()}
    assert kept["rows"].count() > 500  # the crowd does make large nodes
    pairs = sum(got[2 * g + 1] == (2 * g, 1) for g in range(250))
    assert pairs >= 0.99 * 250 and all(got[d][0] in (d, d - d % 2) for d in got)

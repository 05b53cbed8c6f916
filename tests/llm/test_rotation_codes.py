import math

import numpy as np
import pytest

from sitemill.llm import rotation_codes as R


def brute(rows):
    ok = [v is not None and lab is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    names = {}
    for i, r in enumerate(rows):
        names.setdefault(find(i), []).append(r[0])
    name = {g: min((x for x in ids if x is not None), default=None) for g, ids in names.items()}
    return sorted(((r[0], links[i], name[find(i)], r[0] == name[find(i)]) for i, r in enumerate(rows)), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    out = []
    for g in range(12):
        base = rng.normal(size=24)
        out += [(1000 - len(out), (base + rng.normal(size=24) * s).tolist(), g % 3) for s in rng.choice([0, 0.05, 0.2, 0.3], 25)]
    odd = [None, [], [0.0] * 24, [1.0, None] * 12, [float("nan")] * 24, [float("inf")] * 24, [1.0, 2.0], [2.0, 4.0]]
    out += [(2000 + k, v, 1) for k, v in enumerate(odd)] + [(3000, out[0][1], None), (None, out[0][1], 0), (out[0][0], out[0][1], 0)]
    return out


@pytest.mark.parametrize("block", [256, 8])
def test_against_brute_force(spark, rows, block, monkeypatch):
    monkeypatch.setattr(R, "RUN_BLOCK", block)
    monkeypatch.setattr(R, "CLUSTER_BLOCK", block)
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, node int, code string")
    got = [tuple(r) for r in R.near_duplicates(vectors).collect()]
    assert sorted(got, key=str) == brute(rows)
    assert R.near_duplicates(vectors.where("false")).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(400, 64))
    b = 0.93 * R.unit(a) + math.sqrt(1 - 0.93**2) * R.unit(np.cross(a[:, :3], a[:, 3:6]) @ rng.normal(size=(3, 64)))
    b -= 0  # about the threshold, some below and some above
    both = R.unit(np.concatenate([R.unit(a), b]))
    found = R.Estimates(both, *R.codes(both))
    i, j = np.arange(400), np.arange(400, 800)
    true = R.cosines(both, i, j)
    guess = (found.turned[i] * found.codes[j]).sum(axis=(1, 2))
    assert abs((guess - true).mean()) < 0.005
    assert found.possible(i, j, 0.93)[true >= 0.93].all() and not found.possible(i[:-1], j[1:], 0.93).any()


def test_tables_reach_the_target_recall():
    for n in (100, 10**6):
        bits, runs = R.tables(n)
        meet = (1 - math.acos(R.THRESHOLD) / math.pi) ** bits
        assert 1 - (1 - meet) ** runs >= R.TARGET_RECALL and runs < 400

import itertools
import math
import random

import duckdb
import numpy as np
import pytest

from sitemill.llm import hilbert_negatives as H
from sitemill.llm.queries import OP13_SQL
from sitemill.workspace import new_path

FIELDS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v])
        if all(-H.MOST <= x < H.MOST for x in row[1]):
            kept[i] = min(kept.get(i, row), row)
    out = []
    for a, (label, v) in kept.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, w) in kept.items() if i != a and len(w) == len(v))
        for positive, p, _ in [s for s in scored if s[2] == label][:5]:
            window = [(n, i) for n, i, other in scored if other != label and 30 * -positive <= 100 * -n <= 90 * -positive]
            out += [(a, p, rank, i, -positive, -n) for rank, (n, i) in enumerate(window[:10], 1)]
    return sorted(out)


def found(spark, rows, **how):
    table = H.hard_negatives(spark.createDataFrame(rows, SCHEMA), **how)
    assert table.columns == FIELDS
    return sorted(map(tuple, table.collect()))


def made(seed, n, dim, step=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dim)] for _ in range(6)]
    return [(i * step, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)], rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"block": 4, "tile": 2, "part": 3}, {"block": 1, "tile": 1, "part": 1000}])
def test_rows_equal_brute_force(spark, how):
    rows = made(1, 200, 5, 10)
    assert (got := plain(rows)) and found(spark, rows, **how) == got


def test_ties_copies_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [0.5, -0.25, 0.125], i % 2) for i in range(0, 300, 5)]
    rows += [(1, None, 1), (2, [], 1), (3, [0.1, None, 0.1], 1), (4, [nan, 0.0, 1.0], 1), (6, [inf, 0.0, 1.0], 1), (8, [0.5, 0.1, 0.2], None)]
    rows += [(None, [0.5, 0.1, 0.2], 1), (200, [0.5, -0.25, 0.125], 0), (200, [0.4, -0.25, 0.1], 0), (9, [1e30, 0.0, 0.0], 0), (11, [1.0, 1.0], 1), (400, [1.0, 0.5], 1)]
    rows += [(12, [0.9, 0.1], 2), (13, [0.3, 0.2], 2), (14, [0.0, 0.0], 3), (500, [0.0, 0.0, 0.0], 7), (501, [0.0, 0.0, 0.0], 7), (17, [-3.0, 0.5, 0.5], 1)]
    assert (got := plain(rows)) and found(spark, rows) == got
    assert found(spark, rows, block=2, tile=1, part=2) == got


def test_extra_columns_and_empty_tables(spark):
    rows = made(3, 120, 3, 10)
    wide = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS dim", "2 AS place", "'x' AS cells", "3 AS block", "4 AS score")
    assert sorted(map(tuple, H.hard_negatives(wide).collect())) == plain(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, [0.1], 1), (2, [0.2], 2)]) == []  # no anchor
    assert found(spark, [(100, [0.1], 1), (2, [0.2], 2)]) == []  # no positive


def test_large_numbers_stay_exact():
    a, b = np.array([[2**26 - 1, -(2**26)]], np.int32), np.array([[2**26 - 1, 2**26 - 3]], np.int32)
    assert H.product(a, b)[0, 0] == (2**26 - 1) ** 2 - 2**26 * (2**26 - 3)


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (5, 2)])
def test_next_places_on_the_curve_are_neighbours(dims, bits):
    grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = [k.tobytes() for k in H.hilbert_keys(grid, bits)]
    assert len(set(keys)) == len(grid)
    along = grid[sorted(range(len(grid)), key=keys.__getitem__)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_spare_blocks(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8))
    rows = [(i, (centres[i % 40] + rng.normal(size=8) * 0.02).tolist(), i % 3) for i in range(4000)]
    kept = H.candidates(spark.createDataFrame(rows, SCHEMA))
    blocks = H.Blocks(kept, new_path(spark, "blocks"), block=32)
    for r in blocks.table.collect():
        cells = np.frombuffer(r["cells"], "<i4").reshape(r["rows"], -1)
        assert (cells.min(axis=0) == r["lows"]).all() and (cells.max(axis=0) == r["highs"]).all()
        least, most = H.bounds(cells[:3], np.array([r["lows"]]), np.array([r["highs"]]))
        scores = H.product(cells[:3], cells)
        assert (scores >= least).all() and (scores <= most).all()
    far = H.FAR
    questions = blocks.anchors.selectExpr("*", f"array({-far}L) AS lows", f"array({far}L) AS highs")
    best = blocks.answers(questions, True, 5)
    last = best.where("position = 5").selectExpr("anchor_id AS vec_id", "array(score) AS lows")
    needed = blocks.chosen(questions.drop("lows").join(last, "vec_id").select(questions.columns), True)
    asked = sum(bin(b).count("1") for r in needed.collect() for b in r["asking"])
    every = blocks.zones.join(questions.select("label", "vec_id"), "label").count()
    assert asked < every / 3


def test_sql_states_the_same(spark):
    rows = [*made(4, 150, 4, 10), (5, None, 1), (6, [None, 1.0, 1.0, 1.0], 2), (21, [0.1, float("nan"), 0.1, 0.1], 2)]
    with duckdb.connect() as db:
        db.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
        db.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
        stated = db.execute(f"SELECT {', '.join(FIELDS)} FROM ({OP13_SQL})").fetchall()
    assert sorted(stated) == plain(rows)

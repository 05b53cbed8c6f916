import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sitemill.llm import config_pack as P
from sitemill.llm import tokens
from tests.llm.conftest import ODD_TEXTS, frame


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
@settings(max_examples=60, deadline=None)
def test_plans_hold_every_piece_once(histogram):
    planned = P.plan(histogram, 64, 30)
    used = {}
    for times, config in planned:
        assert times > 0 and sum(length * n for length, n in config.items()) <= 64
        for length, n in config.items():
            used[length] = used.get(length, 0) + times * n
    assert used == histogram
    sequences = sum(times for times, _ in planned)
    assert sequences <= 2 * -(-sum(k * n for k, n in histogram.items()) // 64) + 1


def test_plan_is_near_the_bound():
    lengths = np.clip(np.exp(np.random.default_rng(1).normal(5, 1, 20000)).astype(int) + 1, 1, 1024)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    bound = -(-int(lengths.sum()) // 1024)
    assert sum(times for times, _ in P.plan(histogram, 1024)) <= 1.002 * bound


def _wide():
    lengths = np.clip(np.exp(np.random.default_rng(2).normal(6, 1.2, 30000)).astype(int) + 1, 1, 4095)
    return np.unique(lengths, return_counts=True)


def test_all_classes_are_covered_near_the_optimum():
    lengths, counts = _wide()
    sizes, of, units = P.length_classes(lengths, 4096)
    assert len(sizes) < 100 and (sizes[of] * 4096 >= lengths * units).all()
    need = np.bincount(of, counts)
    found, bound = P.fractional(sizes, need, units)
    covered = np.zeros(len(sizes))
    for amount, config in found:
        assert sum(sizes[i] * n for i, n in config.items()) <= units
        for i, n in config.items():
            covered[i] += amount * n
    assert (covered >= need * (1 - 1e-9)).all()
    assert sum(amount for amount, _ in found) <= (1 + P.TOLERANCE) * bound * (1 + 1e-9)
    assert abs(sum(times for times, _ in P.rounded(found)) - sum(amount for amount, _ in found)) <= 1


def test_the_program_places_most_sequences_of_a_wide_histogram():
    lengths, counts = _wide()
    rest = counts.copy()
    placed = P.programmed(lengths, rest, 4096)
    assert len(lengths) > 3000 and rest.min() >= 0
    by_program = sum(times for times, _ in placed)
    assert by_program >= 0.9 * (by_program + sum(times for times, _ in P.best_fit(lengths, rest, 4096)))
    total = sum(times for times, _ in P.plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True))))
    assert total <= 1.002 * -(-int(lengths @ counts) // 4096)


def test_pricing_finds_the_best_configuration():
    found = P.best_configuration(np.array([3, 5, 7]), np.array([3.0, 5.5, 7.1]), 13)
    assert found == {0: 1, 1: 2}


def test_pieces_and_places(spark, none):
    docs = [d for d in ODD_TEXTS if d[1] is None or len(d[1]) < 10000] + [(50, "long text here " * 700), (51, None)]
    rows = P.pack_documents(frame(spark, docs), 64, 20).collect()
    library = tokens.load(tokens.VOCABULARY)
    expected = []
    for d, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids + [tokens.END_ID]
        for k, s in enumerate(range(0, len(ids), 64)):
            part = ids[s : s + 64]
            expected.append((d, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(expected, key=str)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by_sequence) <= -(-sum(e[3] for e in expected) // 64) + 1
    assert P.pack_documents(none).count() == 0


def test_sequences_hold_the_ids(spark):
    docs = frame(spark, [(1, "one two"), (2, "three four five"), (3, "six " * 30)])
    rows = P.sequences(docs, 16).collect()
    ids = np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in rows])
    assert all(len(r.ids) == 4 * r.n_tokens <= 64 for r in rows) and (ids == tokens.END_ID).sum() == 3 and len(ids) == 3 + 5 + 30

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitemill.llm import mixing_coder as M
from sitemill.llm import tokens
from sitemill.workspace import new_path
from tests.llm.conftest import ODD_TEXTS, frame


@given(st.lists(st.integers(0, M.ALPHABET - 1) | st.integers(0, 3), max_size=2000))
@settings(max_examples=25, deadline=None)
def test_round_trip(ids):
    given_ids = np.array(ids, "<u4")
    found, sizes = M.decode(M.encode(given_ids, np.array([len(ids)])))
    assert found.tolist() == ids and sizes.tolist() == [len(ids)]


def test_carries_and_skewed_counts():
    rng = np.random.default_rng(3)
    for ids in (np.full(5000, M.ALPHABET - 1), rng.integers(M.ALPHABET - 40, M.ALPHABET, 60000), np.tile([1, 2, 3, M.ALPHABET - 1], 9000)):
        assert (M.decode(M.encode(ids.astype("<u4"), np.array([len(ids)])))[0] == ids).all()


def test_repeats_are_coded_small():
    ids = np.tile(np.random.default_rng(1).integers(0, 49000, 500), 200).astype("<u4")
    assert len(M.encode(ids, np.array([len(ids)]))) < len(ids)  # 32 bits become fewer than 8


def test_damage_is_seen():
    block = bytearray(M.encode(np.arange(3000, dtype="<u4"), np.array([3000])))
    block[len(block) // 2] ^= 1
    with pytest.raises((ValueError, IndexError)):
        M.decode(bytes(block))
    with pytest.raises(ValueError):
        M.decode(b"none" + bytes(40))
    with pytest.raises(ValueError):
        M.encode(np.array([M.ALPHABET], "<u4"), np.array([1]))


@pytest.mark.parametrize("block_ids", [M.BLOCK_IDS, 40])
def test_files(spark, none, block_ids, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_IDS", block_ids)
    docs = [d for d in ODD_TEXTS if d[1] is None or len(d[1]) < 10000] + [(20 + i, f"text {i} " * i) for i in range(30)]
    M.write(frame(spark, docs), path := new_path(spark, "t"))
    rows = M.read(spark, path).orderBy("start").collect()
    assert [r.doc_id is not None for r in rows] == sorted(r.doc_id is not None for r in rows)
    named = [r.doc_id for r in rows if r.doc_id is not None]
    assert named == sorted(d for d, _ in docs if d is not None)
    library, at, ids_of = tokens.load(tokens.VOCABULARY), 0, {}
    for d, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids + [tokens.END_ID]
        ids_of.setdefault(d, []).append(np.array(ids, "<u4").tobytes())
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        ids_of[r.doc_id].remove(bytes(r.ids))
        at += r.n_tokens
    assert not any(ids_of.values())
    M.write(none, path := new_path(spark, "t"))
    assert M.read(spark, path).count() == 0


def test_repeated_rows_other_columns_and_empty_table(spark, tmp_path):
    rows = [(7, "same text", 1, 2)] * 3 + [(7, "other", 3, 4), (None, None, 5, 6), (1, "", 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int, block int")
    M.write(docs, str(tmp_path / "some"))
    got = M.read(spark, str(tmp_path / "some"), with_ids=False).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 7, 7, 7, 7] and [r.n_tokens for r in got][:2] == [1, 1]
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(6)]
    same = sorted(r.ids_crc32 for r in got[2:])
    assert len(set(same)) == 2 and got[0].ids_crc32 == got[1].ids_crc32
    M.write(docs.limit(0), str(tmp_path / "none"))
    assert M.read(spark, str(tmp_path / "none")).collect() == []

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sitemill.llm import tokens, words as W
from tests.llm.conftest import words

ALPHABET = st.sampled_from(list("abSt'’.,;<|>endoftx≯́ \n\t éñÉ1２…ß中ΣİıﬁK\x85\x1c​‍\U0001f600-_"))
TEXTS = st.lists(st.one_of(st.none(), st.text(ALPHABET, max_size=40), st.text(max_size=20)), max_size=8)


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_words_are_the_words(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    found = W.words_of(pa.array(texts, pa.string()))
    got = [[found.text(i).decode() for i in range(found.first[d], found.first[d + 1])] for d in range(len(texts))]
    assert got == [words(t) for t in texts]
    names = [w for t in texts for w in words(t)]
    assert len(set(zip(names, found.hashes.tolist(), strict=True))) == len(set(names)) == len(set(found.hashes.tolist()))


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_pieces_give_the_ids_of_whole_texts(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    texts.append("a<|endoftext|>b <|startoftext|>")
    encoder = tokens.encoder()
    flat, begin = encoder.encode(pa.array(texts, pa.string()))
    for d, text in enumerate(texts):
        assert flat[begin[d] : begin[d + 1]].tolist() == encoder.library.encode(text or "", add_special_tokens=False).ids


def test_long_ranges_hash_like_short_ones(monkeypatch):
    text = pa.array(["one two three " * 2000])
    whole = W.words_of(text).hashes
    monkeypatch.setattr(W, "RANGE_BYTES", 50)
    assert (W.words_of(text).hashes == whole).all() and len(set(whole.tolist())) == 3


def test_windows_stay_inside_texts():
    found = W.words_of(pa.array(["a b c", None, "b c", "a b c"]))
    keys, at = W.windows(found.hashes, found.first, 2)
    assert at.tolist() == [0, 1, 3, 5, 6] and keys[0] == keys[3] and keys[1] == keys[2] == keys[4]


def test_forgetting_keeps_results(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    encoder = tokens.Encoder(tokens.VOCABULARY)
    for text in ("one two three four", "five six seven eight nine ten eleven twelve", "one two"):
        flat, _ = encoder.encode(pa.array([text]))
        assert flat.tolist() == encoder.library.encode(text, add_special_tokens=False).ids

"""Token ids of text batches with a public tokenizer, each distinct piece of text encoded once per worker.

The tokenizer drops white space and splits letters, digits and other signs before it merges, so a text may
be encoded in pieces that end where no rule can look across: at white space, and between an ASCII letter
and an ASCII sign that is neither letter nor apostrophe.  Pieces are found and hashed on the bytes of a
whole batch; only pieces that this worker has not met go through the library.  A text that spells a
special token is encoded whole.  Pieces are told apart by a 64-bit hash and their length.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np
import pyarrow as pa
from public_tokenizers import path
from tokenizers import Tokenizer

from sitemill.llm import words as W

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Pieces a worker remembers before it starts anew.
REMEMBERED = 1 << 20
#: New pieces that go through the library in one call.
JOINED = 200

_codes = np.arange(256)
_SPACE = np.isin(_codes, [9, 10, 13, 32])
_LETTER = ((_codes >= 65) & (_codes <= 90)) | ((_codes >= 97) & (_codes <= 122))
_SIGN = (_codes < 128) & ~_LETTER & (_codes != 39)
#: 1: ASCII letter, 2: ASCII sign (not the apostrophe), 0: all else
_CLASS = np.where(_LETTER, 1, np.where(_SIGN, 2, 0)).astype(np.uint8)


@cache
def load(vocabulary: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path(vocabulary))


class Encoder:
    """Encodes batches; one per worker and vocabulary."""

    def __init__(self, vocabulary: str):
        self.library = load(vocabulary)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.mark_id, token = max(self.library.get_added_tokens_decoder().items())
        self.mark = token.content.encode()
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.order = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.places = np.zeros(1, np.int64)

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        parts = []
        for i in range(0, len(starts), JOINED):  # a special token after each piece keeps them apart
            ranges = zip(starts[i : i + JOINED].tolist(), ends[i : i + JOINED].tolist(), strict=True)
            text = b"".join(part for a, b in ranges for part in (data[a:b], self.mark)).decode()
            parts.append(np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32))
        ids = np.concatenate(parts)
        stops = np.flatnonzero(ids == self.mark_id)
        sizes = np.diff(stops, prepend=-1) - 1
        self.flat = np.concatenate([self.flat, ids[ids != self.mark_id]])
        slots = np.arange(len(self.places) - 1, len(self.places) - 1 + len(keys))
        self.places = np.concatenate([self.places, self.places[-1] + np.cumsum(sizes)])
        at = np.searchsorted(self.known, keys)  # both ascend
        self.known, self.order = np.insert(self.known, at, keys), np.insert(self.order, at, slots)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (int32) one after another, and the n + 1 places where texts begin; null is empty."""
        data, places = W.buffers(texts)
        odd = self._spelled(data, places)
        kind = _CLASS[data]
        cuts = np.flatnonzero(kind[1:] + kind[:-1] == 3) + 1
        starts, ends = W.runs(~_SPACE[data], np.concatenate([cuts, places]))
        keys = W.mix(W.hash_runs(data, starts, ends) ^ (ends - starts).astype(np.uint64))
        distinct, first, which = W.distinct_of(keys)
        slot = self._slots(distinct)
        fresh = np.flatnonzero(slot < 0)
        if len(fresh):
            if len(self.known) + len(fresh) > REMEMBERED:
                self.forget()
                fresh = np.arange(len(distinct))
            self._learn(distinct[fresh], data, starts[first[fresh]], ends[first[fresh]])
            slot = self._slots(distinct)
        slot = slot[which]
        sizes = self.places[slot + 1] - self.places[slot]
        total = np.concatenate([[0], np.cumsum(sizes)])
        source = np.repeat(self.places[slot] - total[:-1], sizes) + np.arange(total[-1])
        flat, begin = self.flat[source], total[np.searchsorted(starts, places)]
        return self._with_whole(flat, begin, odd, data, places) if odd else (flat, begin)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        if len(self.known) == 0:
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        return np.where(self.known[at] == keys, self.order[at], -1)

    def _spelled(self, data: np.ndarray, places: np.ndarray) -> list[int]:
        raw, found = data.tobytes(), set()
        for mark in self.special:
            at = raw.find(mark)
            while at >= 0:
                found.add(int(np.searchsorted(places, at, side="right")) - 1)
                at = raw.find(mark, at + 1)
        return sorted(found)

    def _with_whole(self, flat, begin, odd, data, places):
        parts = [flat[begin[d] : begin[d + 1]] for d in range(len(begin) - 1)]
        for d in odd:
            whole = data[places[d] : places[d + 1]].tobytes().decode()
            parts[d] = np.array(self.library.encode(whole, add_special_tokens=False).ids, np.int32)
        sizes = np.array([len(p) for p in parts])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


@cache
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    return Encoder(vocabulary)


def with_end(flat: np.ndarray, begin: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with the end id after each text."""
    return np.insert(flat, begin[1:], end_id).astype("<u4"), begin + np.arange(len(begin))

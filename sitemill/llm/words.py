"""Words of text batches as numpy arrays.

A word is a run of ``0-9 a-z`` and of all characters beyond ASCII after ``A-Z`` are lower-cased, which
on UTF-8 bytes is a plain class of bytes.  A whole Arrow batch is cut and hashed with array operations;
no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEED = 20240607
#: Hashing works on ranges of about this many bytes, cut between words.
RANGE_BYTES = 1 << 20

_codes = np.arange(256, dtype=np.uint8)
LOWER = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)
IS_WORD = ((LOWER >= 97) & (LOWER <= 122)) | ((_codes >= 48) & (_codes <= 57)) | (_codes >= 128)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: One random value per (lower-cased) byte.
_VALUES = np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def distinct_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in ascending order, one place of each, and which of them stands where."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.append(True, ordered[1:] != ordered[:-1]) if len(x) else np.zeros(0, bool)
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], order[new], which


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and the n + 1 places where texts begin; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    places = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(places) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[places[0] : places[-1]], places - places[0]


def runs(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values, also cut at the given places."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    edge[1:n] = inside[1:] != inside[:-1]
    edge[cuts[(cuts > 0) & (cuts < n)]] = True
    places = np.flatnonzero(edge)
    starts, ends = places[:-1], places[1:]
    keep = inside[starts] if n else np.zeros(0, bool)
    return starts[keep], ends[keep]


_known_powers: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """At least ``n`` powers of the base and of its inverse; kept while they are of the usual size."""
    if _known_powers and len(_known_powers[0]) >= n:
        return _known_powers
    found = []
    for base in (_BASE, _INVERSE):
        power = np.full(max(n, RANGE_BYTES) + 1, base, np.uint64)
        power[0] = 1
        found.append(np.multiply.accumulate(power, out=power))
    if n <= 2 * RANGE_BYTES:
        _known_powers[:] = found
    return found


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; ranges ascend and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + RANGE_BYTES, side="right")))
        low, high = int(starts[i]), int(ends[j - 1])
        power, back = _powers(high - low)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_VALUES[data[low:high]] * power[: high - low], out=total[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64))
        i = j
    return out


@dataclass
class Words:
    """Words of a batch: byte range and hash of each, and ``first[d]:first[d + 1]`` for text ``d``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int) -> bytes:
        return LOWER[self.data[self.starts[i] : self.ends[i]]].tobytes()


def words_of(texts: pa.Array) -> Words:
    data, places = buffers(texts)
    starts, ends = runs(IS_WORD[data], places)
    return Words(data, starts, ends, hash_runs(data, starts, ends), np.searchsorted(starts, places))


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of ``width`` words that lies within one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * np.uint64(_BASE) + hashes[k : k + n]
    inside = np.ones(n, bool)
    for k in range(1, width):  # a text that begins after the first word ends the window
        marks = first[(first >= k) & (first - k < n)] - k
        inside[marks] = False
    at = np.flatnonzero(inside)
    return mix(total[at]), at


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or of one longer text."""
    for batch in batches:
        texts = batch.column(column).cast(pa.large_string()).fill_null("")
        n = len(texts)
        if n == 0:
            continue
        places = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(places, places[i] + limit, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j

"""Counts of the topic words and phrases of texts, over Arrow batches of whole units.

Spark brings the texts to their partitions, orders them by unit and cuts them into sentences, chunks and words;
here a slice of units is counted as a whole: words are numbers of a dictionary, and each grouping is one sort of
numbers.  So no row per word is ever made.  The rows of a unit that has several are counted together.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sitemill.functions import text as X
from sitemill.operators.tokens import MIN_WORD, by_unit, stop_words

#: Words of the units that are counted at once; a longer unit is a slice of its own.
SLICE_WORDS = 1 << 19


def over_units(texts: DataFrame, count: Callable[..., list], fields: str, *held: str) -> DataFrame:
    """``unit`` and the ``fields`` that ``count`` finds in slices of whole units of ``(unit, text)``.

    ``count`` is given the units of the rows, their words, and the columns ``held``.
    """
    listed = F.transform(X.sentences(F.col("text")), lambda s: F.transform(X.chunks(s), X.chunk_words))
    cut = by_unit(texts, *held).sortWithinPartitions("unit").select("unit", listed.alias("words"), *held)
    added = StructType.fromDDL(fields)
    names = ["unit", *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, numbers in _slices(batches):
            beside = [rows.column(c) for c in held]
            yield pa.RecordBatch.from_arrays(count(rows.column("unit"), Words(numbers, rows.column("words")), *beside), names)

    return cut.mapInArrow(run, StructType([StructField("unit", cut.schema["unit"].dataType), *added.fields]))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of whole units, and the number of each row's unit; the last unit of a batch waits for the next one."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        units = batch.column("unit").to_pylist()
        last = len(units) - 1
        while last > 0 and units[last] == units[last - 1]:
            last -= 1
        yield from _parts(batch.slice(0, last), units[:last])
        held = batch.slice(last)
    if held is not None:
        yield from _parts(held, held.column("unit").to_pylist())


def _parts(rows: pa.RecordBatch, units: list) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    if not units:
        return
    number = np.cumsum([0] + [units[i] != units[i - 1] for i in range(1, len(units))])
    words = list_sizes(rows.column("words"), 3)
    ends = np.flatnonzero(np.append(number[1:] != number[:-1], True)) + 1
    total, begin = np.append(0, np.cumsum(words)), 0
    while begin < len(units):
        fit = int(np.searchsorted(total[ends], total[begin] + SLICE_WORDS, side="right")) - 1
        first = int(np.searchsorted(ends, begin, side="right"))
        end = int(ends[max(fit, first)])
        yield rows.slice(begin, end - begin), number[begin:end] - number[begin]
        begin = end


def list_sizes(lists: pa.Array, depth: int) -> np.ndarray:
    """How many entries each list has at a depth."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if depth == 1:
        return sizes
    inner = np.append(0, np.cumsum(list_sizes(lists.flatten(), depth - 1)))
    ends = np.cumsum(sizes)
    return inner[ends] - inner[ends - sizes]


def list_starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def owner(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """List and place of each entry of lists of these sizes."""
    lists = np.repeat(np.arange(len(sizes)), sizes)
    return lists, np.arange(len(lists)) - list_starts(sizes)[lists]


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by key, and where each group begins in it."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    return order, np.flatnonzero(np.append(len(keys) > 0, keys[1:] != keys[:-1]))


class Words:
    """All words of a slice, those with a topic in the order of unit, sentence, chunk and place.

    ``unit``, ``sentence``, ``chunk``, ``place``, ``term``, ``before``, ``after``, ``second`` (the word after the
    next), ``shouted``, ``capital`` and ``n_sentences`` are arrays over the topic words; words are numbers in
    ``terms``, -1 where the chunk has none.
    """

    def __init__(self, number: np.ndarray, listed: pa.Array):
        self.number = number
        self.n_units = int(number[-1]) + 1
        sentences = listed.flatten()
        chunks = sentences.flatten()
        self.flat = chunks.flatten()
        self.sizes = [list_sizes(x, 1) for x in (listed, sentences, chunks)]
        self.starts = [list_starts(x) for x in self.sizes]
        chunk, place = owner(self.sizes[2])
        sentence, chunk_place = (x[chunk] for x in owner(self.sizes[1]))
        row, sentence_place = (x[sentence] for x in owner(self.sizes[0]))
        coded = self.flat.dictionary_encode()
        shown = coded.dictionary.to_pylist()
        numbers: dict[str, int] = {}
        term_of = np.array([numbers.setdefault(w.lower(), len(numbers)) for w in shown], np.int64)
        stop = set(stop_words())
        weak = np.array([len(t) < MIN_WORD or t in stop or not any(c.isalpha() for c in t) for t in numbers], bool)
        shouted = np.array([len(w) > 1 and w == w.upper() for w in shown], bool)
        capital = np.array([w != "" and unicodedata.category(w[0]) == "Lu" for w in shown], bool)
        self.terms = pa.array(numbers, pa.string())
        self.n_terms = max(1, len(numbers))
        code = coded.indices.to_numpy(zero_copy_only=False)
        term = term_of[code] if len(code) else np.zeros(0, np.int64)
        left = self.sizes[2][chunk] - place
        topic = np.flatnonzero(~weak[term]) if len(term) else np.zeros(0, np.int64)
        if self.n_units < len(number):
            keys = place, chunk_place, sentence_place, number[row]
            topic = topic[np.lexsort([k[topic] for k in keys])]
        self.unit, self.sentence, self.chunk, self.place = (x[topic] for x in (number[row], sentence_place, chunk_place, place))
        self.term = term[topic]
        near = np.append(term, [-1, -1])
        self.before = np.where(self.place > 0, near[topic - 1], -1)
        self.after = np.where(left[topic] > 1, near[topic + 1], -1)
        self.second = np.where(left[topic] > 2, near[topic + 2], -1)
        self.shouted = shouted[code[topic]] if len(topic) else np.zeros(0, bool)
        self.capital = capital[code[topic]] & ((self.chunk > 0) | (self.place > 0)) if len(topic) else np.zeros(0, bool)
        self.n_sentences = self.sizes[0][row[topic]]

    def as_written(self, row: int, sentence: int, chunk: int, place: int, size: int) -> str | None:
        """Words of a row at a place, joined; null where the row has no such chunk."""
        spot = row
        for n, (sizes, starts) in zip((sentence, chunk), zip(self.sizes, self.starts, strict=True), strict=False):
            if n >= sizes[spot]:
                return None
            spot = starts[spot] + n
        first = self.starts[2][spot] + place
        end = min(first + size, self.starts[2][spot] + self.sizes[2][spot])
        return " ".join(self.flat.slice(first, max(0, end - first)).to_pylist())


@dataclass
class Terms:
    """One row per unit and term, and the row ``of`` each topic word."""

    words: Words
    of: np.ndarray
    unit: np.ndarray
    term: np.ndarray
    columns: dict[str, np.ndarray]
    #: Sentences of the mentions, in order, and where each term's begin.
    sentences: np.ndarray
    first: np.ndarray

    def near(self, side: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ``(row, neighbour)`` on one side, ordered."""
        words = getattr(self.words, side)
        found = np.unique((self.of * self.words.n_terms + words)[words >= 0])
        return found // self.words.n_terms, found % self.words.n_terms


def term_counts(words: Words) -> Terms:
    """``tf, shouted, capital, in_sentences, middle, n_left, n_right, n_sentences`` of each unit and term."""
    order, first = grouped(words.unit * words.n_terms + words.term)
    size = len(order)
    tf = np.diff(np.append(first, size))
    of = np.empty(size, np.int64)
    of[order] = np.repeat(np.arange(len(first)), tf)
    sentences = words.sentence[order]
    fresh = np.append(size > 0, sentences[1:] != sentences[:-1])[:size]
    fresh[first] = True

    def counted(mask: np.ndarray) -> np.ndarray:
        return np.bincount(of[mask], minlength=len(first))

    def folded(how: np.ufunc, values: np.ndarray) -> np.ndarray:
        return how.reduceat(values, first) if size else np.zeros(0, np.int64)

    columns = {
        "tf": tf,
        "shouted": counted(words.shouted),
        "capital": counted(words.capital),
        "in_sentences": folded(np.add, fresh.astype(np.int64)),
        "middle": (sentences[first + (tf - 1) // 2] + sentences[first + tf // 2]) / 2,
        "n_left": counted(words.before >= 0),
        "n_right": counted(words.after >= 0),
        "n_sentences": folded(np.maximum, words.n_sentences[order]),
    }
    return Terms(words, of, words.unit[order][first], words.term[order][first], columns, sentences, first)

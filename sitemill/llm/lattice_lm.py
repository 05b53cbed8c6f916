"""Scores of texts under a subword lattice: every way to cut a word into pieces adds to its probability.

The pieces are those of a public vocabulary file; the file is never changed.  A text is the sequence of its
words, each behind one blank, and an end mark.  A piece is drawn again and again, independently, until the end
mark, so a text has the probability of all piece sequences that spell it, summed.  Pieces never reach over a
blank, hence that sum is a product over words, and each distinct word of the corpus is worked on once: a
forward recursion in log space over the word's bytes.  Every single byte is a piece, so no word is impossible.

The vocabulary's own scores (ranks) give the first weights of the pieces; ``ROUNDS`` rounds of expected counts
(forward and backward sums) over all words of the training texts fit them.  Rounds run on the word table in
Spark; only one number per piece of the vocabulary comes back to the driver.

Texts are encoded once, in slices of bounded size: the distinct words of a slice are rows, its documents hold
numbers of these words.  Words are counted and scored by word, and their numbers go back to the slice, so what
is shuffled is one row per slice and distinct word, never one per token.

Defined results: null and empty texts have the end mark only.  A row without doc_id is not held out and is
learned from; repeated rows are separate texts.  Without any training text every weight stays the first one
and all base counts are 0.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from public_tokenizers import path
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill.llm import words as W
from sitemill.llm.components import sorted_tiles
from sitemill.llm.frames import cut
from sitemill.workspace import stage

VOCABULARY = "piece_bpe_32k.model"
ROUNDS = 3
#: Rank that is added before the first weights are taken as its inverse, and the count every piece starts from.
RANK_SHIFT, LEAST = 50.0, 0.01
#: Bytes of text whose distinct words make up a slice, and word bytes that one lattice batch holds.
TEXT_SLICE, BATCH_BYTES = 12 << 20, 1 << 19
#: Rows of word numbers that are packed at once.
PACKED = 1 << 20
#: Words of more bytes go through the recursion one by one.
LONG = 512
FORWARD_BITS = 20
#: A place has room for 2^20 partitions, slices of a partition, and words of a slice.
SLICE_BITS, WORD_BITS = 13, 30

_codes = np.arange(256)
_IN_WORD = ~(((_codes >= 9) & (_codes <= 13)) | (_codes == 32))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240811).integers(1, 1 << 63, 256, dtype=np.uint64)


def _prefixes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which the hash of any range follows: (sums[e] - sums[s]) * back[s]."""
    power = np.full(len(data) + 1, _BASE, np.uint64)
    back = np.full(len(data) + 1, _INVERSE, np.uint64)
    power[0] = back[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(back, out=back)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * power[:-1], out=sums[1:])
    return sums, back


class Pieces:
    """The distinct byte strings of a vocabulary file that can occur in lower-cased words, with first weights."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path(vocabulary))
        ranks = {bytes([b]): float(model.get_piece_size()) for b in range(256)}
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i):
                continue
            text = model.id_to_piece(i).replace("▁", " ").encode()
            if text.rfind(b" ") < 1 and not any(65 <= b <= 90 for b in text):
                ranks[text] = min(ranks.get(text, math.inf), -model.get_score(i))
        self.texts = sorted(ranks)
        weight = 1.0 / (RANK_SHIFT + np.array([ranks[t] for t in self.texts]))
        #: Natural logarithms of the weights; the end mark is the last entry.
        self.first = np.log(np.append(weight, weight.mean()) / (weight.sum() + weight.mean()))
        size = np.array([len(t) for t in self.texts])
        sums, back = _prefixes(np.frombuffer(b"".join(self.texts), np.uint8))
        stops = np.cumsum(size)
        keys = W.mix((sums[stops] - sums[stops - size]) * back[stops - size] + size.astype(np.uint64))
        order = np.argsort(keys)
        self.keys, self.number = keys[order], order
        self.sizes = sorted(set(size.tolist()))
        self.maybe = np.zeros(1 << FORWARD_BITS, bool)
        self.maybe[keys >> np.uint64(64 - FORWARD_BITS)] = True

    def found(self, data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, size and number of every piece in the bytes; ``left`` is how far each byte's word still goes."""
        sums, back = _prefixes(data)
        starts, sizes, numbers = [], [], []
        at = np.arange(len(data))
        for size in self.sizes:
            at = at[left[at] >= size]
            if len(at) == 0:
                break
            keys = W.mix((sums[at + size] - sums[at]) * back[at] + np.uint64(size))
            likely = np.flatnonzero(self.maybe[keys >> np.uint64(64 - FORWARD_BITS)])
            place = np.minimum(np.searchsorted(self.keys, keys[likely]), len(self.keys) - 1)
            hit = self.keys[place] == keys[likely]
            starts.append(at[likely[hit]])
            numbers.append(self.number[place[hit]])
            sizes.append(np.full(len(starts[-1]), size))
        return np.concatenate(starts), np.concatenate(sizes), np.concatenate(numbers)


@cache
def pieces(vocabulary: str = VOCABULARY) -> Pieces:
    return Pieces(vocabulary)


def _sums(word: np.ndarray, begin: np.ndarray, end: np.ndarray, score: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Log sums over all paths from place 0 to each place of each word; word w has places w*width .. + size[w].

    Steps are pieces ``begin -> end`` of a word; every place has at least one step that ends there.
    """
    width = int(size.max()) + 1
    out = np.zeros(len(size) * width)
    base = word * width
    order = np.lexsort((word, end))
    base, begin, end, score = base[order], begin[order], end[order], score[order]
    if len(size) == 1 and width > LONG:
        return _sums_of_one(begin.tolist(), end.tolist(), score.tolist(), width)
    stops = np.searchsorted(end, np.arange(1, width + 1))
    for e in range(1, width):
        i, j = stops[e - 1], stops[e]
        if i == j:
            continue
        x = out[base[i:j] + begin[i:j]] + score[i:j]
        first = np.flatnonzero(np.append(True, base[i + 1 : j] != base[i : j - 1]))
        most = np.maximum.reduceat(x, first)
        total = np.add.reduceat(np.exp(x - np.repeat(most, np.diff(np.append(first, j - i)))), first)
        out[base[i:j][first] + e] = most + np.log(total)
    return out


def _sums_of_one(begin: list[int], end: list[int], score: list[float], width: int) -> np.ndarray:
    out = [0.0] * width
    i = 0
    for e in range(1, width):
        x = []
        while i < len(end) and end[i] == e:
            x.append(out[begin[i]] + score[i])
            i += 1
        most = max(x)
        out[e] = most + math.log(math.fsum(math.exp(v - most) for v in x))
    return np.array(out)


class Lattice:
    """Words of a batch with all pieces in them."""

    def __init__(self, known: Pieces, texts: pa.Array):
        data, places = W.buffers(texts)
        n = len(texts)
        self.size = np.diff(places) + 1
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        whole = np.insert(data, places[:-1], 32)  # the blank in front of each word
        word = np.repeat(np.arange(n), self.size)
        left = (self.start + self.size)[word] - np.arange(len(whole))
        at, size, self.piece = known.found(whole, left)
        self.word = word[at]
        self.begin = at - self.start[self.word]
        self.end = self.begin + size

    def forward(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log sums at all places, and the log probability of each word."""
        sums = _sums(self.word, self.begin, self.end, weights[self.piece], self.size)
        width = int(self.size.max()) + 1
        return sums, sums[np.arange(len(self.size)) * width + self.size]

    def expected(self, weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is used in all segmentations, by their probability; words come ``counts`` times."""
        width = int(self.size.max()) + 1
        ahead, total = self.forward(weights)
        own = self.size[self.word]
        behind = _sums(self.word, own - self.end, own - self.begin, weights[self.piece], self.size)
        base = self.word * width
        share = ahead[base + self.begin] + weights[self.piece] + behind[base + own - self.end] - total[self.word]
        return np.bincount(self.piece, np.exp(share) * counts[self.word], len(weights))


def _batches(texts: pa.Array) -> Iterator[np.ndarray]:
    """Row numbers of words in batches of alike sizes and bounded bytes."""
    size = np.diff(W.buffers(texts)[1]) + 1
    order = np.argsort(size, kind="stable")
    ordered = size[order]
    i = 0
    while i < len(order):
        if ordered[i] >= LONG:
            j = i + 1
        else:
            most = BATCH_BYTES // max(int(ordered[min(len(ordered) - 1, i + 4096)]), 16)
            j = min(len(order), i + max(1, most), int(np.searchsorted(ordered, LONG)))
        yield order[i:j]
        i = j


def expected_counts(counted: DataFrame, weights: np.ndarray, vocabulary: str = VOCABULARY) -> np.ndarray:
    """One round over ``word, c``: the expected number of uses of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = pieces(vocabulary), np.zeros(len(weights))
        for batch in batches:
            counts = batch.column("c").to_numpy().astype(float)
            for rows in _batches(batch.column("word")):
                total += Lattice(known, batch.column("word").take(pa.array(rows))).expected(weights, counts[rows])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["piece", "uses"])

    rows = counted.select("word", "c").mapInArrow(run, "piece int, uses double")
    out = np.zeros(len(weights))
    for row in rows.groupBy("piece").agg(F.sum("uses").alias("uses")).collect():  # one row per piece at most
        out[row["piece"]] = row["uses"]
    return out


def fit(counted: DataFrame, ends: int, rounds: int = ROUNDS, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Log weights of all pieces and of the end mark from the training words ``word, c`` and texts' number."""
    weights = pieces(vocabulary).first
    if ends == 0:
        return weights
    for _ in range(rounds):
        uses = expected_counts(counted, weights, vocabulary)
        uses[-1] = ends
        weights = np.log((uses + LEAST) / (uses + LEAST).sum())
    return weights


def word_scores(words: DataFrame, weights: np.ndarray, vocabulary: str = VOCABULARY) -> DataFrame:
    """``word, c`` with ``logp``: the decimal logarithm of the sum over all segmentations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(vocabulary)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for rows in _batches(batch.column("word")):
                out[rows] = Lattice(known, batch.column("word").take(pa.array(rows))).forward(weights)[1] / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "logp"])

    return words.select("word", "c").mapInArrow(run, "word string, c long, logp double")


def encoded(docs: DataFrame, text_slice: int = TEXT_SLICE) -> DataFrame:
    """Rows of two kinds: ``place, word, c`` (its uses in training texts) and ``slice, doc_id, held_out, n, ids``.

    A place is the slice and, in the low ``WORD_BITS``, the word's number in it.  ``ids`` has the numbers of a
    document's ``n`` words as little-endian integers, of three bytes unless the slice needs four.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    schema = "place long, word string, c long, slice long, doc_id long, held_out boolean, n int, ids binary"
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
    names = [f.split()[0] for f in schema.split(", ")]

    def out(size: int, **given) -> pa.RecordBatch:
        arrays = [given[n].cast(t) if n in given else pa.nulls(size, t) for n, t in zip(names, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << SLICE_BITS
        for batch in batches:
            for i, j in cut(batch.column("text"), text_slice):
                part, number = batch.slice(i, j - i), number + 1
                data, places = W.buffers(part.column("text"))
                starts, ends = W.runs(_IN_WORD[data], places)
                keys = W.mix(W.hash_runs(data, starts, ends) ^ (ends - starts).astype(np.uint64))
                distinct, first, which = W.distinct_of(keys)
                begin = np.searchsorted(starts, places)
                taught = ~np.asarray(part.column("held_out").to_numpy(zero_copy_only=False), bool)
                counts = np.bincount(which[np.repeat(taught, np.diff(begin))], minlength=len(distinct))
                a, b = starts[first], ends[first]
                offsets = np.concatenate([[0], np.cumsum(b - a)])
                flat = W.LOWER[data[np.repeat(a - offsets[:-1], b - a) + np.arange(offsets[-1])]]
                words = pa.LargeStringArray.from_buffers(len(a), pa.py_buffer(offsets), pa.py_buffer(flat.tobytes()))
                for k in range(0, len(a), 1 << 16):
                    stop = min(len(a), k + (1 << 16))
                    yield out(stop - k, place=pa.array((number << WORD_BITS) + np.arange(k, stop)), word=words[k:stop], c=pa.array(counts[k:stop]))
                width = 3 if len(a) <= 1 << 24 else 4
                cells = np.ascontiguousarray(which.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width])
                ids = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((begin * width).astype(np.int32)), pa.py_buffer(cells)])
                yield out(part.num_rows, slice=pa.array(np.full(part.num_rows, number)), doc_id=part.column("doc_id"), held_out=part.column("held_out"), n=pa.array(np.diff(begin)), ids=ids)

    return rows.mapInArrow(run, schema)


def _packed(rows: DataFrame) -> DataFrame:
    """``slice, numbers``: word numbers, counts and scores of ``place, c, logp`` rows, one row per slice and stretch."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        place = table.column("place").to_numpy()
        order = np.argsort(place)
        place = place[order]
        count, logp = (table.column(c).to_numpy()[order] for c in ("c", "logp"))
        slices = place >> WORD_BITS
        cuts = np.append(np.flatnonzero(np.append(True, slices[1:] != slices[:-1])), len(place))
        binary = [
            (place[a:b] & ((1 << WORD_BITS) - 1)).astype("<u4").tobytes() + count[a:b].astype("<i8").tobytes() + logp[a:b].astype("<f8").tobytes()
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)
        ]
        return pa.RecordBatch.from_arrays([pa.array(slices[cuts[:-1]]), pa.array(binary, pa.binary())], ["slice", "numbers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= PACKED:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    return rows.select("place", "c", "logp").mapInArrow(run, "slice long, numbers binary")


def _summed(rows: DataFrame, bottom: float) -> DataFrame:
    """Sums per document; of each slice the words' numbers come first, and then its documents."""
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, logp double"

    def numbers(packed: list[bytes]) -> list[np.ndarray]:
        size = [len(p) // 20 for p in packed]
        at = np.concatenate([np.frombuffer(p, "<u4", n) for p, n in zip(packed, size, strict=True)])
        count, logp = np.empty(len(at), np.int64), np.empty(len(at))
        count[at] = np.concatenate([np.frombuffer(p, "<i8", n, 4 * n) for p, n in zip(packed, size, strict=True)])
        logp[at] = np.concatenate([np.frombuffer(p, "<f8", n, 12 * n) for p, n in zip(packed, size, strict=True)])
        return [(count > 0).astype(float), np.log10((count + 0.1) / bottom), logp]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, packed, values = None, [], None
        for batch in batches:
            slices = batch.column("slice").to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, slices[1:] != slices[:-1])), len(slices)) if len(slices) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held != slices[a]:
                    held, packed, values = slices[a], [], None
                part = batch.slice(a, b - a)
                packed += [p for p in part.column("numbers").to_pylist() if p is not None]
                part = part.filter(part.column("ids").is_valid())
                if part.num_rows == 0:
                    continue
                if values is None:
                    values, packed = numbers(packed) if packed else [np.zeros(0)] * 3, []
                sizes = part.column("n").to_numpy()
                cells = np.frombuffer(b"".join(part.column("ids").to_pylist()), np.uint8)
                cells = cells.reshape(-1, len(cells) // max(1, int(sizes.sum())) or 4)
                flat = np.pad(cells, ((0, 0), (0, 4 - cells.shape[1]))).view("<u4").ravel()
                doc = np.repeat(np.arange(part.num_rows), sizes)
                sums = [np.bincount(doc, v[flat], part.num_rows).astype(float) for v in values]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(sizes.astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                    [f.split()[0] for f in schema.split(", ")],
                )

    return rows.mapInArrow(run, schema)


def scores(docs: DataFrame, rounds: int = ROUNDS, vocabulary: str = VOCABULARY, text_slice: int = TEXT_SLICE) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per document."""
    rows = stage(encoded(docs, text_slice), "encoded-texts")
    placed = rows.where("word IS NOT NULL").select("place", "word", "c")
    texts = rows.where("word IS NULL").select("slice", "doc_id", "held_out", "n", "ids")
    words = stage(placed.groupBy("word").agg(F.sum("c").alias("c")), "words")
    taught = words.where("c > 0")
    sums = taught.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = texts.where(~F.col("held_out")).count()
    total, distinct = sums["n"] + ends, sums["v"] + (ends > 0)
    weights = fit(taught, ends, rounds, vocabulary)
    known = stage(word_scores(words, weights, vocabulary), "word-scores")
    bottom = total + 0.1 * (distinct + 1)
    numbers = _packed(placed.select("place", "word").join(known, "word"))
    both = numbers.unionByName(texts, allowMissingColumns=True)
    found = _summed(sorted_tiles(both.withColumn("text", F.col("numbers").isNull()), "slice", then=("text",)), bottom)
    end_base, end_score = math.log10((ends + 0.1) / bottom), float(weights[-1] / math.log(10))
    return found.select(
        "doc_id",
        "held_out",
        (F.col("n_tokens") + 1).alias("n_tokens"),
        (F.col("n_known") + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(end_base)).alias("base_score"),
        (F.col("logp") + F.lit(end_score)).alias("score"),
    )

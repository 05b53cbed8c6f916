"""Token-id files: an adaptive context-mixing range coder in independent, checksummed blocks.

A block holds the ids of whole documents.  Its ids are cut into lanes of equal length that are coded side by
side: step t codes the t-th id of every lane, so each step is a few array operations.  All lanes share one
adaptive model, which starts afresh in every block:

* order 2 and order 1: tables that remember which id last followed the two or one ids before, and how
  often in a row that held;
* order 0: counts of all ids so far.

The three are mixed by weights that adapt too: for each pair of confidences the model counts whether the
order-2 guess, the order-1 guess or neither was right.  That choice is coded first; if neither was right the
id is coded by the order-0 counts.  A range coder with 64-bit state and carries turns the choices into words
of 32 bits, one stream per lane.

Block layout, little-endian: magic ``MIX1``, counts of documents, ids and lanes (u32 each), crc32 of the
ids, document sizes (u32), words per lane (u32), the words of all lanes.  ``decode`` checks the crc.

Defined results: a null or empty text is the end id alone.  A null doc_id sorts first and is read back as null.
Rows that repeat a doc_id are documents of their own, in no stated order among each other.  Only ``doc_id`` and
``text`` are read, so other columns may have any name.  A document is never divided, so a very long one makes a
longer block.  An empty table gives files without rows and an empty result.  Ids from 65,536 on are refused with
an error, as are blocks that are cut short or fail their checksum.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitemill.llm.frames import cut
from sitemill.llm.tokens import END_ID, VOCABULARY, encoder, with_end
from sitemill.workspace import stage

MAGIC = b"MIX1"
#: Ids after which a block is closed at the end of a document, steps of one lane, and ids of the alphabet.
BLOCK_IDS, LANE_STEPS, ALPHABET = 1 << 20, 256, 1 << 16
#: Slots of the context tables, and the largest confidence.
SLOTS, SURE = 1 << 18, 3
#: Steps between two refreshes of the cumulative order-0 counts.
REFRESH = 4

_U = np.uint64
_LOW32 = _U(0xFFFFFFFF)
_FULL = _U(1 << 32)


class Model:
    """The adaptive state that coder and decoder run through in the same way.

    An entry of a context table is four times the remembered id plus its confidence.
    """

    def __init__(self, lanes: int):
        self.counts = np.ones(ALPHABET, np.int64)
        self.tables = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.choices = np.full(((SURE + 1) ** 2, 3), 8, np.int64)
        self.last, self.older = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self._refresh()

    def _refresh(self) -> None:
        self.cumulative = np.zeros(ALPHABET + 1, np.int64)
        np.cumsum(self.counts, out=self.cumulative[1:])
        self.fresh: list[np.ndarray] = []

    def look(self) -> None:
        """Guesses and choice probabilities for the next id of each lane."""
        one = self.last * 0x9E3779B1
        self.slots = ((one + self.older * 0x85EBCA77) >> 7) & (SLOTS - 1), (one >> 5) & (SLOTS - 1)
        self.entries = self.tables[0].take(self.slots[0]), self.tables[1].take(self.slots[1])
        self.high, self.mid = self.entries[0] >> 2, self.entries[1] >> 2
        self.context = ((self.entries[0] & SURE) << 2) | (self.entries[1] & SURE)
        edges = np.zeros((len(self.choices), 4), np.uint64)
        edges[:, 1:] = np.cumsum(self.choices, axis=1)
        self.edges, self.row = edges.ravel(), self.context << 2
        self.total = self.edges.take(self.row + 3)

    def bounds(self, choice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each choice among the counts of its context."""
        at = self.row + choice
        start = self.edges.take(at)
        return start, self.edges.take(at + 1) - start

    def learn(self, ids: np.ndarray, choice: np.ndarray) -> None:
        self.choices += np.bincount(self.context * 3 + choice, minlength=self.choices.size).reshape(self.choices.shape)
        large = self.choices.sum(axis=1) > (1 << 20)
        if large.any():
            self.choices[large] = (self.choices[large] + 1) // 2
        for table, slot, entry, guess in zip(self.tables, self.slots, self.entries, (self.high, self.mid), strict=True):
            sure = entry & SURE
            wrong = np.where(sure > 0, entry - 1, ids << 2)
            table[slot] = np.where(ids == guess, entry + (sure < SURE), wrong)
        self.fresh.append(ids)
        if len(self.fresh) == REFRESH:
            self.counts += 32 * np.bincount(np.concatenate(self.fresh), minlength=ALPHABET)
            self._refresh()
        self.last, self.older = ids.astype(np.int64), self.last

    def narrow(self, lanes: int) -> None:
        self.last, self.older = self.last[:lanes], self.older[:lanes]


class Coder:
    """One range coder per lane."""

    def __init__(self, lanes: int, room: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, np.iinfo(np.uint64).max, _U)
        self.words, self.used = np.zeros((lanes, room), np.uint32), np.zeros(lanes, np.int64)

    def put(self, lanes: np.ndarray | slice, start: np.ndarray, size: np.ndarray, total: np.ndarray | int) -> None:
        part = self.range[lanes] // np.asarray(total, _U)
        low = self.low[lanes]
        moved = low + part * start.astype(_U, copy=False)
        carry = np.flatnonzero(moved < low)
        if len(carry):
            self._carry(np.arange(len(self.low))[lanes][carry])
        self.low[lanes], self.range[lanes] = moved, part * size.astype(_U, copy=False)
        short = np.flatnonzero(self.range < _FULL)
        if len(short):
            self._emit(short)

    def _emit(self, at: np.ndarray) -> None:
        self.words[at, self.used[at]] = (self.low[at] >> _U(32)).astype(np.uint32)
        self.used[at] += 1
        self.low[at] <<= _U(32)
        self.range[at] <<= _U(32)

    def _carry(self, at: np.ndarray) -> None:
        place = self.used[at] - 1
        while len(at):
            self.words[at, place] += np.uint32(1)
            over = self.words[at, place] == 0
            at, place = at[over], place[over] - 1

    def finish(self) -> None:
        everyone = np.arange(len(self.low))
        for _ in range(2):
            self._emit(everyone)


class Reader:
    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.words = np.concatenate([words, np.zeros(2, np.uint32)]).astype(_U)
        self.next = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.code = (self.words[self.next] << _U(32)) | self.words[self.next + 1]
        self.next += 2
        self.range = np.full(len(sizes), np.iinfo(np.uint64).max, _U)

    def value(self, lanes: np.ndarray | slice, total: np.ndarray | int) -> np.ndarray:
        total = np.asarray(total, _U)
        self.part = self.range[lanes] // total
        return np.minimum(self.code[lanes] // self.part, total - _U(1))

    def take(self, lanes: np.ndarray | slice, start: np.ndarray, size: np.ndarray) -> None:
        self.code[lanes] -= self.part * start.astype(_U, copy=False)
        self.range[lanes] = self.part * size.astype(_U, copy=False)
        short = np.flatnonzero(self.range < _FULL)
        if len(short):
            self.code[short] = (self.code[short] << _U(32)) | self.words[self.next[short]]
            self.next[short] += 1
            self.range[short] <<= _U(32)


def _lanes(n: int) -> np.ndarray:
    """Lane lengths, longest first, that differ by one at most."""
    lanes = max(1, -(-n // LANE_STEPS))
    return np.full(lanes, n // lanes) + (np.arange(lanes) < n % lanes)


def encode(ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """One block from the ids of some documents and their sizes."""
    ids = np.ascontiguousarray(ids, "<u4")
    n = len(ids)
    if n and int(ids.max()) >= ALPHABET:
        raise ValueError(f"ids must be below {ALPHABET}")
    steps = _lanes(n)
    begin = np.concatenate([[0], np.cumsum(steps)[:-1]])
    coder, model = Coder(len(steps), 2 * int(steps[0]) + 4), Model(len(steps))
    for t in range(int(steps[0])):
        lanes = int(np.searchsorted(-steps, -t))  # the lanes that have a t-th id
        model.narrow(lanes)
        now = ids[begin[:lanes] + t].astype(np.int32)
        model.look()
        choice = np.where(now == model.high, 0, np.where(now == model.mid, 1, 2))
        coder.put(slice(0, lanes), *model.bounds(choice), model.total)
        rest = np.flatnonzero(choice == 2)
        if len(rest):
            low = model.cumulative[now[rest]]
            coder.put(rest, low, model.cumulative[now[rest] + 1] - low, model.cumulative[-1])
        model.learn(now, choice)
    coder.finish()
    words = coder.words[np.arange(coder.words.shape[1]) < coder.used[:, None]]
    head = MAGIC + struct.pack("<IIII", len(sizes), n, len(steps), zlib.crc32(ids.tobytes()))
    return head + sizes.astype("<u4").tobytes() + coder.used.astype("<u4").tobytes() + words.astype("<u4").tobytes()


def decode(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and document sizes of a block; raises if it is damaged."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    docs, n, lanes_all, crc = struct.unpack_from("<IIII", block, 4)
    sizes = np.frombuffer(block, "<u4", docs, 20).astype(np.int64)
    used = np.frombuffer(block, "<u4", lanes_all, 20 + 4 * docs).astype(np.int64)
    words = np.frombuffer(block, "<u4", -1, 20 + 4 * (docs + lanes_all))
    if len(words) != used.sum() or sizes.sum() != n:
        raise ValueError("block of token ids is cut short")
    steps = _lanes(n)
    begin = np.concatenate([[0], np.cumsum(steps)[:-1]])
    ids = np.zeros(n, "<u4")
    reader, model = Reader(words, used), Model(len(steps))
    for t in range(int(steps[0])):
        lanes = int(np.searchsorted(-steps, -t))
        every = slice(0, lanes)
        model.narrow(lanes)
        model.look()
        value = reader.value(every, model.total)
        choice = (value >= model.edges.take(model.row + 1)).astype(np.int8) + (value >= model.edges.take(model.row + 2))
        reader.take(every, *model.bounds(choice))
        now = np.where(choice == 0, model.high, model.mid)
        rest = np.flatnonzero(choice == 2)
        if len(rest):
            value = reader.value(rest, model.cumulative[-1]).astype(np.int64)
            order = np.argsort(value)  # neighbours in the table are found faster one after another
            found = np.empty(len(value), np.int64)
            found[order] = np.searchsorted(model.cumulative, value[order], side="right") - 1
            low = model.cumulative[found]
            reader.take(rest, low, model.cumulative[found + 1] - low)
            now[rest] = found
        ids[begin[:lanes] + t] = now
        model.learn(now, choice)
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("block of token ids fails its checksum")
    return ids, sizes


BLOCK_FIELDS = "part int, block int, n_docs int, n_ids long, doc_ids binary, nulls binary, payload binary"


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Write the files: rows of blocks, in ascending order of doc_id over parts and blocks."""
    names = [f.split()[0] for f in BLOCK_FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        part, number, count = -1, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal number, count
            row = [
                part,
                number,
                len(keys),
                count,
                np.array([k or 0 for k in keys], "<i8").tobytes(),
                np.array([k is None for k in keys]).tobytes(),
                encode(np.concatenate(held), np.concatenate(sizes)),
            ]
            number, count = number + 1, 0
            keys.clear(), held.clear(), sizes.clear()
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            for i, j in cut(batch.column("text")):
                part = batch.column("part")[i].as_py()
                flat, begin = with_end(*encoder(vocabulary).encode(batch.column("text").slice(i, j - i)), end_id)
                ids = batch.column("doc_id").slice(i, j - i).to_pylist()
                at = 0
                while at < j - i:  # up to the document that fills the block
                    to = min(j - i, max(at + 1, int(np.searchsorted(begin, begin[at] + BLOCK_IDS - count))))
                    keys += ids[at:to]
                    held.append(flat[begin[at] : begin[to]])
                    sizes.append(np.diff(begin[at : to + 1]))
                    count += int(begin[to] - begin[at])
                    at = to
                    if count >= BLOCK_IDS:
                        yield close()
        if keys:
            yield close()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id")
    ordered = ranged.sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id())
    ordered.mapInArrow(run, BLOCK_FIELDS).write.parquet(path)


def read(spark, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and ``ids`` (little-endian binary) per document from the files."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("before", "n_docs", "doc_ids", "nulls", "payload")}
                ids, sizes = decode(row["payload"])
                places = np.concatenate([[0], np.cumsum(sizes)])
                raw = memoryview(ids.tobytes())
                parts = [raw[4 * a : 4 * b] for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
                columns = [
                    pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["nulls"], bool)),
                    pa.array(row["before"] + places[:-1]),
                    pa.array(sizes),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([bytes(p) for p in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    blocks = spark.read.parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n"))  # one row per file
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_part"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    index = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("_block"))
    starts = index.join(offsets, "part").select("part", "block", (F.col("_part") + F.col("_block")).alias("before"))
    return blocks.join(starts, ["part", "block"]).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    )

"""Hard negatives of anchors, read from Hilbert-ordered candidate blocks that zone maps choose.

Vectors become integers (256-fold, rounded down).  Candidates are range-sorted by label and by their place on a
Hilbert curve through all dimensions, so rows near each other in a file are near each other in space, and are
written to Parquet as blocks: one row per block with its packed vectors and, as columns of their own, the
smallest and largest value of each dimension.  Interval arithmetic on these zone maps bounds every inner product
of an anchor with a block's rows from both sides.

An anchor asks for the best rows of its own label, and then for the best rows of other labels in windows that
its positives' scores span.  Each question is put twice: first a few promising blocks are read, and the last of
the best scores found there is a lower bound; then exactly those blocks are read whose bounds reach both that
bound and the window.  So the answer is that of a full scan, whatever the first blocks were.

Anchors are cut into tiles in the order of the curve, zone maps into parts of a bounded number of blocks; a
group of the work is one tile with one part.  Only chosen blocks bring their rows to a tile.

Defined results: rows with a null vec_id, label or vector, an empty vector, or a null or non-finite component take
no part, nor do those with a component beyond ``MOST`` after scaling, whose products would leave 64 bits.  Of rows
that repeat a vec_id the one with the smallest label and vector counts.  Vectors of different length are never
compared.  Equal scores are in vec_id order.  Anchors without positives, windows without rows, and windows of
negative scores, which are empty, give no row.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitemill.operators.ranking import rank_within
from sitemill.workspace import new_path, stage

ANCHORS, RELABELLED, LABELS = 100, 7, 10
SCALE, MOST = 256, 1 << 26
POSITIVES, NEGATIVES = 5, 10
#: Rows of a block, anchors of a tile, blocks of a part, and promising blocks that a question reads first.
BLOCK, TILE, PART, PROMISING = 256, 1024, 512, 4
#: Bits of each dimension in the place on the curve, and scores held at once.
BITS, CELLS = 2, 4_000_000
GROUP_BYTES = 8 << 20  # of a Parquet row group
FAR = 1 << 62

_BLOCK = "block long, label long, dim int, rows int, ids binary, cells binary, lows array<int>, highs array<int>"


def candidates(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, dim, cells`` of the rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    small = F.forall("embedding", lambda x: (x * SCALE < MOST) & (x * SCALE >= -MOST))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & fine & small)
    cells = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % RELABELLED == 0, (label + 1) % LABELS).otherwise(label)
    once = rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(label.alias("label"), cells.alias("cells"))).alias("row"))
    return once.select("vec_id", "row.label", F.size("row.cells").alias("dim"), "row.cells")


def matrix(cells: pa.ChunkedArray, dim: int) -> np.ndarray:
    return cells.combine_chunks().flatten().to_numpy().reshape(-1, dim)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of integers, exact in 64 bits; in floating point while that is exact too."""
    if a.size and b.size and int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] >= 1 << 53:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return (a.astype(float) @ b.astype(float).T).astype(np.int64)


def bounds(anchors: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product that an anchor can have with any row of each block."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return product(up, lows) + product(down, highs), product(up, highs) + product(down, lows)


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve (packed big-endian bytes) of grid points with ``bits`` bits per dimension.

    Skilling's transform, one column of all points at a time (AIP Conf. Proc. 707, 2004).
    """
    x = grid.T.astype(np.uint32).copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        low = np.uint32((1 << bit) - 1)
        for i in range(n):
            set_here = (x[i] >> np.uint32(bit)) & np.uint32(1) == 1
            swapped = np.where(set_here, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(set_here, low, swapped).astype(np.uint32)
            if i:
                x[i] ^= swapped
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> np.uint32(bit)) & np.uint32(1) == 1, np.uint32((1 << bit) - 1), np.uint32(0))
    x ^= turn
    planes = [(x >> np.uint32(bit)) & np.uint32(1) for bit in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).astype(np.uint8), axis=0).T


def with_curve_keys(rows: DataFrame) -> DataFrame:
    """Add ``place``: where a row's vector lies on the curve; widest dimensions count first."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim, _, part in _by_dim(batches):
            cells = matrix(part.column("cells"), dim)
            low, high = found.get(dim, (cells[0], cells[0]))
            found[dim] = np.minimum(low, cells.min(axis=0)), np.maximum(high, cells.max(axis=0))
        for dim, (low, high) in found.items():
            slots = pa.array(np.arange(dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), slots, pa.array(low), pa.array(high)], ["dim", "slot", "low", "high"])

    parts = rows.select("dim", "cells").mapInArrow(ranges, "dim int, slot int, low int, high int")
    spans: dict[int, np.ndarray] = {}
    for r in parts.groupBy("dim", "slot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        spans.setdefault(r["dim"], np.zeros((2, r["dim"]), np.int64))[:, r["slot"]] = r["low"], r["high"]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, _, part in _by_dim(batches):
            low, high = spans[dim]
            order = np.argsort(low - high, kind="stable")
            cells = (matrix(part.column("cells"), dim) - low) * (1 << BITS) // (high - low + 1)
            packed = hilbert_keys(cells[:, order], BITS)
            place = pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1]), len(packed), [None, pa.py_buffer(np.ascontiguousarray(packed))])
            yield from part.append_column("place", place.cast(pa.binary())).combine_chunks().to_batches()

    return rows.mapInArrow(keys, "vec_id long, label long, dim int, cells array<int>, place binary")


def _by_dim(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.Table]]:
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in sorted(set(dims.tolist())):
            at = np.flatnonzero(dims == dim)
            yield dim, at, pa.Table.from_batches([batch]).take(pa.array(at))


def write_blocks(rows: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """The candidate blocks as a Parquet table; a block has rows of one label and length."""
    order = ["label", "dim", "place", "vec_id"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows == 0:
                continue
            label, dims, ids = (batch.column(c).to_numpy() for c in ("label", "dim", "vec_id"))
            starts = np.flatnonzero(np.append(True, (label[1:] != label[:-1]) | (dims[1:] != dims[:-1])))
            out: list[tuple] = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                for i in range(a, b, block):
                    j = min(b, i + block)
                    cells = batch.column("cells").slice(i, j - i).flatten().to_numpy().reshape(j - i, -1)
                    number += 1
                    out.append((number, int(label[i]), int(dims[i]), j - i, ids[i:j].astype("<i8").tobytes(), cells.astype("<i4").tobytes(), cells.min(axis=0).tolist(), cells.max(axis=0).tolist()))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in _BLOCK.split(", ")])

    ordered.select("vec_id", "label", "dim", "cells").mapInArrow(pack, _BLOCK).write.option("parquet.block.size", str(GROUP_BYTES)).parquet(path)
    return rows.sparkSession.read.schema(_BLOCK).parquet(path)


class Blocks:
    """Candidate blocks, tiles of anchors, and questions put to them."""

    def __init__(self, rows: DataFrame, path: str, block: int = BLOCK, tile: int = TILE, part: int = PART):
        placed = stage(with_curve_keys(rows), "placed-vectors")
        self.table = write_blocks(placed, path, block)
        self.zones = self.table.select("block", "label", "dim", "lows", "highs")
        ranked = rank_within(placed.where(F.col("vec_id") % ANCHORS == 0), ["dim"], ["place", "vec_id"])
        self.anchors = stage(ranked.select("dim", F.floor((F.col("position") - 1) / tile).cast("int").alias("tile"), "vec_id", "label", "cells"), "anchors")
        #: Per length of vectors: tiles and parts, from the counts of anchors and of blocks.
        self.tiles = {r["dim"]: -(-r["count"] // tile) for r in self.anchors.groupBy("dim").count().collect()}
        self.parts = {r["dim"]: -(-r["count"] // part) for r in self.zones.groupBy("dim").count().collect()}

    def _number(self, counts: dict[int, int]) -> Column:
        known = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair]) if counts else F.create_map(F.lit(0), F.lit(0))
        return F.coalesce(F.try_element_at(known, F.col("dim")), F.lit(0))

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("block"), F.greatest(self._number(self.parts), F.lit(1))).cast("int")

    def _asked(self, questions: DataFrame) -> DataFrame:
        """Questions in every part of the blocks of their length."""
        every = F.sequence(F.lit(0), self._number(self.parts) - 1)
        return questions.where(self._number(self.parts) > 0).withColumn("part", F.explode(every)).groupBy("dim", "tile", "part")

    def chosen(self, questions: DataFrame, same: bool, promising: int | None = None) -> DataFrame:
        """``dim, tile, part, block, asking``: blocks that some anchor of a tile must read, one bit per anchor.

        ``questions`` is ``dim, tile, vec_id, label, cells, lows, highs``, windows of scores.  With ``promising``
        each window takes so many blocks of a part only.
        """

        def choose(left: pa.Table, right: pa.Table) -> pa.Table:
            names, types = ["dim", "tile", "part", "block", "asking"], [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            if left.num_rows == 0 or right.num_rows == 0:
                return pa.table([pa.array([], t) for t in types], names)
            left = left.sort_by("vec_id")
            dim = left.column("dim")[0].as_py()
            least, most = bounds(matrix(left.column("cells"), dim), matrix(right.column("lows"), dim), matrix(right.column("highs"), dim))
            fits = (left.column("label").to_numpy()[:, None] == right.column("label").to_numpy()[None, :]) == same
            asking = np.zeros(fits.shape, bool)
            for low, high in _windows(left):
                reach = fits & (most >= low[:, None]) & (least <= high[:, None]) & (low <= high)[:, None]
                if promising is not None and promising < reach.shape[1]:
                    far = np.where(reach, -most if same else np.abs((least + most) // 2 - high[:, None]), FAR)
                    near = np.argpartition(far, promising - 1, axis=1)[:, :promising]
                    picked = np.zeros_like(reach)
                    np.put_along_axis(picked, near, True, axis=1)
                    reach &= picked
                asking |= reach
            at = np.flatnonzero(asking.any(axis=0))
            keys = [pa.array(np.full(len(at), left.column(c)[0].as_py(), np.int32)) for c in names[:3]]
            bits = np.packbits(asking[:, at].T, axis=1)
            return pa.table([*keys, right.column("block").take(pa.array(at)).combine_chunks(), pa.array([b.tobytes() for b in bits], pa.binary())], names)

        every = F.sequence(F.lit(0), self._number(self.tiles) - 1)
        zones = self.zones.where(self._number(self.tiles) > 0).withColumn("part", self._part()).withColumn("tile", F.explode(every))
        return self._asked(questions).cogroup(zones.groupBy("dim", "tile", "part")).applyInArrow(choose, "dim int, tile int, part int, block long, asking binary")

    def best(self, questions: DataFrame, same: bool, k: int, promising: int | None = None) -> DataFrame:
        """``anchor_id, window, vec_id, score, position``: the first ``k`` rows of each window, in the blocks chosen."""

        def read(left: pa.Table, right: pa.Table) -> pa.Table:
            names = ["anchor_id", "window", "vec_id", "score"]
            out: list[list[np.ndarray]] = [[], [], [], []]
            if left.num_rows and right.num_rows:
                left = left.sort_by("vec_id")
                dim, sizes = left.column("dim")[0].as_py(), right.column("rows").to_numpy()
                own_ids, own_labels, own = left.column("vec_id").to_numpy(), left.column("label").to_numpy(), matrix(left.column("cells"), dim)
                ids = np.frombuffer(b"".join(right.column("ids").to_pylist()), "<i8")
                cells = np.frombuffer(b"".join(right.column("cells").to_pylist()), "<i4").reshape(-1, dim)
                asking = np.frombuffer(b"".join(right.column("asking").to_pylist()), np.uint8).reshape(len(sizes), -1)
                asking = np.unpackbits(asking, axis=1, count=left.num_rows).astype(bool)
                order = np.argsort(ids)
                ids, cells, block = ids[order], cells[order], np.repeat(np.arange(len(sizes)), sizes)[order]
                labels, windows = right.column("label").to_numpy()[block], list(_windows(left))
                step = max(1, CELLS // max(1, len(ids)))
                for i in range(0, left.num_rows, step):
                    scores = product(own[i : i + step], cells)
                    for a in range(i, min(left.num_rows, i + step)):
                        fine = asking[block, a] & ((labels == own_labels[a]) == same) & (ids != own_ids[a])
                        at = np.flatnonzero(fine)
                        row = scores[a - i, at]
                        at = at[np.argsort(-row, kind="stable")]  # ids ascend, so ties do
                        falling = -scores[a - i, at]
                        for w, (low, high) in enumerate(windows):
                            first = np.searchsorted(falling, -high[a], side="left")
                            last = min(first + k, np.searchsorted(falling, -low[a], side="right"))
                            if first < last:
                                out[0].append(np.full(last - first, own_ids[a]))
                                out[1].append(np.full(last - first, w, np.int32))
                                out[2].append(ids[at[first:last]])
                                out[3].append(-falling[first:last])
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            return pa.table([pa.array(np.concatenate(c), t) if c else pa.array([], t) for c, t in zip(out, types, strict=True)], names)

        blocks = self.table.select("block", "label", "rows", "ids", "cells")
        chosen = self.chosen(questions, same, promising).join(blocks, "block")
        groups = self._asked(questions).cogroup(chosen.groupBy("dim", "tile", "part"))
        found = groups.applyInArrow(read, "anchor_id long, window int, vec_id long, score long")
        first = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("position", F.row_number().over(first)).where(F.col("position") <= k)

    def answers(self, questions: DataFrame, same: bool, k: int) -> DataFrame:
        """``best`` over all blocks that the windows need, raised by what the promising ones hold."""
        questions = stage(questions, "questions")
        kth = self.best(questions, same, k, PROMISING).where(F.col("position") == k)
        kth = kth.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
        raised = F.transform("lows", lambda x, w: F.greatest(x, F.coalesce(F.try_element_at("kth", w), x)))
        sharper = questions.join(kth, "vec_id", "left").withColumn("lows", raised).drop("kth")
        return stage(self.best(stage(sharper.select(questions.columns), "questions"), same, k), "answers")


def _windows(questions: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lower and upper ends of the first, second, ... window of all anchors; missing ones are empty."""
    lows, highs = questions.column("lows").to_pylist(), questions.column("highs").to_pylist()
    for w in range(max(map(len, lows))):
        yield tuple(np.array([x[w] if w < len(x) else none for x in side], np.int64) for side, none in ((lows, 1), (highs, 0)))


def hard_negatives(vectors: DataFrame, block: int = BLOCK, tile: int = TILE, part: int = PART) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    rows = stage(candidates(vectors.select("vec_id", "embedding", "label")), "candidates")
    blocks = Blocks(rows, new_path(vectors.sparkSession, "blocks"), block, tile, part)
    far = F.lit(FAR).cast("long")
    every = blocks.anchors.select("*", F.array(-far).alias("lows"), F.array(far).alias("highs"))
    positives = blocks.answers(every, True, POSITIVES)
    low = F.when(F.col("score") >= 0, F.expr("(3 * score + 9) div 10")).otherwise(F.lit(1))
    high = F.when(F.col("score") >= 0, F.expr("(9 * score) div 10")).otherwise(F.lit(0))
    listed = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.array_sort(F.collect_list(F.struct("position", low.alias("low"), high.alias("high")))).alias("w")
    )
    windows = blocks.anchors.join(listed, "vec_id").withColumn("lows", F.col("w.low")).withColumn("highs", F.col("w.high"))
    negatives = blocks.answers(windows.select(*blocks.anchors.columns, "lows", "highs"), False, NEGATIVES)
    of = positives.select("anchor_id", (F.col("position") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = negatives.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(of, ["anchor_id", "window"])
    return joined.select("anchor_id", "positive_id", F.col("position").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

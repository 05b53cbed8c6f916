"""Vectors of terms learned from a corpus, so that terms of like contexts are near whatever their letters.

Words are counted together within a window, the counts become positive pointwise mutual information, and the
strongest directions of that symmetric matrix are found by a randomised range finder (Halko, Martinsson and
Tropp, SIAM Review 53, 2011).  Counts and matrix are tables; a product of the matrix with a thin one is a join
of column blocks with their cells, added by row block.  What reaches the driver is the product of two thin
matrices, as many numbers as the square of the width.

Words seen fewer than ``LEAST`` times have no vector.  A text's vector is the sum of its words' vectors, each
weighted by the logarithm of its count, of unit length; it is zero for a text without known words.  The start is
drawn by a hash of the term, so equal corpora give equal scores up to rounding; the signs of directions are fixed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemill.functions import vectors as V
from sitemill.operators.ranking import rank_within
from sitemill.operators.word_counts import list_sizes, owner
from sitemill.workspace import freed, spread, stage, unstage

WINDOW, LEAST = 5, 5
#: Directions beyond those wanted, and products with the matrix that sharpen the start.
EXTRA, SHARPEN = 8, 2
#: Words whose pairs are counted at once, terms of a block at most, and cells of a block that meet it in one task.
SLICE_WORDS, BLOCK, CELLS = 500_000, 1 << 16, 2_000_000
#: Characters of texts whose words are looked up in one task.
TILE_CHARS = 16_000_000

_PIECE = "block int, piece int, rows binary, cells binary"
_PACKED = {"a": "<i4", "counts": "<i4", "b": "<i4", "x": "<f8"}
_CELLS = "block int, piece int, a binary, counts binary, b binary, x binary"


def word_counts(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """``term, n, id``: words seen ``least`` times, numbered from 0, the most frequent first."""
    counted = texts.select(F.explode(V.words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    known = counted.where(F.col("n") >= least).withColumn("rarity", -F.col("n"))
    return rank_within(known, [], ["rarity", "term"]).select("term", "n", (F.col("position") - 1).cast("int").alias("id"))


def cooccurrences(texts: DataFrame, words: DataFrame, window: int = WINDOW) -> DataFrame:
    """``a, b, n``: how often words (by id) stand within ``window`` places of each other in a text, both ways."""
    tiles = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tiles = max(tiles, -(-(texts.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) // TILE_CHARS))
    tile = F.pmod(F.xxhash64("unit"), F.lit(tiles)).cast("int").alias("tile")
    given = texts.select(tile, "unit", V.words(F.col("text")).alias("words"))
    spots = given.repartition(tiles, "tile").select("tile", F.explode("words").alias("term")).distinct()
    known = spots.join(words.select("term", "id"), "term").select(F.col("tile").alias("of_tile"), F.col("term").alias("word"), F.col("id").alias("number"))

    def count(places: np.ndarray, ids: np.ndarray, text: np.ndarray) -> pa.RecordBatch:
        keys = []
        for shift in range(1, window + 1):
            near = (text[shift:] == text[:-shift]) & (places[shift:] - places[:-shift] <= window)
            a, b = ids[:-shift][near].astype(np.int64), ids[shift:][near].astype(np.int64)
            keys.append(np.minimum(a, b) << 32 | np.maximum(a, b))
        pair, n = np.unique(np.concatenate(keys), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64())], ["pair", "n"])]
        if left.num_rows and right.num_rows:
            listed = left.column("words").combine_chunks()
            row, place = owner(list_sizes(listed, 1))
            units = pc.fill_null(left.column("unit").combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            at = pc.fill_null(pc.index_in(listed.flatten(), value_set=right.column("word").combine_chunks()), -1).to_numpy(zero_copy_only=False)
            kept = np.flatnonzero(at >= 0)
            ids = right.column("number").to_numpy()[at[kept].astype(np.int64)]
            unit, place = units[row[kept]], place[kept]
            if len(np.unique(units)) < len(units):
                order = np.lexsort((ids, place, unit))
                ids, unit, place = ids[order], unit[order], place[order]
            ends, begin = np.append(np.flatnonzero(unit[1:] != unit[:-1]) + 1, len(unit)), 0
            while begin < len(unit):  # whole units
                fit = max(int(np.searchsorted(ends, begin + SLICE_WORDS, side="right")) - 1, int(np.searchsorted(ends, begin, side="right")))
                part = slice(begin, int(ends[fit]))
                found.append(count(place[part], ids[part], unit[part]))
                begin = part.stop
        return pa.Table.from_batches(found)

    # Each pair once, whichever of its words comes first; the other way round it is made again on reading.
    counted = given.groupBy("tile").cogroup(known.groupBy("of_tile")).applyInArrow(run, "pair long, n long")
    once = stage(counted.groupBy("pair").agg(F.sum("n").alias("n")), "word-pairs")
    a, b = F.shiftright("pair", 32).cast("int"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int")
    once = once.select(a.alias("a"), b.alias("b"), F.when(a == b, 2 * F.col("n")).otherwise(F.col("n")).alias("n"))
    return both_ways(once, "a", "b")


def both_ways(pairs: DataFrame, one: str, other: str) -> DataFrame:
    """The rows of unordered pairs, and those of two different words the other way round too."""
    turned = [F.struct(F.col(x).alias(one), F.col(y).alias(other)) for x, y in ((one, other), (other, one))]
    ways = F.when(F.col(one) == F.col(other), F.array(turned[0])).otherwise(F.array(*turned))
    rest = [c for c in pairs.columns if c not in (one, other)]
    return pairs.select(F.explode(ways).alias("_way"), *rest).select(f"_way.{one}", f"_way.{other}", *rest)


def positive_pmi(pairs: DataFrame) -> DataFrame:
    """``a, b, n, x``: cells whose pointwise mutual information is positive."""
    sums = stage(pairs.groupBy("a").agg(F.sum("n").alias("of_a")), "pair-sums")
    total = sums.agg(F.coalesce(F.sum("of_a"), F.lit(0)).alias("n")).first()["n"]
    once = pairs.where("a <= b")  # the matrix is symmetric
    joined = once.join(sums, "a").join(sums.select(F.col("a").alias("b"), F.col("of_a").alias("of_b")), "b")
    x = F.log(F.col("n") * float(total) / (F.col("of_a").cast("double") * F.col("of_b")))
    return both_ways(joined.select("a", "b", "n", x.alias("x")).where("x > 0"), "a", "b")


def _matrix(binary: bytes, width: int) -> np.ndarray:
    return np.frombuffer(binary, "<f8").reshape(-1, width)


class Factors:
    """Products of a symmetric sparse matrix ``a, b, x`` of ``size`` rows with thin matrices.

    A thin matrix is a table of pieces: those rows of a block whose id leaves one remainder.
    """

    def __init__(self, cells: DataFrame, size: int, block: int | None = None, most: int = CELLS):
        n = cells.count()
        if block is None:
            # A product moves the thin matrix once per piece and once per block, so there are as many of both.
            block = max(1, min(BLOCK, -(-size // max(1, math.isqrt(n // most)))))
        self.size, self.block = size, block
        self.blocks = -(-size // block)
        self.pieces = max(1, -(-n // (self.blocks * most)))
        self.spark = cells.sparkSession
        rows = cells.select((F.col("b") / block).cast("int").alias("block"), F.pmod("a", F.lit(self.pieces)).cast("int").alias("piece"), "a", "b", "x")
        self.cells = stage(rows.groupBy("block", "piece").applyInArrow(_packed(block), _CELLS), "packed-cells")

    def start(self, width: int) -> DataFrame:
        """Signs drawn by a hash of the row number."""
        block, pieces, size = self.block, self.pieces, self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in batch.column("block").to_pylist():
                    ids = np.arange(b * block, min(size, (b + 1) * block), dtype=np.uint64)
                    keys = ids[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(width, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F)
                    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                        keys = (keys ^ keys >> np.uint64(shift)) * np.uint64(factor)
                    signs = np.where(keys >> np.uint64(63), 1.0, -1.0)
                    for piece in range(pieces):
                        mine = ids % np.uint64(pieces) == piece
                        yield _piece(b, piece, ids[mine].astype("<i4") - b * block, signs[mine])

        numbers = self.spark.range(self.blocks).select(F.col("id").cast("int").alias("block"))
        return stage(numbers.mapInArrow(run, _PIECE), "thin-matrix")

    def times(self, thin: DataFrame, width: int) -> DataFrame:
        """The matrix times a thin one."""
        block = self.block

        def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            if left.num_rows and right.num_rows:
                dense = np.zeros((block, width))
                for rows, cells in zip(right.column("rows").to_pylist(), right.column("cells").to_pylist(), strict=True):
                    dense[np.frombuffer(rows, "<i4")] = _matrix(cells, width)
                piece = left.column("piece")[0].as_py()
                found, counts, b, x = (np.concatenate([np.frombuffer(r, t) for r in left.column(c).to_pylist()]) for c, t in _PACKED.items())
                sums, stops = np.empty((len(found), width)), np.append(0, np.cumsum(counts))
                first = stops[:-1]
                step = max(1, (1 << 22) // width)
                i = 0
                while i < len(first):  # whole rows, a bounded number of cells at once
                    j = max(i + 1, int(np.searchsorted(stops, stops[i] + step, side="right")) - 1)
                    part = slice(stops[i], stops[j])
                    sums[i:j] = np.add.reduceat(x[part, None] * dense[b[part]], first[i:j] - stops[i], axis=0)
                    i = j
                for own in np.unique(found // block).tolist():
                    mine = found // block == own
                    out.append((own, piece, (found[mine] - own * block).astype("<i4").tobytes(), sums[mine].tobytes()))
            columns = zip(*out, strict=True) if out else [[]] * 4
            types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["block", "piece", "rows", "cells"])

        def add(parts: pa.Table) -> pa.Table:
            dense, seen = np.zeros((block, width)), np.zeros(block, bool)
            for rows, cells in zip(parts.column("rows").to_pylist(), parts.column("cells").to_pylist(), strict=True):
                at = np.frombuffer(rows, "<i4")
                dense[at] += _matrix(cells, width)
                seen[at] = True
            at = np.flatnonzero(seen)
            return pa.Table.from_batches([_piece(parts.column("block")[0].as_py(), parts.column("piece")[0].as_py(), at.astype("<i4"), dense[at])])

        every = F.sequence(F.lit(0), F.lit(self.pieces - 1))
        right = thin.select("block", F.explode(every).alias("piece"), "rows", "cells")
        parts = self.cells.groupBy("block", "piece").cogroup(right.groupBy("block", "piece")).applyInArrow(multiply, _PIECE)
        return stage(parts.groupBy("block", "piece").applyInArrow(add, _PIECE), "thin-matrix")

    def inner(self, one: DataFrame, other: DataFrame, width: int) -> np.ndarray:
        """The product of two thin matrices, one transposed."""

        def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
            total = np.zeros((width, width))
            for a in left.to_pylist():
                for b in right.to_pylist():
                    _, i, j = np.intersect1d(np.frombuffer(a["rows"], "<i4"), np.frombuffer(b["rows"], "<i4"), True, True)
                    total += _matrix(a["cells"], width)[i].T @ _matrix(b["cells"], width)[j]
            return pa.table([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["cell", "x"])

        other = other.select(*[F.col(c).alias(c) for c in other.columns])
        cells = one.groupBy("block", "piece").cogroup(other.groupBy("block", "piece")).applyInArrow(multiply, "cell long, x double")
        out = np.zeros(width * width)
        with freed(self.spark):
            for r in cells.groupBy("cell").agg(F.sum("x").alias("x")).collect():  # width squared rows
                out[r["cell"]] = r["x"]
        return out.reshape(width, width)

    def turned(self, thin: DataFrame, by: np.ndarray) -> DataFrame:
        """A thin matrix times a small one."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    yield _piece(r["block"], r["piece"], np.frombuffer(r["rows"], "<i4"), _matrix(r["cells"], len(by)) @ by)

        return thin.mapInArrow(run, _PIECE)

    def orthonormal(self, thin: DataFrame, width: int) -> tuple[DataFrame, int]:
        """Orthonormal columns of the same span, and how many there are."""
        values, directions = np.linalg.eigh(self.inner(thin, thin, width))
        good = values > 1e-12 * max(1e-300, values[-1])
        return stage(self.turned(thin, directions[:, good] / np.sqrt(values[good])), "thin-matrix"), int(good.sum())

    def strongest(self, dim: int, sharpen: int = SHARPEN) -> DataFrame | None:
        """``id, vector``: rows of the best approximation of rank ``dim``, each of unit length; null if all is zero."""
        width = min(self.size, dim + EXTRA)
        drawn = self.start(width)
        thin = self.times(drawn, width)
        unstage(drawn)
        for step in range(sharpen + 1):
            image = thin
            thin, width = self.orthonormal(image, width)
            unstage(image)
            if width == 0:
                return None
            image = self.times(thin, width)
            if step < sharpen:
                unstage(thin)
                thin = image
        small = self.inner(thin, image, width)
        unstage(image)
        values, directions = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-np.abs(values))[:dim]
        turn = np.zeros((width, dim))
        chosen = directions[:, order] * np.where(directions[:, order].sum(axis=0) < 0, -1, 1)
        turn[:, : len(order)] = chosen * np.sqrt(np.abs(values[order]))
        block = self.block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    cells = _matrix(r["cells"], dim)
                    length = np.sqrt((cells * cells).sum(axis=1, keepdims=True))
                    cells = cells / np.where(length > 0, length, 1)
                    ids = np.frombuffer(r["rows"], "<i4") + r["block"] * block
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dim), pa.array(cells.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), lists], ["id", "vector"])

        return self.turned(thin, turn).mapInArrow(run, "id int, vector array<double>")


def _packed(block: int):
    """Cells of a block and piece as one row: rows of the matrix, cells of each, their columns in the block, values."""

    def pack(cells: pa.Table) -> pa.Table:
        a, b, x = (cells.column(c).to_numpy() for c in ("a", "b", "x"))
        order = np.lexsort((b, a))
        a, b, x = a[order], b[order] % block, x[order]
        found, counts = np.unique(a, return_counts=True)
        values = [v.astype(t).tobytes() for v, t in zip((found, counts, b, x), _PACKED.values(), strict=True)]
        columns = [pa.array([cells.column(c)[0].as_py()], pa.int32()) for c in ("block", "piece")]
        return pa.table([*columns, *(pa.array([v], pa.binary()) for v in values)], ["block", "piece", *_PACKED])

    return pack


def _piece(block: int, piece: int, rows: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    values = [[block], [piece], [rows.astype("<i4").tobytes()], [np.ascontiguousarray(cells, "<f8").tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["block", "piece", "rows", "cells"])


def train(texts: DataFrame, dim: int = V.DIM, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """``term, n, vector`` of all words of ``(unit, text)`` that are frequent enough and share a window with others."""
    words = stage(word_counts(texts, least), "words")
    pairs = cooccurrences(texts, words, window)
    cells = stage(positive_pmi(pairs).select("a", "b", "x"), "pmi")
    unstage(pairs)
    size = words.count()
    found = None
    if size and not cells.isEmpty():
        factors = Factors(cells, size)
        unstage(cells)
        found = factors.strongest(dim)
        unstage(factors.cells)
    if found is None:
        return words.where("false").select("term", "n", F.array(F.lit(0.0)).alias("vector"))
    return stage(words.join(found, "id").select("term", "n", "vector"), "term-vectors")


def _sum(weighted: Column, dim: int) -> Column:
    """Unit-length sum of ``(w, vector)`` entries; zero when there are none."""
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(
        F.coalesce(weighted, F.array().cast("array<struct<w:double,vector:array<double>>>")),
        zero,
        lambda acc, e: F.zip_with(acc, e["vector"], lambda x, y: x + y * e["w"]),
        lambda acc: F.struct(acc.alias("v"), F.sqrt(F.aggregate(acc, F.lit(0.0), lambda s, x: s + x * x)).alias("length")),
    )
    return F.transform(total["v"], lambda x: F.when(total["length"] > 0, x / total["length"]).otherwise(F.lit(0.0)))


def embed(rows: DataFrame, key: str, text: str, vectors: DataFrame, dim: int) -> DataFrame:
    """``key, vector`` for rows of distinct keys, from the words of their texts."""
    words = spread(rows.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_key")
    each = words.select("_key", F.explode(V.words(F.col("_text"))).alias("term")).groupBy("_key", "term").agg(F.count("*").alias("n"))
    weight = F.log1p(F.col("n").cast("double")).alias("w")
    known = each.join(vectors.select("term", "vector"), "term").select("_key", F.struct("term", weight, "vector").alias("e"))
    listed = known.groupBy("_key").agg(F.array_sort(F.collect_list("e")).alias("e"))
    summed = words.select("_key").join(listed, "_key", "left")
    entries = F.transform("e", lambda e: F.struct(e["w"].alias("w"), e["vector"].alias("vector")))
    # The one-element explode fixes the vector as a column of its own for batch functions on top of it.
    return summed.select(F.col("_key").alias(key), F.explode(F.array(_sum(entries, dim))).alias("vector"))

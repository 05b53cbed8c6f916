"""Scores of keyword vectors against a vocabulary, and the threshold join built on them.

Both sides stay tables.  The vocabulary is range-sorted by the length of its vectors and packed into blocks, one
row each; the queries are dealt evenly to tiles by a number of their own.  A tile and a block meet as one group
of a join on their two numbers, so a task holds one tile and one block whatever the two sides' sizes, and no
vector passes the driver.  For a threshold, pairs of a tile and a block whose longest vectors cannot reach it
never meet; inside a pair the strongest dimensions are multiplied first, and only rows and terms whose bound
(that product plus the lengths of what is left) reaches the threshold are multiplied in full.

A query has one row in the result, however many blocks there are.  Until then its hits are bits: the terms of a
block are numbered in their own order, and 64 of them are one number, so lists of terms are never shuffled.  They
are made last, from the terms of the blocks, where all hits of a query or text are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitemill.operators.word_counts import grouped, list_sizes, owner
from sitemill.workspace import spread, stage

#: Queries of a tile and terms of a block when hits are sought, and when every score is a row of the result.
MATCH_ROWS, SCORE_ROWS = 8192, 1024
#: Scores computed at once.
CELLS = 2_000_000
#: Share of the dimensions that are multiplied first, and what rounding may add to a score.
FIRST, SLACK = 0.25, 1e-4
#: Terms whose hits are the bits of one number, and blocks whose terms (no vectors) are sent to all executors at most.
WORD, SMALL_BLOCKS = 64, 64

_BLOCK = "block long, top double, terms array<string>, cells binary"


def vocabulary_blocks(vocabulary: DataFrame, rows: int = MATCH_ROWS) -> DataFrame:
    """``block, top, terms, cells``: terms with vectors, longest vectors first, ``rows`` to a block, which has them in term order."""
    known = vocabulary.where("term IS NOT NULL AND vector IS NOT NULL").select("term", F.col("vector").cast("array<double>").alias("vector"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x))
    known = stage(known.withColumn("length", length), "vocabulary")
    parts = max(1, -(-known.count() // rows))
    ordered = known.repartitionByRange(parts, F.desc("length"), "term").sortWithinPartitions(F.desc("length"), "term")

    def pack(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part, number = batch.slice(i, rows), number + 1
                top = part.column("length")[0].as_py()
                part = part.take(pc.sort_indices(part.column("term")))
                cells = part.column("vector").flatten().to_numpy(zero_copy_only=False)
                columns = [[number], [top], [part.column("term").to_pylist()], [cells.tobytes()]]
                types = [pa.int64(), pa.float64(), pa.list_(pa.string()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in _BLOCK.split(", ")])

    return stage(ordered.mapInArrow(pack, _BLOCK), "vocabulary-blocks")


def _tiles(queries: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """The queries with a number ``_q`` of their own and their ``_tile``, and how many tiles there are."""
    numbered = stage(queries.withColumn("_q", F.monotonically_increasing_id()), "queries")
    tiles = max(1, -(-numbered.count() // rows))
    return numbered.withColumn("_tile", F.pmod(F.xxhash64("_q"), F.lit(tiles)).cast("int")), tiles


def _meetings(queries: DataFrame, tiles: int, blocks: DataFrame, threshold: float | None):
    """Groups of one tile and one block each; with a threshold those only that can reach it."""
    known = queries.where("vector IS NOT NULL").select("_tile", "_q", F.col("vector").cast("array<double>").alias("vector"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x))
    longest = known.groupBy("_tile").agg(F.max(length).alias("longest"))
    pairs = blocks.select("block", "top", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("_tile")).join(longest, "_tile")
    if threshold is not None:
        pairs = pairs.where(F.col("longest") * F.col("top") + SLACK > threshold)
    pairs = pairs.select("_tile", "block")
    left = known.join(pairs, "_tile")
    right = blocks.select("block", "terms", "cells").join(pairs, "block")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, for the two sides to be told apart
    return left.groupBy("_tile", "block").cogroup(right.groupBy("_tile", "block"))


def _matrices(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    terms = right.column("terms").combine_chunks().flatten()
    columns = np.frombuffer(right.column("cells")[0].as_py()).reshape(len(terms), -1)
    return left.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(left.num_rows, -1), columns


def reaching(given: np.ndarray, terms: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and term of every pair whose score, rounded to four digits, is above the threshold."""
    order = np.argsort(-(terms * terms).sum(axis=0))
    first, rest = np.split(order, [max(1, int(len(order) * FIRST))])
    bound = given[:, first] @ terms[:, first].T
    lengths = np.sqrt((given[:, rest] ** 2).sum(axis=1)), np.sqrt((terms[:, rest] ** 2).sum(axis=1))
    hopeful = bound + lengths[0][:, None] * lengths[1][None, :] + SLACK > threshold
    rows, columns = np.flatnonzero(hopeful.any(axis=1)), np.flatnonzero(hopeful.any(axis=0))
    i, j = np.nonzero(np.round(given[rows] @ terms[columns].T, 4) > threshold)
    return rows[i], columns[j]


def dot_scores(queries: DataFrame, vocabulary: DataFrame, rows: int = SCORE_ROWS) -> DataFrame:
    """``queries`` with ``(term, score)`` for every vocabulary term, one row each; none for a null vector."""
    numbered, tiles = _tiles(queries, rows)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], pa.float64())], ["_q", "term", "score"])
        given, columns = _matrices(left, right)
        terms = right.column("terms").combine_chunks().flatten()
        each = left.column("_q").combine_chunks().take(pa.array(np.repeat(np.arange(len(given)), len(columns))))
        return pa.table([each, terms.take(pa.array(np.tile(np.arange(len(columns)), len(given)))), pa.array((given @ columns.T).ravel())], ["_q", "term", "score"])

    found = _meetings(numbered, tiles, vocabulary_blocks(vocabulary, rows), None).applyInArrow(score, "_q long, term string, score double")
    held = [c for c in queries.columns if c != "vector"]
    return numbered.select("_q", *held).join(found, "_q").select(*held, "term", "score")


def ranked_scores(queries: DataFrame, key: str, vocabulary: DataFrame, rows: int = SCORE_ROWS) -> DataFrame:
    """Scores of each query from best to worst; ties in term order.  A group is one vocabulary."""
    best_first = Window.partitionBy(key).orderBy(F.desc(F.round("score", 6)), "term")
    return dot_scores(queries, vocabulary, rows).withColumn("position", F.row_number().over(best_first).cast("bigint"))


def hit_words(row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number of the word and its bits for pairs of a row and a term, which ascend."""
    word = term // WORD
    first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(word, prepend=-1) != 0))
    bits = np.left_shift(np.uint64(1), (term % WORD).astype(np.uint64))
    return row[first], word[first], (np.bitwise_or.reduceat(bits, first) if len(first) else bits).view(np.int64)


def _hits(queries: DataFrame, tiles: int, blocks: DataFrame, threshold: float) -> DataFrame:
    """``_q, block, at, bits``: the words with hits of each query and block, one row for both."""

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, int),) * 3]
        if left.num_rows and right.num_rows:
            given, columns = _matrices(left, right)
            step = max(1, CELLS // len(columns))
            for i in range(0, len(given), step):
                row, word, bits = hit_words(*reaching(given[i : i + step], columns, threshold))
                out.append((row + i, word, bits))
        row, word, bits = (np.concatenate(x) for x in zip(*out, strict=True))
        hit = np.unique(row)
        places = pa.array(np.searchsorted(row, np.append(hit, left.num_rows)).astype(np.int32))
        ids = left.column("_q").combine_chunks().take(pa.array(hit)) if len(hit) else pa.array([], pa.int64())
        block = pa.array(np.repeat(right.column("block")[0].as_py() if len(hit) else 0, len(hit)), pa.int64())
        lists = [pa.ListArray.from_arrays(places, pa.array(x, t)) for x, t in ((word, pa.int32()), (bits, pa.int64()))]
        return pa.table([ids, block, *lists], ["_q", "block", "at", "bits"])

    return _meetings(queries, tiles, blocks, threshold).applyInArrow(match, "_q long, block long, at array<int>, bits array<long>")


def _fold(hits: pa.RecordBatch) -> pa.RecordBatch:
    """One row for each stretch of rows with the same key and block, with the bits of all of them, words in order."""
    key, block = hits.column(0), hits.column("block").to_numpy(zero_copy_only=False)
    keys = key.to_pylist()
    fresh = np.array([i == 0 or keys[i] != keys[i - 1] or block[i] != block[i - 1] for i in range(len(keys))], bool)
    rows, _ = owner(list_sizes(hits.column("at"), 1))
    at, bits = (hits.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "bits"))
    width = int(at.max(initial=0)) + 1
    code = (np.cumsum(fresh) - 1)[rows] * width + at
    order, first = grouped(code)
    merged = np.bitwise_or.reduceat(bits[order], first) if len(first) else bits
    words = code[order][first]
    ends = pa.array(np.searchsorted(words, np.arange(fresh.sum() + 1) * width).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((words % width, pa.int32()), (merged, pa.int64()))]
    begin = pa.array(np.flatnonzero(fresh))
    lists = [x.cast(hits.schema.field(name).type) for name, x in zip(("at", "bits"), lists, strict=True)]
    return pa.RecordBatch.from_arrays([key.take(begin), hits.column("block").take(begin), *lists], schema=hits.schema)


def _spots(folded: pa.RecordBatch, rows: int = 1024):
    """``key, block, spots``: the places of the terms that are hit in their block, in order."""
    for i in range(0, folded.num_rows, rows):
        part = folded.slice(i, rows)
        row, _ = owner(list_sizes(part.column("at"), 1))
        at, bits = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "bits"))
        word, bit = np.nonzero(np.unpackbits(bits.astype("<i8").view(np.uint8), bitorder="little").reshape(-1, WORD))
        ends = pa.array(np.searchsorted(row[word], np.arange(part.num_rows + 1)).astype(np.int32))
        spots = pa.ListArray.from_arrays(ends, pa.array((at[word] * WORD + bit).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column("block"), spots], [part.schema.names[0], "block", "spots"])


def _listed(hits: DataFrame, key: str, blocks: DataFrame) -> DataFrame:
    """``key, terms``: the terms of all hits ``(key, block, at, bits)`` of each key, sorted; keys with hits only.

    Rows of a key are brought together as bits, and stay there; the bits of a key and a block are folded batch by batch.
    """
    ordered = spread(hits.select(key, "block", "at", "bits"), key).sortWithinPartitions(key, "block")

    def fold(batches):
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if batch.num_rows:
                folded = _fold(batch)
                held = folded.slice(folded.num_rows - 1)
                yield from _spots(folded.slice(0, folded.num_rows - 1))
        if held is not None:
            yield from _spots(held)

    kept = StructType([ordered.schema[key], *StructType.fromDDL("block long, spots array<int>").fields])
    # Dealt by key again before the terms are looked up, so that lists of terms are not shuffled by what follows.
    packed = spread(ordered.mapInArrow(fold, kept), key)
    known = stage(blocks.select("block", "terms"), "block-terms")
    n_blocks = known.count()
    joined = packed.join(F.broadcast(known) if n_blocks <= SMALL_BLOCKS else known, "block")
    found = joined.select(key, F.transform("spots", lambda i: F.get("terms", i)).alias("terms"))
    if n_blocks <= 1:
        return found
    return found.groupBy(key).agg(F.sort_array(F.flatten(F.collect_list("terms"))).alias("terms"))


def vocabulary_matches(queries: DataFrame, vocabulary: DataFrame, threshold: float, rows: int = MATCH_ROWS) -> DataFrame:
    """``queries`` without ``vector``, and the distinct vocabulary ``terms`` that score above the threshold, sorted.

    A query has one row; its list is empty where it reaches no term, as for a null vector.
    """
    numbered, tiles = _tiles(queries, rows)
    blocks = vocabulary_blocks(vocabulary, rows)
    found = _listed(_hits(numbered, tiles, blocks, threshold), "_q", blocks)
    held = [c for c in queries.columns if c != "vector"]
    joined = numbered.select("_q", *held).join(found, "_q", "left")
    return joined.select(*held, F.coalesce(F.array_distinct("terms"), F.array().cast("array<string>")).alias("terms"))


def reached_terms(pairs: DataFrame, keys: DataFrame, vocabulary: DataFrame, threshold: float, rows: int = MATCH_ROWS) -> DataFrame:
    """``(unit, terms)``: the vocabulary terms that any keyword of the unit reaches, sorted; units that reach one only.

    ``pairs`` is ``(unit, keyword)``, ``keys`` the distinct ``(keyword, vector)``; the vocabulary's terms are distinct.
    """
    numbered, tiles = _tiles(keys, rows)
    blocks = vocabulary_blocks(vocabulary, rows)
    named = numbered.select("_q", "keyword").join(_hits(numbered, tiles, blocks, threshold), "_q")
    return _listed(pairs.join(named, "keyword").select("unit", "block", "at", "bits"), "unit", blocks)


def keywords_to_vocabulary(keywords: DataFrame, vocabulary: DataFrame, threshold: float, rows: int = MATCH_ROWS) -> DataFrame:
    """``(unit, terms)``: the distinct vocabulary terms that any keyword of the unit reaches, sorted.

    ``keywords`` is ``(unit, vector)``; a unit that reaches no term has an empty list.
    """
    numbered, tiles = _tiles(keywords.select("unit", "vector"), rows)
    blocks = vocabulary_blocks(vocabulary, rows)
    units = numbered.select("_q", "unit")
    hits = units.join(_hits(numbered, tiles, blocks, threshold), "_q").select(F.struct("unit").alias("key"), "block", "at", "bits")
    found = _listed(hits, "key", blocks)
    # The key is a struct, so that a null unit meets itself in the join.
    joined = units.select(F.struct("unit").alias("key")).distinct().join(found, "key", "left")
    return joined.select("key.unit", F.coalesce(F.array_distinct("terms"), F.array().cast("array<string>")).alias("terms"))


def label_centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """Unit-length mean vector per label as ``(term, vector)``; the means combine on the map side."""
    cells = vectors.select(F.col(label).cast("string").alias("term"), F.posexplode(vector).alias("slot", "x"))
    means = cells.groupBy("term", "slot").agg(F.avg(F.col("x").cast("double")).alias("x"))
    in_order = F.array_sort(F.collect_list(F.struct("slot", "x")))
    sums = means.groupBy("term").agg(in_order.alias("cells"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return sums.select("term", F.transform("cells.x", lambda x: x / F.col("norm")).alias("vector"))

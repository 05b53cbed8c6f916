"""Near duplicates among embeddings by randomised-rotation binary codes.

A unit vector is rotated at random and each coordinate kept as a sign.  With the stored correction factor
<code, vector>, the product of another vector with the code gives an unbiased estimate of the cosine whose
error has a known size, averaged here over ``ROTATIONS`` rotations.  Only pairs whose estimate does not lie
below the threshold by more than the confidence bound are recomputed exactly, in double precision.

Which vectors are compared: copies are one class; within a label, classes meet in a table if all bits of a
run of the code signs agree.  The number of bits per run grows with the logarithm of the largest label, and
the number of tables is the one at which pairs at the threshold meet with ``TARGET_RECALL``, so the work
grows a little faster than the input and not with its square.  Pairs that meet and are not rejected connect
classes into clusters, and inside a cluster all pairs are estimated, and recomputed where needed.  Large
runs and clusters are cut into tiles of bounded size; no pair is written out.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component, and vectors
without label, link with nothing and are their own component.  Only vectors of one length are compared.
Repeated rows are copies.  A component is named by its smallest vec_id, null only if all are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill.llm import words as W
from sitemill.llm.components import components, sorted_tiles, spanning, spread_pairs, whole_groups
from sitemill.workspace import stage

THRESHOLD, TARGET_RECALL = 0.93, 0.999
#: Rotations whose codes are stored for estimates, and standard errors of the confidence bound.
ROTATIONS, SURE = 4, 4.0
#: Bits of a run beyond those that tell apart the classes of the largest label.
EXTRA_BITS = 3
RUN_BLOCK, CLUSTER_BLOCK = 512, 256


@cache
def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(20240621 + number).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def tables(largest: int, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> tuple[int, int]:
    """Bits per run and number of runs for labels of up to ``largest`` classes."""
    bits = min(48, max(8, math.ceil(math.log2(max(2, largest))) + EXTRA_BITS))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits (packed) under the estimate's rotations, and the correction factor of each."""
    dim = vectors.shape[1]
    turned = np.stack([vectors @ rotation(dim, m).T for m in range(ROTATIONS)], axis=1)
    factors = np.abs(turned).sum(axis=2) / math.sqrt(dim)
    return np.packbits((turned > 0).reshape(len(vectors), -1), axis=1), factors


class Estimates:
    """Estimated cosines of the vectors of a batch with each other, from codes and factors."""

    def __init__(self, vectors: np.ndarray, packed: np.ndarray, factors: np.ndarray):
        n, dim = vectors.shape
        signs = np.unpackbits(packed, axis=1, count=ROTATIONS * dim).reshape(n, ROTATIONS, dim) * 2.0 - 1.0
        self.codes = signs / (factors * math.sqrt(dim) * ROTATIONS)[:, :, None]
        self.turned = np.stack([vectors @ rotation(dim, m).T for m in range(ROTATIONS)], axis=1)
        spread = ((1 - factors**2) / factors**2).clip(0).mean(axis=1) / (max(1, dim - 1) * ROTATIONS)
        self.error = np.sqrt(spread)

    def possible(self, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
        """Pairs that may reach the threshold: a pair that does lies below this bound by chance only."""
        found = (self.turned[i] * self.codes[j]).sum(axis=(1, 2)) + (self.turned[j] * self.codes[i]).sum(axis=(1, 2))
        slack = SURE * np.maximum(self.error[i], self.error[j]) * math.sqrt(1 - threshold**2)
        return found / 2 >= threshold - slack

    def matrix(self, threshold: float) -> np.ndarray:
        n = len(self.error)
        one = self.turned.reshape(n, -1) @ self.codes.reshape(n, -1).T
        slack = SURE * np.maximum(self.error[:, None], self.error[None, :]) * math.sqrt(1 - threshold**2)
        return (one + one.T) / 2 >= threshold - slack


def cosines(vectors: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    a, b = vectors[i], vectors[j]
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def classes_of(vectors: DataFrame) -> DataFrame:
    """``node, label, dim, first_id, copies, vector, code, factors``: one row per distinct usable vector."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    good = vectors.where(F.col("label").isNotNull() & (F.size("embedding") > 0) & usable & some)
    rows = good.select("label", F.col("embedding").cast("array<double>").alias("vector"), F.col("vec_id").cast("long").alias("vec_id"))
    grouped = rows.groupBy("label", "vector").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    keyed = grouped.select(F.xxhash64("label", "vector").alias("node"), F.xxhash64("label", F.size("vector")).alias("label"), F.size("vector").alias("dim"), "first_id", "copies", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            packed, stored = [b""] * batch.num_rows, [b""] * batch.num_rows
            dims = batch.column("dim").to_numpy()
            for dim in set(dims.tolist()):
                at = np.flatnonzero(dims == dim)
                flat = batch.column("vector").take(pa.array(at)).flatten().to_numpy().reshape(-1, dim)
                for k, bits, factor in zip(at.tolist(), *codes(unit(flat)), strict=True):
                    packed[k], stored[k] = bits.tobytes(), factor.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(packed, pa.binary()), pa.array(stored, pa.binary())], [*batch.schema.names, "code", "factors"]
            )

    return keyed.mapInArrow(run, "node long, label long, dim int, first_id long, copies long, vector array<double>, code binary, factors binary")


def _arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, packed codes and factors of rows of one dimension."""
    n = rows.num_rows
    vectors = rows.column("vector").combine_chunks().flatten().to_numpy().reshape(n, -1)
    packed = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(n, -1)
    factors = np.frombuffer(b"".join(rows.column("factors").to_pylist()), np.float64).reshape(n, -1)
    return vectors, packed, factors


def _by_dimension(rows: pa.Table, starts: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The groups of at least two rows, in tables of one dimension of vectors and of bounded size."""
    dims = rows.column("dim").to_numpy()
    sizes = np.diff(starts)
    for dim in set(dims[starts[:-1]].tolist()):
        chosen = np.flatnonzero((dims[starts[:-1]] == dim) & (sizes > 1))
        i = 0
        while i < len(chosen):
            j = max(i + 1, i + int(np.searchsorted(np.cumsum(sizes[chosen[i:]]), 4096, side="right")))
            part = chosen[i:j]
            at = np.concatenate([np.arange(starts[g], starts[g + 1]) for g in part.tolist()])
            yield rows.take(pa.array(at)), np.concatenate([[0], np.cumsum(sizes[part])])
            i = j


def candidate_edges(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``a, b``: edges that connect all classes which meet in a table and are not rejected by their codes."""
    largest = classes.groupBy("label").count().agg(F.max("count").alias("n")).first()["n"] or 1
    bits, runs = tables(largest, threshold)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            dims = rows.column("dim").to_numpy()
            for dim in set(dims.tolist()):
                part = rows.take(pa.array(np.flatnonzero(dims == dim)))
                vectors = unit(part.column("vector").combine_chunks().flatten().to_numpy().reshape(part.num_rows, dim))
                needed = -(-bits * runs // dim)
                signs = np.concatenate([vectors @ rotation(dim, m).T > 0 for m in range(needed)], axis=1)
                signs = signs[:, : bits * runs].reshape(part.num_rows, runs, bits)
                key = signs @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))
                label = part.column("label").to_numpy().astype(np.uint64)
                key = W.mix(W.mix(key) + W.mix(np.arange(runs, dtype=np.uint64)) ^ W.mix(label)[:, None])
                node = np.repeat(part.column("node").to_numpy(), runs)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().astype(np.int64)), pa.array(node)], ["key", "node"])

    places = stage(classes.select("node", "label", "dim", "vector").mapInArrow(keys, "key long, node long"), "code-runs")
    shared = places.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = places.join(shared, "key").join(classes.select("node", "dim", "vector", "code", "factors"), "node")
    placed = spread_pairs(met, "n", RUN_BLOCK, "node").select("key", "ti", "tj", "node", "dim", "vector", "code", "factors")
    tiles = sorted_tiles(placed, "key", "ti", "tj", then=("node",))  # seeds, and so edges, coincide

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, begins in whole_groups(batches, ["key", "ti", "tj"]):
            for rows, starts in _by_dimension(whole, begins):
                vectors, packed, factors = _arrays(rows)
                nodes, found = rows.column("node").to_numpy(), Estimates(unit(vectors), packed, factors)
                sizes = np.diff(starts)
                group = np.repeat(np.arange(len(sizes)), sizes)
                ends = []
                small = sizes[group] <= 24
                for shift in range(1, min(24, len(group))):
                    at = np.flatnonzero(small[:-shift] & (group[shift:] == group[:-shift]))
                    if len(at) == 0:
                        break
                    at = at[found.possible(at, at + shift, threshold)]
                    ends.append((at, at + shift))
                for g in np.flatnonzero(sizes > 24).tolist():
                    a, b = int(starts[g]), int(starts[g + 1])
                    root = spanning(b - a, Estimates(unit(vectors[a:b]), packed[a:b], factors[a:b]).matrix(threshold))
                    ends.append((np.arange(a, b), a + root))
                if ends:
                    i, j = (np.concatenate(x) for x in zip(*ends, strict=True))
                    a, b = nodes[i], nodes[j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return tiles.mapInArrow(link, "a long, b long").where("a <> b")


def verified(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``node, links, toward`` per class and tile: vectors it links with, and a class it is connected to."""
    placed = spread_pairs(members, "n", CLUSTER_BLOCK, "node")
    columns = ["cluster", "ti", "tj", "side", "node", "copies", "dim", "vector", "code", "factors"]
    tiles = sorted_tiles(placed.select(*columns), "cluster", "ti", "tj")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, begins in whole_groups(batches, ["cluster", "ti", "tj"]):
            out: list[tuple] = []
            for rows, starts in _by_dimension(whole, begins):
                vectors, packed, factors = _arrays(rows)
                nodes, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
                sides = rows.column("side").to_numpy()
                same = rows.column("ti").to_numpy() == rows.column("tj").to_numpy()
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    own = vectors[a:b]
                    maybe = np.triu(Estimates(unit(own), packed[a:b], factors[a:b]).matrix(threshold), 1)
                    if not same[a]:
                        maybe &= sides[a:b, None] != sides[None, a:b]
                    i, j = np.nonzero(maybe)
                    linked = np.zeros((b - a, b - a), bool)
                    for k in range(0, len(i), 65536):
                        linked[i[k : k + 65536], j[k : k + 65536]] = cosines(own, i[k : k + 65536], j[k : k + 65536]) >= threshold
                    linked |= linked.T
                    counts, root = linked @ copies[a:b], spanning(b - a, linked)
                    some = np.flatnonzero(counts)
                    out.append((nodes[a:b][some], counts[some], nodes[a:b][root[some]]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["node", "links", "toward"]
                )

    return tiles.mapInArrow(run, "node long, links long, toward long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per vector."""
    classes = stage(classes_of(vectors.select("vec_id", "label", "embedding")), "vector-classes")
    clusters = components(candidate_edges(classes, threshold))
    sizes = clusters.groupBy("component").agg(F.count("*").alias("n"))
    chosen = clusters.join(sizes, "component").withColumnRenamed("component", "cluster")
    found = stage(verified(classes.drop("label", "first_id").join(chosen, "node"), threshold), "vector-links")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("toward").alias("b")))
    known = classes.select("node", "first_id", "copies").join(groups, "node", "left").join(linked, "node", "left")
    known = known.withColumn("group", F.coalesce("component", "node"))
    names = known.groupBy("group").agg(F.min("first_id").alias("component_id"))
    per_class = known.join(names, "group").select(
        "node", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    node = F.xxhash64("label", F.col("embedding").cast("array<double>"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), node.alias("node"))
    joined = rows.join(per_class.withColumn("usable", F.lit(True)), "node", "left")
    name = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        name.alias("component_id"),
        F.col("vec_id").eqNullSafe(name).alias("kept"),
    )

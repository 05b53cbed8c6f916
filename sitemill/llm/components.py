"""Connected components of an edge table, and passes over whole groups of sorted rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill.workspace import stage


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for all nodes of the edges ``a, b`` (long); a component is its smallest node.

    Each round a node takes the smallest label among its neighbours and itself, and then the label of that
    label, so labels travel in steps that double; a hub's neighbours are folded on the map side.  Rounds
    are written tables in the shared folder, and end when no label changes.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = edges.where("a <> b").select(F.explode(ways).alias("e")).select("e.a", "e.b")  # edges are made once
    both = stage(both.distinct(), "edges")
    labels = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("other")), "b")
        best = near.groupBy("a").agg(F.min("other").alias("other"))
        moved = labels.withColumnRenamed("label", "old").join(best, "a").withColumn("next", F.least("old", "other"))
        jump = labels.select(F.col("a").alias("next"), F.col("label").alias("further"))
        after = stage(moved.join(jump, "next").select("a", F.least("next", "further").alias("label"), "old"), "labels")
        labels = after.select("a", "label")
        if after.where("label <> old").isEmpty():
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of complete groups and the places where groups begin (and end); rows arrive sorted by the keys."""
    held: pa.Table | None = None

    def begins(rows: pa.Table) -> np.ndarray:
        change = np.zeros(rows.num_rows, bool)
        change[0] = True
        for k in keys:
            column = rows.column(k).to_numpy()
            change[1:] |= column[1:] != column[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
        starts = begins(rows)
        last = int(starts[-1])
        if last:
            yield rows.slice(0, last), starts
        held = rows.slice(last)
    if held is not None:
        yield held, np.append(begins(held), held.num_rows)


def spread_pairs(rows: DataFrame, size: str, block: int, *identity: str) -> DataFrame:
    """Add ``ti, tj, side``: tiles so that any two rows of a group meet in exactly one of them.

    A group of up to ``block`` rows is one tile.  A larger one is hashed into blocks, and a row goes to the
    tiles of its block with every block; ``side`` is the block the row has in a tile (0 or 1).  A row is
    thus copied once per ``block`` rows of its own group.
    """
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    placed = rows.withColumn("_g", blocks).withColumn("_i", F.pmod(F.xxhash64(*identity), F.col("_g")).cast("int"))
    exploded = placed.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    return exploded.select(
        *rows.columns,
        F.least("_i", "_j").alias("ti"),
        F.greatest("_i", "_j").alias("tj"),
        (F.col("_i") > F.col("_j")).cast("int").alias("side"),
    )


def sorted_tiles(rows: DataFrame, *keys: str, then: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a tile next to each other in one partition; the number of partitions is that of shuffles."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys, *then)


def spanning(n: int, linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the smallest index reachable from each index."""
    root = np.full(n, -1)
    for seed in range(n):
        if root[seed] >= 0:
            continue
        root[seed] = seed
        front = np.array([seed])
        while len(front):
            reach = linked[front].any(axis=0) & (root < 0)
            front = np.flatnonzero(reach)
            root[front] = seed
    return root

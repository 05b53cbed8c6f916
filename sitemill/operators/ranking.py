"""Positions within groups that hold when one group has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitemill.workspace import stage


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """Number the rows of each group from 1 in the given column order, without a cap on group size.

    The rows are range-partitioned by (keys, order), so a large group spreads over many slices and a
    slice never holds more than one partition of rows.  A row's number is its place in its slice plus
    the size of the group's earlier slices; those sizes are one row per group and slice.  The slices
    are staged, because range bounds are sampled and must not change between the two uses.
    """
    sliced = df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id())
    sliced = stage(sliced, "ranked")
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order))
    numbered = sliced.withColumn("_local", local).join(offsets, [*keys, "_slice"])
    return numbered.withColumn(name, F.col("_before") + F.col("_local")).drop("_slice", "_local", "_before")


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, name: str = "position"
) -> DataFrame:
    """The first ``k`` rows of each group, numbered.

    Each group is first cut to ``k`` rows per slice of the rows, then to ``k`` overall.  Both cuts run as group
    limits before their shuffles, so no more than ``k`` rows of a group leave a task.
    """
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    cut = df.withColumn("_salt", F.spark_partition_id()).withColumn(name, F.row_number().over(inner)).where(F.col(name) <= k)
    return (
        cut.drop(name, "_salt")
        .withColumn(name, F.row_number().over(outer).cast("bigint"))
        .where(F.col(name) <= k)
    )

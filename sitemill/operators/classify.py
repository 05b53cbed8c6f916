"""Two-level type of a record: best type anchor, and best subtype anchor for resources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill import constants as C
from sitemill.models import Models, with_key_vectors

ORGANIZATION = "Organization"


def anchor_vectors(spark: SparkSession, models: Models | None = None) -> list[list[float]]:
    """Vectors of the eight fixed anchors, from the model and of the width that keywords have."""
    anchors = [(i, t) for i, (_, t) in enumerate(C.TYPE_ANCHORS + C.SUBTYPE_ANCHORS)]
    rows = with_key_vectors(spark.createDataFrame(anchors, "i int, text string"), "text", models or Models()).collect()
    failed = [r["error"] for r in rows if r["vector"] is None]
    if failed:
        raise ValueError(f"the anchors cannot be embedded: {failed[0]}")
    return [r["vector"] for r in sorted(rows, key=lambda r: r["i"])]


def _score(vector: Column, anchor: Sequence[float]) -> Column:
    cells = F.zip_with(vector, F.array(*[F.lit(float(x)) for x in anchor]), lambda a, b: a * b)
    return F.aggregate(cells, F.lit(0.0), lambda acc, x: acc + x)


def _best(vector: Column, anchors: Sequence[Sequence[float]], labels: Sequence[str]) -> Column:
    """Label of the highest score; the earlier anchor wins a tie."""
    ranked = [
        F.struct(F.round(_score(vector, anchor), 6).alias("s"), F.lit(-i).alias("o"), F.lit(name).alias("label"))
        for i, (anchor, name) in enumerate(zip(anchors, labels, strict=True))
    ]
    return F.when(vector.isNotNull(), F.greatest(*ranked)["label"])


def classify(df: DataFrame, anchors: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """Replace ``vector`` by ``type`` and ``subtype``, both null for a null vector.

    ``anchors`` are the vectors of ``anchor_vectors`` for the model that made the column.
    """
    anchors = anchor_vectors(df.sparkSession) if anchors is None else anchors
    n = len(C.TYPE_ANCHORS)
    vector = F.col("vector")
    found = df.withColumn("type", _best(vector, anchors[:n], [label for label, _ in C.TYPE_ANCHORS]))
    sub = _best(vector, anchors[n:], [label for label, _ in C.SUBTYPE_ANCHORS])
    return found.withColumn("subtype", F.when(F.col("type") == ORGANIZATION, ORGANIZATION).otherwise(sub)).drop("vector")

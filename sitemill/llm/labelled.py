"""Labelled rows for fitting: the split by identifier and a sample of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled rows that a classifier is fitted on; all rows are scored.
SAMPLE_ROWS = 16_000


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from; a row without identifier is not one of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, y`` of all labelled documents that are not held out.

    Contradicting labels of one document count as 1, null labels as none.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    return known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, bound: int = SAMPLE_ROWS) -> DataFrame:
    """``text, y`` of about ``bound`` labelled documents at most, none of them held out; copies count once.

    The sample is drawn by a seeded hash of the identifier, so it does not depend on the order of rows or files.
    """
    known = training_labels(labels, label)
    total = known.count()
    space = 1 << 30
    limit = space if total <= bound else int(space * (bound / total))
    chosen = known.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(space)) < limit)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y").distinct()

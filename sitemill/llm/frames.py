"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Texts are worked on in slices of about this many bytes; one longer text is a slice of its own.
SLICE_BYTES = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, or of one longer text."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    places = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else None
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(places, places[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def annotate(rows: DataFrame, compute: Callable[[pa.Array], list], fields: str, text: str = "text") -> DataFrame:
    """``row`` (all columns as one struct, so no names can clash) and the fields computed from its text.

    ``compute`` takes a slice of texts and returns one Arrow or numpy array per field.  There is no shuffle.
    """
    packed = rows.select(F.struct("*").alias("row"))
    added = StructType.fromDDL(fields)
    schema = StructType([StructField("row", packed.schema["row"].dataType), *added.fields])
    names = ["row", *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0)
            texts = whole.field(text)
            for i, j in cut(texts):
                found = [x if isinstance(x, pa.Array) else pa.array(x) for x in compute(texts.slice(i, j - i))]
                yield pa.RecordBatch.from_arrays([whole.slice(i, j - i), *found], names)

    return packed.mapInArrow(run, schema)

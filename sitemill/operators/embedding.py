"""Text vectors as a grouped count of word slots."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sitemill.functions import vectors as V
from sitemill.operators.tokens import by_unit, part_rows
from sitemill.operators.word_counts import list_sizes, list_starts, owner
from sitemill.workspace import spread

#: Cells and words that are counted at once.
CELLS = 1 << 20
#: ``vectors.words`` of a text that is in lower case.
WORD = re.compile(r"[^\W_]+")


def _slots(text: str, dim: int) -> list[int]:
    """``vectors.bucket`` of each word of a text."""
    return [int(md5(w.encode()).hexdigest()[:8], 16) % dim for w in WORD.findall(text.lower())]


def slot_counts(lists: DataFrame, dim: int = V.DIM) -> DataFrame:
    """``(unit, slots)``: how many words of each ``(unit, texts ARRAY)`` row fall into each slot, those with words only.

    Each distinct text of a batch is cut into words once, and counted where the rows are: no row per word is made
    and no text is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // dim)
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                texts = part.column("texts")
                coded = texts.flatten().fill_null("").dictionary_encode()
                slots = [_slots(t, dim) for t in coded.dictionary.to_pylist()]
                sizes, flat = np.array([len(x) for x in slots], np.int64), np.array([b for x in slots for b in x], np.int64)
                text, rows = coded.indices.to_numpy(zero_copy_only=False), owner(list_sizes(texts, 1))[0]
                cells = np.zeros(part.num_rows * dim, np.int64)
                for j in range(0, len(text), CELLS):
                    each, place = owner(sizes[text[j : j + CELLS]])
                    spot = list_starts(sizes)[text[j : j + CELLS][each]] + place
                    cells += np.bincount(rows[j : j + CELLS][each] * dim + flat[spot], minlength=len(cells))
                used = np.flatnonzero(cells)
                ends = np.searchsorted(used, np.arange(part.num_rows + 1) * dim).astype(np.int32)
                entries = pa.StructArray.from_arrays([pa.array((used % dim).astype(np.int32)), pa.array(cells[used])], ["b", "n"])
                yield pa.RecordBatch.from_arrays([part.column("unit"), pa.ListArray.from_arrays(pa.array(ends), entries)], ["unit", "slots"])

    given = lists.select("unit", "texts")
    found = StructType.fromDDL("slots array<struct<b: int, n: bigint>>")
    return given.mapInArrow(run, StructType([StructField("unit", given.schema["unit"].dataType), *found.fields]))


def embed_lists(lists: DataFrame, dim: int = V.DIM) -> DataFrame:
    """``(unit, vector)`` for ``(unit, texts ARRAY)``: the vector of all words of the texts; null texts add nothing.

    The slots of each row are counted in its row; the few counts of a unit are added on one partition.
    """
    each = spread(slot_counts(lists, dim), "unit").select("unit", F.explode_outer("slots").alias("s"))
    return _dense(each.groupBy("unit", F.col("s.b").alias("b")).agg(F.sum("s.n").alias("n")), dim)


def embed_texts(texts: DataFrame, dim: int = V.DIM) -> DataFrame:
    """``(unit, vector)`` for ``(unit, text)``.

    Each text is brought to its partition once, in the same exchange as the other text operators
    use, and its words are counted per slot there.  Parts ``(unit, part, text)`` of a text are counted where they are.
    """
    rows = part_rows(texts).select("unit.unit", "text") if "part" in texts.columns else by_unit(texts)
    slots = rows.select("unit", F.explode_outer(V.words(F.col("text"))).alias("word"))
    return _dense(slots.groupBy("unit", V.bucket(F.col("word"), dim).alias("b")).agg(F.count("word").alias("n")), dim)


def _dense(counted: DataFrame, dim: int) -> DataFrame:
    entry = F.when(F.col("b").isNotNull(), F.struct("b", F.log1p(F.col("n").cast("double")).alias("w")))
    sparse = counted.groupBy("unit").agg(F.array_sort(F.collect_list(entry)).alias("sparse"))
    # The one-element explode fixes the vector as a column: batch functions on top of it would
    # otherwise be folded into the aggregate, where the planner cannot run them.
    return sparse.select("unit", F.explode(F.array(V.dense_unit_vector(F.col("sparse"), dim))).alias("vector"))

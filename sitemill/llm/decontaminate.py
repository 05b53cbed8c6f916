"""Benchmark decontamination: normalised n-grams of the test items, looked up in all windows of all texts.

Words are those of ``words.py``.  An item of at least ``width`` words gives all windows of ``width``
consecutive words; a shorter one with any word gives one window of all its words.  The windows of a
bounded block of items are one hash set that every executor holds; each text is scanned once per block.
A hash that matches is verified on the words themselves, so no text is hit by chance.

Defined results: a null or empty text has no words and is clean.  Items without words match nothing;
items with a null id hit words but are not listed.  Repeated items count once, repeated rows of documents
give repeated results, other columns pass through untouched under any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill.llm import words as W
from sitemill.llm.frames import annotate

WIDTH = 10
#: Bytes of item text that one broadcast set is built from; more items are handled in several blocks.
BLOCK_BYTES = 16 << 20

FIELDS = "n_words long, hits array<struct<begin: int, end: int>>, items array<long>"


class Grams:
    """The windows of some items: sorted hashes by width, the words of each window, and its items."""

    def __init__(self, ids: list, texts: list, width: int):
        self.width = width
        self.owners: dict[bytes, set] = {}
        found: dict[int, dict[int, list[bytes]]] = {}
        words = W.words_of(pa.array(texts, pa.string()))
        for d, item in enumerate(ids):
            low, high = int(words.first[d]), int(words.first[d + 1])
            size = min(width, high - low)
            if size == 0:
                continue
            own = words.hashes[low:high]
            keys, at = W.windows(own, np.array([0, high - low]), size)
            for key, i in zip(keys.tolist(), at.tolist(), strict=True):
                text = b" ".join(words.text(k) for k in range(low + i, low + i + size))
                self.owners.setdefault(text, set()).update(() if item is None else (item,))
                same = found.setdefault(size, {}).setdefault(key, [])
                if text not in same:
                    same.append(text)
        self.by_width = {size: (np.array(sorted(keys), np.uint64), keys) for size, keys in found.items()}


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def scan(texts: pa.Array, grams: Grams) -> list:
    """Per text: number of words, merged word ranges inside occurrences, ids of the items that occur."""
    words = W.words_of(texts)
    n = len(texts)
    spans: list[list] = [[] for _ in range(n)]
    items: list[set] = [set() for _ in range(n)]
    for size, (sorted_keys, exact) in grams.by_width.items():
        keys, at = W.windows(words.hashes, words.first, size)
        if len(keys) == 0:
            continue
        place = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        hit = np.flatnonzero(sorted_keys[place] == keys)
        owner = np.searchsorted(words.first, at[hit], side="right") - 1
        for k, d in zip(hit.tolist(), owner.tolist(), strict=True):
            i = int(at[k])
            text = b" ".join(words.text(j) for j in range(i, i + size))
            if text in exact[int(keys[k])]:
                begin = i - int(words.first[d])
                spans[d].append((begin, begin + size))
                items[d] |= grams.owners[text]
    hits = [[{"begin": b, "end": e} for b, e in _merged(s)] for s in spans]
    return [
        words.counts.astype(np.int64),
        pa.array(hits, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
        pa.array([sorted(s) for s in items], pa.list_(pa.int64())),
    ]


def item_blocks(benchmark: DataFrame, limit: int) -> list[DataFrame]:
    """The items in blocks of about ``limit`` bytes of text."""
    total = benchmark.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = -(-total // limit) or 1
    if n == 1:
        return [benchmark]
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [benchmark.where(block == b) for b in range(n)]


def mark(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row, n_words, hits, items`` per document: merged hit word ranges and the items found.

    With one block of items there is no shuffle.  With more, each block is a scan of its own over the
    result of the one before, and what it finds is merged into the rows in place.
    """
    context = docs.sparkSession.sparkContext
    marked = None
    for block in item_blocks(benchmark.select(F.col("item_id").cast("long"), "text").distinct(), block_bytes):
        found = block.collect()  # at most block_bytes of text
        held = context.broadcast(Grams([r["item_id"] for r in found], [r["text"] for r in found], width))

        def compute(texts: pa.Array, held=held) -> list:
            return scan(texts, held.value)

        if marked is None:
            marked = annotate(docs, compute, FIELDS)
            continue
        inner = marked.select("row", F.col("row.text").alias("text"), "n_words", "hits", "items")
        again = annotate(inner, compute, FIELDS)
        marked = again.select(
            F.col("row.row").alias("row"),
            "n_words",
            F.concat("row.hits", "hits").alias("hits"),
            F.array_union("row.items", "items").alias("items"),
        )
    return marked


def covered(hits: str = "hits") -> F.Column:
    """Number of words inside any of the ranges (ranges of several blocks may overlap)."""
    ordered = F.array_sort(F.col(hits))
    step = F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda acc, h: F.struct(
            (acc["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(acc["to"], h["begin"]))).alias("n"),
            F.greatest(acc["to"], h["end"]).alias("to"),
        ),
    )
    return step["n"]


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without any hit, with all their columns."""
    return mark(docs, benchmark, width).where(F.size("hits") == 0).select("row.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """All documents with the hit stretches cut out of their texts (from first to last word of a stretch)."""
    marked = mark(docs, benchmark, width)
    inner = marked.select("row", F.col("row.text").alias("text"), "hits").where(F.size("hits") > 0)
    rest = marked.where(F.size("hits") == 0).select("row.*")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = W.words_of(batch.column(1))
            bases = W.buffers(batch.column(1))[1]
            texts = []
            for d, ranges in enumerate(batch.column(2).to_pylist()):
                raw, at = (batch.column(1)[d].as_py() or "").encode(), 0
                base = int(bases[d])
                kept = []
                for begin, end in _merged([(r["begin"], r["end"]) for r in ranges]):
                    first = int(words.first[d])
                    kept.append(raw[at : int(words.starts[first + begin]) - base])
                    at = int(words.ends[first + end - 1]) - base
                texts.append(b"".join([*kept, raw[at:]]).decode("utf-8", "replace"))
            row = batch.column(0)
            columns = [pa.array(texts, pa.string()) if f.name == "text" else row.field(f.name) for f in schema.fields]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rest.unionByName(inner.mapInArrow(run, schema))


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` per document."""
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    found = mark(docs.select("doc_id", "text"), benchmark, width).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        covered().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
    )
    return found.withColumn("contaminated", F.col("n_hit") > 0)


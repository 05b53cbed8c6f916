"""Line deduplication by overlapping windows of three consecutive lines, with DataFrame functions only.

Each text is split at line ends; every run of ``width`` lines is a window, known by two 64-bit hashes.
Windows are counted globally with map-side partial counts; of a repeated one the occurrence with the
smallest (doc_id, text hash, line) stays, and all lines that any later occurrence covers are removed,
overlapping occurrences merged.

Defined results: a null text stays null, texts of fewer than ``width`` lines stay as they are, a text all
of whose lines go becomes empty.  Lines are compared as they are, blank ones included.  A null doc_id
sorts first.  Rows that repeat both doc_id and text are one document: they get the same result and are not
later occurrences of each other.  Other columns pass through untouched under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemill.workspace import stage

WIDTH = 3
SALT = 71


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def window_rows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, tk, line, w1, w2``: one row per window; ``tk`` is a hash of the text."""
    listed = docs.select("doc_id", F.xxhash64("text").alias("tk"), lines_of(F.col("text")).alias("lines"))
    hashed = listed.where(F.size("lines") >= width).select(
        "doc_id",
        "tk",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("a"),
        F.transform("lines", lambda x: F.xxhash64(F.lit(SALT), x)).alias("b"),
    )

    def window(array: str, i: Column) -> Column:
        return F.xxhash64(*[F.get(F.col(array), i + k) for k in range(width)])

    places = F.sequence(F.lit(0), F.size("a") - width)
    pairs = F.transform(places, lambda i: F.struct(window("a", i).alias("w1"), window("b", i).alias("w2")))
    return hashed.select("doc_id", "tk", F.posexplode(pairs).alias("line", "w")).select("doc_id", "tk", "line", "w.*")


def removed_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, tk, removed``: the sorted numbers (from 0) of the lines that go, for documents with any."""
    windows = stage(window_rows(docs, width), "line-windows")
    place = F.struct("doc_id", "tk", "line")
    repeated = windows.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(place).alias("stays")).where("n > 1")
    later = windows.join(repeated.drop("n"), ["w1", "w2"]).where(place > F.col("stays"))
    per_doc = later.groupBy("doc_id", "tk").agg(F.collect_set("line").alias("starts"))
    spans = F.flatten(F.transform("starts", lambda i: F.sequence(i, i + width - 1)))
    return per_doc.select("doc_id", "tk", F.array_sort(F.array_distinct(spans)).alias("removed"))


def cut(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``row, kept_text, n_lines, n_removed`` per document; ``row`` holds all columns as they came."""
    removed = stage(removed_lines(docs, width), "removed-lines")
    packed = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("tk"))
    joined = packed.join(
        removed.withColumnRenamed("tk", "tk2").hint("shuffle_hash"),
        F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("tk") == F.col("tk2")),
        "left",
    )
    lines = lines_of(F.col("row.text"))
    count = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines))
    staying = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    shorter = F.array_join(F.transform(staying, lambda i: F.get(lines, i)), "\n")
    return joined.select(
        "row",
        F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(shorter).alias("kept_text"),
        count.cast("long").alias("n_lines"),
        F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("n_removed"),
    )


def deduplicate(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """All documents with the later occurrences cut out; ``n_chars``, if there, follows the text."""
    found = cut(docs, width)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    changed = F.col("n_removed") > 0
    return found.select(
        *[
            (F.when(changed, new[c]).otherwise(F.col("row")[c]) if c in new else F.col("row")[c]).alias(c)
            for c in docs.columns
        ]
    )


def report(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` per document; the digest of a null text is null."""
    found = cut(docs.select("doc_id", "text"), width)
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )

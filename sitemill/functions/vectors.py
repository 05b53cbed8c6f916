"""Hashed term-frequency vectors and similarity helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 64


def words(text: Column) -> Column:
    """The words of ``sanitize_text``."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def bucket(word: Column, dim: int = DIM) -> Column:
    """Vector slot of a word: the first eight hex digits of its md5, modulo the width."""
    return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") % dim).cast("int")


def dense_unit_vector(sparse: Column, dim: int = DIM) -> Column:
    """Unit-length dense vector of sorted ``(b, w)`` entries; all zeros when there are none."""
    zero = F.lit(0.0)

    def once(value: Column, use) -> Column:
        """``use`` of a value that is computed once, not anew for each entry."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def filled(entries, norm):
        def place(i):
            return F.coalesce(F.get(entries, i)["b"], F.lit(-1))

        # Each entry brings the zeros before it, so every cell is written once, whatever the width.
        def cells(e, i):
            return F.concat(F.array_repeat(zero, e["b"] - place(i - 1) - 1), F.array(F.when(norm > 0, e["w"] / norm).otherwise(zero)))

        return F.concat(F.flatten(F.transform(entries, cells)), F.array_repeat(zero, F.lit(dim - 1) - place(F.size(entries) - 1)))

    def length(entries):
        return F.sqrt(F.aggregate(entries, zero, lambda acc, e: acc + e["w"] * e["w"]))

    return once(sparse, lambda entries: once(length(entries), lambda norm: filled(entries, norm)))


def term_vector(term: Column, dim: int = DIM) -> Column:
    """Vector of a short text, inside its row."""
    slots = F.array_sort(F.transform(words(term), lambda w: bucket(w, dim)))
    grouped = F.aggregate(
        slots,
        F.array().cast("array<struct<b:int,n:int>>"),
        lambda acc, b: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] == b),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(b.alias("b"), (F.try_element_at(acc, F.lit(-1))["n"] + 1).alias("n"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(b.alias("b"), F.lit(1).alias("n"))))),
    )
    sparse = F.transform(grouped, lambda e: F.struct(e["b"].alias("b"), F.log1p(e["n"].cast("double")).alias("w")))
    return dense_unit_vector(sparse, dim)

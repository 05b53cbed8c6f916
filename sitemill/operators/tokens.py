"""Texts as rows of sentences and words.

Every operator that looks inside texts first brings each text to one partition by its ``unit`` key
while it is still one row, and explodes it there.  All later groupings and windows start with
``unit``, so the exploded words never go through a shuffle.
"""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemill.functions import text as X
from sitemill.workspace import spread

STOP_LANGUAGES = ("english", "french", "german", "spanish")
MIN_WORD = 3


@cache
def stop_words() -> list[str]:
    """Stop words of the four languages of the texts, from the lists in the package."""
    folder = Path(__file__).parent.parent / "stopwords"
    return sorted({w for lang in STOP_LANGUAGES for w in (folder / f"{lang}.txt").read_text("utf-8").split()})


def _stop_list() -> str:
    return ", ".join("'" + w.replace("'", "\\'") + "'" for w in stop_words())


def is_weak(term: str) -> Column:
    """Words that carry no topic: stop words, one or two characters, or no letter at all."""
    column = F.col(term)
    return (F.length(column) < MIN_WORD) | ~column.rlike(r"\p{L}") | F.expr(f"{term} IN ({_stop_list()})")


def by_unit(texts: DataFrame, *held: str) -> DataFrame:
    """Texts on one partition per unit, with the columns ``held``."""
    return spread(texts.select("unit", "text", *held), "unit")


def part_rows(texts: DataFrame) -> DataFrame:
    """Parts of texts ``(unit, part, text)`` as texts of units of their own, (unit, part), dealt evenly."""
    return spread(texts.select(F.struct("unit", "part").alias("unit"), "text"), "unit")


def sentence_rows(texts: DataFrame) -> DataFrame:
    """``(unit, n_sentences, sentence, body)`` with sentences numbered from 0."""
    listed = texts.select("unit", X.sentences(F.col("text")).alias("all"))
    return listed.select("unit", F.size("all").alias("n_sentences"), F.posexplode("all").alias("sentence", "body"))


def word_rows(texts: DataFrame) -> DataFrame:
    """One row per word with its place and its neighbours inside the same chunk."""
    chunked = sentence_rows(texts).select(
        "unit", "n_sentences", "sentence", F.posexplode(X.chunks(F.col("body"))).alias("chunk", "stretch")
    )
    listed = chunked.select("unit", "n_sentences", "sentence", "chunk", X.chunk_words(F.col("stretch")).alias("near"))
    rows = listed.select("*", F.posexplode("near").alias("place", "word"))
    return rows.select(
        "unit",
        "n_sentences",
        "sentence",
        "chunk",
        "place",
        "word",
        F.lower("word").alias("term"),
        F.lower(F.get("near", F.col("place") - 1)).alias("before"),
        F.lower(F.get("near", F.col("place") + 1)).alias("after"),
        F.get("near", F.col("place") + 1).alias("word2"),
        F.get("near", F.col("place") + 2).alias("word3"),
    )


def topic_rows(texts: DataFrame) -> DataFrame:
    """The rows of ``word_rows`` that carry a topic, with ``shouted`` and ``capital``."""
    words = word_rows(texts).where(~is_weak("term"))
    starts = (F.col("chunk") == 0) & (F.col("place") == 0)
    shouted = (F.col("word") == F.upper("word")) & (F.length("word") > 1)
    return words.withColumn("shouted", shouted).withColumn("capital", F.col("word").rlike(r"^\p{Lu}") & ~starts)

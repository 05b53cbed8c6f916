"""Extractive descriptions: the sentences with the most frequent words, in text order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill import constants as C
from sitemill.functions import text as X
from sitemill.operators.keywords import rounded
from sitemill.operators.tokens import by_unit
from sitemill.operators.word_counts import Words, over_units, owner, term_counts


def top_sentences(texts: DataFrame) -> DataFrame:
    """``(unit, sentence, score, place)`` of the best sentences; enough of them for the long form.

    A sentence scores the mean count, in its text, of its topic words.  Sentences without topic
    words score 0.
    """

    def count(units: pa.Array, words: Words) -> list:
        # Sentences with a word, and the topic words among them, as numbers of (unit, sentence).
        sentences, place = owner(words.sizes[0])
        spoken = words.sizes[1] > 0
        width = int(place.max(initial=0)) + 1
        known = np.unique((words.number[sentences] * width + place)[spoken])
        of = np.searchsorted(known, words.unit * width + words.sentence)
        terms = term_counts(words)
        n = np.bincount(of, minlength=len(known))
        total = np.bincount(of, terms.columns["tf"][terms.of], len(known))
        score = rounded(total / np.maximum(n, 1))
        unit, sentence = known // width, known % width
        best = np.lexsort((sentence, -score, unit))
        rank = np.arange(len(best)) - np.searchsorted(unit, unit[best])
        kept = best[rank < C.LONG_SENTENCES]
        places = rank[rank < C.LONG_SENTENCES] + 1
        found = [pa.array(sentence[kept].astype(np.int32)), pa.array(score[kept]), pa.array(places.astype(np.int32))]
        return [units.take(pa.array(np.searchsorted(words.number, unit[kept]))), *found]

    return over_units(texts, count, "sentence int, score double, place int")


def descriptions(texts: DataFrame) -> DataFrame:
    """``(unit, short_description, long_description)`` of ``(unit, text)``; a fixed note when empty."""
    capped = by_unit(texts.select("unit", X.summary_input(F.col("text")).alias("text")))
    picked = top_sentences(capped).groupBy("unit").agg(
        F.array_sort(F.collect_list(F.when(F.col("place") <= C.SHORT_SENTENCES, F.col("sentence")))).alias("short"),
        F.array_sort(F.collect_list("sentence")).alias("long"),
    )
    listed = capped.select("unit", X.sentences(F.col("text")).alias("body")).join(picked.hint("merge"), "unit", "left")

    def text_of(places):
        joined = F.array_join(F.transform(places, lambda i: F.get("body", i)), " ")
        return F.when(F.coalesce(joined, F.lit("")) != "", joined).otherwise(C.EMPTY_SUMMARY)

    return listed.select(
        "unit", text_of("short").alias("short_description"), text_of("long").alias("long_description")
    )

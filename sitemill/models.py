"""Plug-in models: batch functions that replace the built-in deterministic extractors.

A model is ``Callable[[pandas.Series], pandas.Series]`` over texts.  It runs in Arrow batches; an
exception in one item becomes an error value for that item, and the other items go on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemill.functions.vectors import DIM, term_vector
from sitemill.operators import term_vectors
from sitemill.operators.embedding import embed_texts
from sitemill.schemas import TAGS
from sitemill.workspace import stage

Model = Callable[[pd.Series], pd.Series]


@dataclass(frozen=True)
class Models:
    """Optional replacements; ``None`` keeps the built-in job.  ``dim`` is the width of built-in vectors.

    ``vectors`` is a table of trained ``(term, vector)`` of that width (``term_vectors.train``); the built-in
    vectors of texts and keywords are then sums of these, instead of hashed word counts.
    """

    entities: Model | None = None
    name: Model | None = None
    short_description: Model | None = None
    long_description: Model | None = None
    keywords: Model | None = None
    embedding: Model | None = None
    key_vector: Model | None = None
    dim: int = DIM
    vectors: DataFrame | None = None

    RESULT_TYPES = {
        "entities": TAGS,
        "name": "STRING",
        "short_description": "STRING",
        "long_description": "STRING",
        "keywords": "ARRAY<STRING>",
        "embedding": "ARRAY<DOUBLE>",
        "key_vector": "ARRAY<DOUBLE>",
    }


def with_fallback(*models: Model) -> Model:
    """A model that hands the items on which one model fails to the next one."""

    def run(batch: pd.Series) -> pd.Series:
        def one(item):
            for i, model in enumerate(models):
                try:
                    return model(pd.Series([item])).iloc[0]
                except Exception:
                    if i == len(models) - 1:
                        raise

        try:
            return models[0](batch)
        except Exception:
            return pd.Series([one(item) for item in batch], dtype=object)

    return run


def model_column(model: Model, text: Column, result_type: str) -> Column:
    """``struct<value, error>`` of a model over a text column."""

    def run(batch: pd.Series) -> pd.DataFrame:
        def one(item):
            try:
                return model(pd.Series([item])).iloc[0], None
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"

        try:
            values = model(batch)
            pairs = [(v, None) for v in values]
        except Exception:
            pairs = [one(item) for item in batch]
        return pd.DataFrame({"value": [p[0] for p in pairs], "error": [p[1] for p in pairs]})

    # Never moved, copied or evaluated again by the optimizer: a model may be costly, and may fail.
    return F.pandas_udf(run, f"struct<value: {result_type}, error: string>").asNondeterministic()(text)


def apply_model(texts: DataFrame, models: Models, slot: str) -> DataFrame:
    """``(unit, value, error)`` of one model slot over ``(unit, text)``, evaluated once and staged."""
    done = model_column(getattr(models, slot), F.col("text"), Models.RESULT_TYPES[slot])
    answers = texts.select("unit", done.alias("r")).select("unit", "r.value", "r.error")
    named = F.when(F.col("error").isNotNull(), F.concat(F.lit(f"{slot}: "), "error"))
    return stage(answers.withColumn("error", named), f"model-{slot}")


def text_vectors(texts: DataFrame, models: Models) -> DataFrame:
    """``(unit, vector)``: the built-in vectors of ``(unit, text)``."""
    if models.vectors is not None:
        return term_vectors.embed(texts, "unit", "text", models.vectors, models.dim)
    return embed_texts(texts, models.dim)


def with_key_vectors(df: DataFrame, column: str, models: Models) -> DataFrame:
    """Add ``vector`` and ``error`` for a short text column; a failed item has a null vector.

    The built-in vector is computed in place, or from trained vectors.  A plug-in model is costly, so it sees each distinct
    text once; its answers are staged, and joined back.
    """
    if models.key_vector is None and models.vectors is not None:
        made = stage(term_vectors.embed(df.select(column).distinct(), column, column, models.vectors, models.dim), "key-vectors")
        return df.join(made, column).withColumn("error", F.lit(None).cast("string"))
    if models.key_vector is None:
        made = df.withColumn("vector", F.explode(F.array(term_vector(F.col(column), models.dim))))
        return made.withColumn("error", F.lit(None).cast("string"))
    terms = df.select(column).distinct()
    done = model_column(models.key_vector, F.col(column), Models.RESULT_TYPES["key_vector"])
    answers = stage(terms.select(column, done.alias("r")).select(column, "r.value", "r.error"), "key-vectors")
    answers = answers.withColumnRenamed("value", "vector").withColumn("error", _failure("key_vector"))
    return df.join(answers, column)


def _failure(slot: str) -> Column:
    """What a failed item of a slot is reported as; an answer of null is a failure too."""
    said = F.coalesce(F.col("error"), F.when(F.col("vector" if slot == "key_vector" else "value").isNull(), "no value"))
    return F.when(said.isNotNull(), F.concat(F.lit(f"{slot}: "), said))

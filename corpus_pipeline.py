"""A corpus pipeline over the documents: five stages, each a written table that the next one reads.

toxic documents go, repeated stretches of lines are cut, one document of each group of near copies stays,
documents with benchmark passages go, and what is left is packed into sequences of tokens.

Defined results: nulls, empty texts, ties and repeated rows are handled as the module of each stage states.  A text
that a stage empties stays a document and goes on; of equal texts without words the near-duplicate stage keeps one.
All stages but the last return the columns of the documents, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitemill.llm import config_pack, decontaminate, factor_toxicity, line_windows, lsh_forest
from sitemill.llm.frames import table
from sitemill.workspace import ensure_local_root, stage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    return factor_toxicity.clean_documents(docs, docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later occurrences of three-line windows cut out."""
    return line_windows.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return lsh_forest.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return config_pack.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: The learned scores of the first stage have no SQL form; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents table."""
    ensure_local_root(spark)
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

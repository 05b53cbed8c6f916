"""Readers of the given tables and the inputs that queries derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill.functions import urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page address plus the bare origin of each site."""
    url = pages(spark, sf_dir).select(F.col("url").alias("link"))
    return url.unionByName(url.select(urls.origin(F.col("link")).alias("link")).distinct())


def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from each origin to its first path level, and from there to the pages below it."""
    p = pages(spark, sf_dir).select(
        urls.origin(F.col("url")).alias("origin"),
        F.regexp_extract(urls.path(F.col("url")), "^(/[^/]+)/", 1).alias("top"),
        urls.clean_url(F.col("url")).alias("url"),
    )
    p = p.where(F.col("top") != "").withColumn("section", F.concat("origin", "top"))
    return (
        p.select(F.col("origin").alias("src"), F.col("section").alias("dst"))
        .unionByName(p.select(F.col("section").alias("src"), F.col("url").alias("dst")))
        .distinct()
        .withColumn("position", F.length("dst"))
    )

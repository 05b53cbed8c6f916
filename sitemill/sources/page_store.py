"""An indexed store of pages: written once, then asked for a few pages or sites without a full scan.

Pages are laid out by a number of buckets of their site and, within, range-sorted by page key, so a site with a
third of all pages is many files with key ranges that do not overlap.  Files have small row groups, with smallest
and largest keys as statistics and a Bloom filter of the keys.  A reader asked for few keys states them as values:
Spark then opens the folders of their buckets only, and Parquet skips row groups by statistics and filters.  For
more keys than that the look-up is a join on bucket and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill.functions import urls
from sitemill.sources.inputs import PageStore

#: Pages a bucket is meant to have, bounds of the number of buckets, and bytes of a row group.
BUCKET_PAGES, LEAST_BUCKETS, MOST_BUCKETS, GROUP_BYTES = 1_000_000, 16, 4096, 8 << 20
#: Keys that a reader states as values; Parquet compares up to ten of them one by one, more by their range.
STATED = 10

_SCHEMA = "site string, url string, address string, html string, bucket int"


def _bucket(site: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(site), F.lit(buckets)).cast("int")


def write_pages(pages: DataFrame, path: str, buckets: int | None = None, group_bytes: int = GROUP_BYTES) -> str:
    """Write ``(url, html)`` as an indexed store and return its path; copies of a page are kept."""
    if buckets is None:
        buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-pages.count() // BUCKET_PAGES)))
    address = F.col("url")
    keyed = pages.select(urls.page_key(address).alias("url"), address.alias("address"), "html")
    keyed = keyed.select(urls.site_key(F.col("url")).alias("site"), "url", "address", "html")
    placed = keyed.withColumn("bucket", _bucket(F.col("site"), buckets))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number is kept by adaptive execution
    ordered = placed.repartitionByRange(parts, "bucket", "url").sortWithinPartitions("bucket", "url")
    writer = ordered.write.partitionBy("bucket").option("parquet.block.size", str(group_bytes))
    for column in ("url", "site"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(f"{path}/buckets={buckets}")
    return path


class IndexedPages(PageStore):
    """The questions of ``PageStore`` answered from a written store."""

    def __init__(self, spark: SparkSession, path: str, unique: bool = False, extra_edges: DataFrame | None = None, sitemap: DataFrame | None = None):
        self.unique, self.extra_edges, self.sitemap = unique, extra_edges, sitemap
        # The number of buckets is the name of the one folder there is; nothing but Spark looks at the path.
        first = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
        found = first.select("path").limit(1).collect()
        self.buckets = int(found[0]["path"].split("/buckets=")[1].split("/")[0]) if found else 1
        self.rows = spark.read.schema(_SCHEMA).parquet(f"{path}/buckets={self.buckets}") if found else spark.createDataFrame([], _SCHEMA)

    def _asked(self, keys: DataFrame, column: str, site: Column) -> DataFrame:
        """The rows whose ``column`` is among the distinct ``keys``."""
        few = [r[0] for r in keys.select(column).limit(STATED + 1).collect()]
        if len(few) <= STATED:
            given = [k for k in few if k is not None]
            buckets = keys.sparkSession.createDataFrame([(k,) for k in given], f"{column} string").select(_bucket(site, self.buckets))
            stated = sorted({r[0] for r in buckets.collect()})
            return self.rows.where(F.col("bucket").isin(stated) & F.col(column).isin(given))
        placed = keys.select(column, _bucket(site, self.buckets).alias("bucket"))
        return self.rows.join(placed, ["bucket", column], "left_semi").select(self.rows.columns)

    def page_rows(self, keys: DataFrame) -> DataFrame:
        return self._asked(keys.select("url").distinct(), "url", urls.site_key(F.col("url")))

    def site_rows(self, sites: DataFrame) -> DataFrame:
        return self._asked(sites.select("site").distinct(), "site", F.col("site"))

    def published(self, homepages: DataFrame) -> DataFrame:
        if self.sitemap is not None:
            return super().published(homepages)
        asked = homepages.select("homepage", urls.site_key(F.col("homepage")).alias("site"))
        listed = self.site_rows(asked).select("site", urls.clean_url(F.col("address")).alias("url"))
        return asked.join(listed.distinct(), "site").select("homepage", "url")

"""Input tables: links, vocabulary terms, stored pages and published page lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill.functions import markup, urls


def split_list(df: DataFrame, value: Column, name: str) -> DataFrame:
    """One row per item of a comma-joined string, in order, untrimmed as given."""
    return df.select("*", F.posexplode(F.split(value, ",")).alias("position", name))


def links(spark: SparkSession, given: str | Iterable[str] | DataFrame) -> DataFrame:
    """``link`` rows from a list, a comma-joined string or a table that has a ``link`` column."""
    return _one_column(spark, given, "link")


def vocabulary(spark: SparkSession, given: str | Iterable[str] | DataFrame) -> DataFrame:
    """Distinct ``term`` rows from a list, a comma-joined string or a table with a ``term`` column."""
    return _one_column(spark, given, "term").where(F.col("term") != "").distinct()


def _one_column(spark: SparkSession, given, name: str) -> DataFrame:
    if isinstance(given, DataFrame):
        return given.select(name)
    items = given.split(",") if isinstance(given, str) else list(given)
    return spark.createDataFrame([(i,) for i in items], f"{name} string")


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Links from text files, one or several comma-joined per line."""
    lines = spark.read.text(path)
    return split_list(lines, F.col("value"), "link").where(F.col("link") != "").select("link")


def _parsed_texts(rows: DataFrame, unique: bool) -> DataFrame:
    one = rows.select("url", markup.page_text(F.col("html")).alias("text"))
    return one if unique else one.groupBy("url").agg(F.min("text").alias("text"))


def _parsed_edges(rows: DataFrame, unique: bool) -> DataFrame:
    links = F.transform(markup.page_links(F.col("address"), F.col("html")), urls.clean_url)
    one = rows.select("url", links.alias("links"))
    folded = one if unique else one.groupBy("url").agg(F.min("links").alias("links"))
    return folded.select(F.col("url").alias("src"), F.posexplode("links").alias("position", "dst"))


def page_texts(pages: DataFrame, unique: bool = False) -> DataFrame:
    """``(url, text)`` of all stored pages by their key, for work on the whole table.

    Copies of one page are folded by a ``min`` that combines on the map side, so a page stored very
    often is not a hot group.  A table known to hold each page once skips the folding, and with it
    the only shuffle.
    """
    return _parsed_texts(PageStore(pages).rows, unique)


class PageStore:
    """Stored pages ``(url, html)`` of which only the asked ones are parsed.

    Every method semi-joins the raw rows with what is asked for and applies the HTML expressions to
    the rows that are left.  ``unique`` states that the table holds each page once; ``extra_edges``
    adds known links ``(src, position, dst)``; ``sitemap`` replaces the page lists of the sites by
    ``(homepage, url)``.
    """

    def __init__(
        self, pages: DataFrame, unique: bool = False, extra_edges: DataFrame | None = None, sitemap: DataFrame | None = None
    ):
        address = F.col("url")
        self.rows = pages.select(urls.page_key(address).alias("url"), address.alias("address"), "html")
        self.unique, self.extra_edges, self.sitemap = unique, extra_edges, sitemap

    def page_rows(self, keys: DataFrame) -> DataFrame:
        """The stored rows of the pages with the given keys ``(url)``."""
        return self.rows.join(keys.select("url"), "url", "left_semi")

    def site_rows(self, sites: DataFrame) -> DataFrame:
        """The stored rows of all pages of the given sites ``(site)``."""
        return self.rows.withColumn("site", urls.site_key(F.col("url"))).join(sites.select("site"), "site", "left_semi")

    def texts(self, keys: DataFrame) -> DataFrame:
        """``(url, text)`` of the stored pages among the keys ``(url)``."""
        return _parsed_texts(self.page_rows(keys), self.unique)

    def edges(self, keys: DataFrame) -> DataFrame:
        """Links ``(src, position, dst)`` of the pages with the given keys."""
        found = _parsed_edges(self.page_rows(keys), self.unique)
        return self._with_extra(found, keys.select(F.col("url").alias("src")), "src")

    def site_edges(self, sites: DataFrame) -> DataFrame:
        """Links of all pages of the given sites ``(site)``."""
        return self._with_extra(_parsed_edges(self.site_rows(sites), self.unique), sites.select("site"), "site")

    def published(self, homepages: DataFrame) -> DataFrame:
        """``(homepage, url)``: the pages each homepage's site is known to have."""
        if self.sitemap is not None:
            listed = self.sitemap.select(urls.site_key(F.col("homepage")).alias("site"), "url")
        else:
            listed = self.rows.select(urls.site_key(F.col("url")).alias("site"), urls.clean_url(F.col("address")).alias("url"))
        asked = homepages.select("homepage", urls.site_key(F.col("homepage")).alias("site"))
        return asked.join(listed.distinct(), "site").select("homepage", "url")

    def _with_extra(self, found: DataFrame, keys: DataFrame, by: str) -> DataFrame:
        if self.extra_edges is None:
            return found
        more = keyed_edges(self.extra_edges).withColumn("site", urls.site_key(F.col("src")))
        return found.unionByName(more.join(keys, by, "left_semi").select("src", "position", "dst"))


class TableStore(PageStore):
    """The same questions answered from tables of links, texts and page lists."""

    def __init__(self, edges: DataFrame, texts: DataFrame, sitemap: DataFrame):
        self.known = texts.select(urls.rooted(F.col("url")).alias("url"), "text")
        self.extra_edges, self.sitemap = edges, sitemap

    def texts(self, keys: DataFrame) -> DataFrame:
        return self.known.join(keys.select("url"), "url", "left_semi")

    def edges(self, keys: DataFrame) -> DataFrame:
        return keyed_edges(self.extra_edges).join(keys.select(F.col("url").alias("src")), "src", "left_semi")

    def site_edges(self, sites: DataFrame) -> DataFrame:
        found = keyed_edges(self.extra_edges).withColumn("site", urls.site_key(F.col("src")))
        return found.join(sites.select("site"), "site", "left_semi").drop("site")


def keyed_edges(edges: DataFrame) -> DataFrame:
    """Links between clean addresses with their sources as page keys."""
    return edges.select(urls.rooted(F.col("src")).alias("src"), "position", "dst")


def fetch(links: DataFrame, store: PageStore, column: str = "link") -> DataFrame:
    """Look up the text of each link; a page that is not stored gives null.

    Each page is looked up once however often it is asked for: the links are reduced to distinct
    keys first, and the answer is joined back to the asking rows.
    """
    keyed = links.withColumn("_key", urls.page_key(F.col(column)))
    found = store.texts(keyed.select(F.col("_key").alias("url")).distinct()).withColumnRenamed("url", "_key")
    return keyed.join(found, "_key", "left").drop("_key")

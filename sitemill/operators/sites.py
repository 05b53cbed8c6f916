"""Texts and reports of whole sites.

A site's text is a table of parts of a fixed number of pages, for sites of any size; no step gathers
more than one part's text.  A report is one row per site: its page list, its distinct contacts as
rows folded per site, and its keywords over all parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitemill import constants as C
from sitemill.functions import markup, text, urls
from sitemill.operators.discovery import CRAWL
from sitemill.operators.ranking import rank_within, top_k

PAGES_PER_PART = 200


def page_rows(site_pages: DataFrame, facts: DataFrame) -> DataFrame:
    """``(homepage, position, link, text)`` for all pages of all sites.

    Pages that fail the link filter or have no text are listed with a null text.  A ``method`` column
    of the pages is used: the texts of crawled sites have their line ends blanked.
    """
    found = site_pages if "method" in site_pages.columns else site_pages.withColumn("method", F.lit(None).cast("int"))
    keyed = found.withColumn("url", F.when(urls.is_good(F.col("link")), urls.page_key(F.col("link"))))
    joined = keyed.join(facts.select("url", "text"), "url", "left")
    shown = F.when(F.col("method") == CRAWL, markup.one_line(F.col("text"))).otherwise(F.col("text"))
    return joined.select("homepage", "position", "link", shown.alias("text"))


def site_texts(pages: DataFrame, pages_per_part: int = PAGES_PER_PART) -> DataFrame:
    """``(homepage, part, n_pages, raw_text)`` of page rows: texts joined in page order."""
    placed = pages.withColumn("part", F.floor((F.col("position") - 1) / pages_per_part))
    texts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("position", "text"))))
    grouped = placed.groupBy("homepage", "part").agg(F.count("*").alias("n_pages"), texts.alias("pages"))
    return grouped.select("homepage", "part", "n_pages", F.array_join("pages.text", " ").alias("raw_text"))


def site_contacts(pages: DataFrame) -> DataFrame:
    """``(homepage, phones, emails, address)``: what the pages of a site show, each value once, sorted.

    A match lies within one page.  Values are folded as rows before they become one list per site.
    """

    def tagged(kind, values):
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    shown = F.col("text")
    found = F.concat(
        tagged("phone", text.phones(shown)), tagged("email", text.emails(shown)), tagged("address", text.addresses(shown))
    )
    rows = pages.where(shown.isNotNull()).select("homepage", F.explode(found).alias("hit"))
    once = rows.select("homepage", "hit.kind", "hit.value").distinct()

    def values(kind):
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value"))))

    return once.groupBy("homepage").agg(
        values("phone").alias("phones"), values("email").alias("emails"), values("address").alias("address")
    )


def site_report(
    pages: DataFrame, keywords: DataFrame | None = None, addresses: DataFrame | None = None, texts: DataFrame | None = None
) -> DataFrame:
    """One nested report row per site.

    ``keywords`` is ``(homepage, yake_tags)``; ``addresses`` is ``(homepage, address)`` and replaces the
    addresses as found.  ``texts`` is ``(homepage, txt)``: the ``raw_text`` of a report is the text its record is
    made of, null for a site too short for one; the whole text of the site is in the parts table.
    """
    none = F.array().cast("array<string>")
    listed = F.array_sort(F.collect_list(F.struct("position", "link")))
    report = pages.groupBy("homepage").agg(listed.alias("listed")).select("homepage", F.col("listed.link").alias("subdomains"))
    contacts = site_contacts(pages)
    if addresses is not None:
        contacts = contacts.drop("address").join(addresses, "homepage", "left")
    report = report.join(contacts, "homepage", "left")
    report = report.join(keywords, "homepage", "left") if keywords is not None else report.withColumn("yake_tags", none)
    report = report.join(texts, "homepage", "left") if texts is not None else report.withColumn("txt", F.lit(None).cast("string"))
    return report.select(
        "homepage",
        F.struct(
            "subdomains",
            F.coalesce("address", none).alias("addresses"),
            F.coalesce("phones", none).alias("phoneNumbers"),
            F.coalesce("emails", none).alias("emails"),
            F.coalesce("yake_tags", none).alias("yake_tags"),
            F.col("txt").alias("raw_text"),
        ).alias("subdomain_reports"),
    )


def record_texts(site_texts: DataFrame) -> DataFrame:
    """``(homepage, txt)`` for extraction: the cleaned site text behind the length gate, null when short.

    Parts that clean to nothing add nothing, and every other part adds a character and a blank, so
    the first ``SITE_TEXT_LONG // 2`` of them decide the result exactly.  They are picked by size alone;
    only the parts that reach into the result bring their text along.
    """
    cleaned = site_texts.select("homepage", "part", text.clean_text(F.col("raw_text")).alias("text"))
    cleaned = cleaned.where("text <> ''")
    sizes = cleaned.select("homepage", "part", F.length("text").alias("size"))
    first = top_k(sizes, ["homepage"], ["part"], C.SITE_TEXT_LONG // 2)
    earlier = Window.partitionBy("homepage").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    needed = first.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    needed = needed.where(F.col("before") < C.SITE_TEXT_LONG).select("homepage", "part")
    head = F.substring("text", 1, C.SITE_TEXT_LONG).alias("text")
    parts = cleaned.select("homepage", "part", head).join(needed, ["homepage", "part"])
    in_order = F.array_sort(F.collect_list(F.struct("part", "text")))
    joined = parts.groupBy("homepage").agg(in_order.alias("parts")).select(
        "homepage", F.array_join("parts.text", " ").alias("text")
    )
    return (
        site_texts.select("homepage")
        .distinct()
        .join(joined, "homepage", "left")
        .select("homepage", text.clean_text(F.coalesce("text", F.lit(""))).alias("txt"))
        .withColumn("txt", text.gated(F.col("txt")))
    )


def pages_in_order(pages: DataFrame, key: str, url: str) -> DataFrame:
    """All pages of each key numbered by (address length, address)."""
    sized = pages.select(key, F.col(url).alias("link"), F.length(url).alias("size")).distinct()
    return rank_within(sized, [key], ["size", "link"]).drop("size")

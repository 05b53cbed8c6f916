"""Routing of links into homepages, sub-pages and denied links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemill.constants import DENY_HOSTS
from sitemill.functions import urls

INVALID_LINK = "invalid_link"


def route_links(links: DataFrame, deny_hosts: Sequence[str] = DENY_HOSTS) -> DataFrame:
    """One output row per input row: the homepage it contributes and the roles of the link itself.

    A link that is its own origin is a homepage as given, and the deny list does not apply to it.
    Any other link is a sub-page; its origin becomes a homepage unless the host is denied.
    """
    link = F.col("link")
    valid = F.coalesce((urls.scheme(link) != "") & (urls.host(link) != ""), F.lit(False))
    own = urls.is_origin(link)
    denied = urls.is_denied(link, deny_hosts)
    return links.select(
        link,
        F.when(valid & own, link).when(valid & ~denied, urls.origin(link)).alias("homepage"),
        (valid & ~own).alias("is_subdomain"),
        (valid & ~own & denied).alias("dont_scrape"),
        F.when(~valid, INVALID_LINK).alias("failure_reason"),
    )


def homepages(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("homepage").isNotNull()).select("homepage")


def subdomains(routed: DataFrame, honour_deny_list: bool = False) -> DataFrame:
    kept = F.col("is_subdomain") & ~F.col("dont_scrape") if honour_deny_list else F.col("is_subdomain")
    return routed.where(kept).select("link")


def dont_scrape(routed: DataFrame) -> DataFrame:
    return routed.where("dont_scrape").select("link")


def counters() -> list[Column]:
    """What is counted of routed links, in a query or while they are written."""
    return [
        F.count("homepage").alias("n_homepages"),
        F.count_if("is_subdomain").alias("n_subdomains"),
        F.count_if("dont_scrape").alias("n_dont_scrape"),
        F.count("failure_reason").alias("n_invalid"),
    ]


def link_counts(routed: DataFrame) -> DataFrame:
    return routed.agg(*counters())


def good_links(links: DataFrame) -> DataFrame:
    """Distinct cleaned links that pass the link filter, in order."""
    link = F.col("link")
    return links.where(urls.is_good(link)).select(urls.clean_url(link).alias("link")).distinct().orderBy("link")

"""Sources, routing and URL queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqlparts as S
from checks import tables as T
from sitemill.constants import DENY_HOSTS
from sitemill.functions import markup, urls
from sitemill.operators import routing
from sitemill.sources import inputs, page_store
from sitemill.workspace import new_path

# The given pages hold none of the fixed deny hosts, so one host of the data joins them.
DENIED = (*DENY_HOSTS, "spam-farm.example.org")

LINKS = f"links AS (SELECT url AS link FROM pages UNION ALL SELECT DISTINCT {S.origin('url')} FROM pages)"


def link_source(spark, sf_dir):
    joined = T.pages(spark, sf_dir).select("page_id", F.concat_ws(",", "url", urls.origin(F.col("url"))).alias("given"))
    return inputs.split_list(joined, F.col("given"), "link").select(
        "page_id", F.col("position").cast("bigint").alias("position"), "link"
    )


LINK_SOURCE = f"""
SELECT page_id, unnest(range(0, len(items)))::BIGINT AS position, unnest(items) AS link
FROM (SELECT page_id, string_split(url || ',' || {S.origin('url')}, ',') AS items FROM pages)
"""


def vocab_source(spark, sf_dir):
    part = T.table(spark, sf_dir, "part").select(F.concat_ws(",", "p_name", "p_brand", "p_type").alias("given"))
    return inputs.vocabulary(spark, inputs.split_list(part, F.col("given"), "term"))


VOCAB_SOURCE = """
SELECT DISTINCT term FROM (
  SELECT unnest(string_split(concat_ws(',', p_name, p_brand, p_type), ',')) AS term FROM part) WHERE term <> ''
"""


def page_fetch(spark, sf_dir):
    return inputs.fetch(T.links(spark, sf_dir), inputs.PageStore(T.pages(spark, sf_dir)))


def indexed_fetch(spark, sf_dir):
    """The same look-up in a store that is written first."""
    path = page_store.write_pages(T.pages(spark, sf_dir), new_path(spark, "page-store"))
    return inputs.fetch(T.links(spark, sf_dir), page_store.IndexedPages(spark, path))


PAGE_TEXTS = f"""facts AS (SELECT url, min(text) AS text FROM (
  SELECT {S.page_key('url')} AS url, {S.page_text('html')} AS text FROM pages) GROUP BY 1)"""

PAGE_FETCH = f"""
WITH {LINKS}, {PAGE_TEXTS}
SELECT l.link, f.text FROM links l LEFT JOIN facts f ON {S.page_key('l.link')} = f.url
"""


def url_split(spark, sf_dir):
    u = F.col("url")
    return T.pages(spark, sf_dir).select(
        "page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("netloc"), urls.path(u).alias("path")
    )


URL_SPLIT = f"""
SELECT page_id, {S.scheme('url')} AS scheme, {S.host('url')} AS netloc, {S.path('url')} AS path FROM pages
"""


def url_origin(spark, sf_dir):
    return T.pages(spark, sf_dir).select("page_id", urls.origin(F.col("url")).alias("origin"))


URL_ORIGIN = f"SELECT page_id, {S.origin('url')} AS origin FROM pages"


def route_links(spark, sf_dir):
    return routing.route_links(T.links(spark, sf_dir), DENIED)


def route_links_plain(spark, sf_dir):
    return routing.route_links(T.links(spark, sf_dir), ())


def _route_sql(deny):
    hosts = ", ".join(S.lit(h) for h in deny) or "''"
    own = f"(link = {S.origin('link')} OR link = {S.origin('link')} || '/')"
    valid = f"({S.scheme('link')} <> '' AND {S.host('link')} <> '')"
    denied = f"({S.host('link')} IN ({hosts}))"
    return f"""
WITH {LINKS}
SELECT link,
  CASE WHEN {valid} AND {own} THEN link WHEN {valid} AND NOT {denied} THEN {S.origin('link')} END AS homepage,
  {valid} AND NOT {own} AS is_subdomain,
  {valid} AND NOT {own} AND {denied} AS dont_scrape,
  CASE WHEN NOT {valid} THEN 'invalid_link' END AS failure_reason
FROM links
"""


ROUTE_LINKS = _route_sql(DENIED)
ROUTE_LINKS_PLAIN = _route_sql(())


def job_counts(spark, sf_dir):
    return routing.link_counts(route_links(spark, sf_dir))


JOB_COUNTS = f"""
SELECT count(homepage) AS n_homepages, count(*) FILTER (is_subdomain) AS n_subdomains,
  count(*) FILTER (dont_scrape) AS n_dont_scrape, count(failure_reason) AS n_invalid
FROM ({ROUTE_LINKS})
"""


def page_links(spark, sf_dir):
    p = T.pages(spark, sf_dir)
    found = markup.page_links(F.col("url"), F.col("html"))
    return p.select("page_id", F.posexplode(found).alias("position", "link")).select(
        "page_id", F.col("position").cast("bigint").alias("position"), "link"
    )


PAGE_LINKS = f"""
WITH hrefs AS (
  SELECT page_id, url, unnest(range(0, len(found)))::BIGINT AS position, unnest(found) AS href
  FROM (SELECT page_id, url, {S.anchors('html')} AS found FROM pages))
SELECT page_id, position, {S.resolve('url', 'href')} AS link FROM hrefs
"""


def _page_link_rows(spark, sf_dir):
    return page_links(spark, sf_dir).select("link").unionByName(T.links(spark, sf_dir))


def good_links(spark, sf_dir):
    return routing.good_links(_page_link_rows(spark, sf_dir))


ALL_LINKS = f"{LINKS}, all_links AS (SELECT link FROM links UNION ALL SELECT link FROM ({PAGE_LINKS}))"

GOOD_LINKS = f"""
WITH {ALL_LINKS}
SELECT DISTINCT {S.clean_url('link')} AS link FROM all_links WHERE {S.is_good('link')}
"""


def priority_links(spark, sf_dir):
    link = F.col("link")
    return _page_link_rows(spark, sf_dir).distinct().select(link, urls.is_priority(link).alias("is_priority"))


PRIORITY_LINKS = f"""
WITH {ALL_LINKS} SELECT DISTINCT link, {S.is_priority('link')} AS is_priority FROM all_links
"""

QUERIES = {
    "link_source": (link_source, LINK_SOURCE),
    "vocab_source": (vocab_source, VOCAB_SOURCE),
    "page_fetch": (page_fetch, PAGE_FETCH),
    "indexed_fetch": (indexed_fetch, PAGE_FETCH),
    "url_split": (url_split, URL_SPLIT),
    "url_origin": (url_origin, URL_ORIGIN),
    "route_links": (route_links, ROUTE_LINKS),
    "route_links_plain": (route_links_plain, ROUTE_LINKS_PLAIN),
    "job_counts": (job_counts, JOB_COUNTS),
    "page_links": (page_links, PAGE_LINKS),
    "good_links": (good_links, GOOD_LINKS),
    "priority_links": (priority_links, PRIORITY_LINKS),
}

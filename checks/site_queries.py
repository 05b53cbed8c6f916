"""Discovery and whole-site queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqlparts as S
from checks import tables as T
from checks.link_queries import PAGE_LINKS, PAGE_TEXTS, _page_link_rows  # noqa: F401
from sitemill import constants as C
from sitemill.functions import markup, text, urls
from sitemill.operators import discovery, sites
from sitemill.sources import inputs


def _site_links(spark, sf_dir):
    p = T.pages(spark, sf_dir)
    home = urls.origin(F.col("url")).alias("homepage")
    anchors = F.explode(markup.page_links(F.col("url"), F.col("html"))).alias("link")
    return p.select(home, F.col("url").alias("link")).unionByName(p.select(home, anchors))


def rank_site_links(spark, sf_dir):
    return discovery.rank_site_links(_site_links(spark, sf_dir))


def _rank_sql(found: str) -> str:
    """CTEs that rank the rows of ``found(homepage, link)`` into ``ranked``."""
    junk = "(ends_with(link, '/\"') OR ends_with(link, '\\'))"
    clean = S.clean_url("link")
    return f"""
usable AS (
  SELECT homepage, CASE WHEN {junk} THEN translate(link, '"\\', '') ELSE {clean} END AS link,
    NOT {junk} AND {S.is_priority(clean)} AS priority, false AS own
  FROM {found} WHERE link IS NOT NULL AND NOT ends_with(link, homepage || '/')
    AND NOT ends_with(homepage, link || '/') AND ({junk} OR {S.is_good('link')})),
merged AS (SELECT homepage, link, bool_or(priority) AS priority, bool_or(own) AS own FROM (
  SELECT * FROM usable UNION ALL SELECT homepage, homepage, false, true FROM {found}) GROUP BY 1, 2),
flagged AS (SELECT *, bool_or(priority) OVER (PARTITION BY homepage) AS site_priority FROM merged),
ranked AS (SELECT homepage, row_number() OVER (PARTITION BY homepage ORDER BY
  (site_priority AND NOT priority AND NOT own)::INT, length(link), link) AS position, link FROM flagged)"""


RANK_SITE_LINKS = f"""
WITH site_links AS (SELECT {S.origin('url')} AS homepage, url AS link FROM pages
  UNION ALL SELECT {S.origin('url')}, l.link FROM ({PAGE_LINKS}) l JOIN pages USING (page_id)),
{_rank_sql('site_links')}
SELECT homepage, position, link FROM ranked
"""


def one_hop(spark, sf_dir):
    """Every stored page taken as a start."""
    p = T.pages(spark, sf_dir)
    starts = p.select(urls.clean_url(F.col("url")).alias("homepage")).distinct()
    keys = starts.select(urls.page_key(F.col("homepage")).alias("url")).distinct()
    return discovery.one_hop(starts, inputs.PageStore(p).edges(keys))


ONE_HOP = f"""
WITH edges AS (SELECT {S.clean_url('p.url')} AS homepage, {S.clean_url('l.link')} AS link, min(position) AS seen
  FROM ({PAGE_LINKS}) l JOIN pages p USING (page_id)
  WHERE lower({S.host('l.link')}) = lower({S.host('p.url')}) GROUP BY 1, 2),
known AS (SELECT *, row_number() OVER (PARTITION BY homepage ORDER BY seen, link) AS n FROM edges)
SELECT homepage, link FROM known WHERE n <= {C.KNOWN_URL_CAP}
"""

TREE = f"""
leaves AS (SELECT {S.origin('url')} AS origin, regexp_extract({S.path('url')}, '^(/[^/]+)/', 1) AS top,
  {S.clean_url('url')} AS url FROM pages),
tree AS (SELECT DISTINCT origin AS src, origin || top AS dst FROM leaves WHERE top <> ''
  UNION SELECT origin || top, url FROM leaves WHERE top <> '')"""


def _origins(spark, sf_dir):
    return T.pages(spark, sf_dir).select(urls.origin(F.col("url")).alias("homepage")).distinct()


def prefix_crawl(spark, sf_dir):
    return discovery.prefix_crawl(_origins(spark, sf_dir), T.page_tree(spark, sf_dir))


def _crawl_sql(starts: str) -> str:
    return f"""
crawl AS (SELECT homepage, {S.clean_url('homepage')} AS url, 0::BIGINT AS depth FROM {starts}
  UNION SELECT c.homepage, t.dst, c.depth + 1 FROM crawl c JOIN tree t ON t.src = c.url
  WHERE starts_with(t.dst, t.src) AND t.dst <> t.src
    AND (ends_with(t.src, '/') OR substr(t.dst, length(t.src) + 1, 1) IN ('/', '?', '#')))"""


PREFIX_CRAWL = f"""
WITH RECURSIVE origins AS (SELECT DISTINCT {S.origin('url')} AS homepage FROM pages), {TREE}, {_crawl_sql('origins')}
SELECT homepage, url, min(depth) AS depth FROM crawl GROUP BY 1, 2
"""


def sitemap_topn(spark, sf_dir):
    return discovery.sitemap_top(inputs.PageStore(T.pages(spark, sf_dir)).published(_origins(spark, sf_dir)))


def _sitemap_sql(source: str) -> str:
    return f"""
listed AS (SELECT homepage, link, row_number() OVER (PARTITION BY homepage ORDER BY length(link), link) AS position
  FROM (SELECT DISTINCT {S.origin('url')} AS homepage, {S.clean_url('url')} AS link FROM {source}))"""


SITEMAP_TOPN = f"""
WITH {_sitemap_sql('pages')}
SELECT homepage, position, link FROM listed WHERE position <= {C.SITEMAP_CAP}
"""


def discover_sites(spark, sf_dir):
    """All origins over the page tree: sites with several sections come from one hop, others from the crawl."""
    store = inputs.PageStore(T.pages(spark, sf_dir), extra_edges=T.page_tree(spark, sf_dir))
    sites_found, _ = discovery.discover_sites(_origins(spark, sf_dir), store)
    return sites_found.withColumn("method", discovery.method_name(F.col("method")))


FOUND_SITES = f"""
{TREE},
known AS (SELECT homepage, dst AS link, row_number() OVER (PARTITION BY homepage ORDER BY length(dst), dst) AS n
  FROM origins JOIN tree ON src = {S.clean_url('homepage')} WHERE lower({S.host('dst')}) = lower({S.host('homepage')})),
hop_found AS (SELECT homepage, link FROM known WHERE n <= {C.KNOWN_URL_CAP}),
hop AS (WITH {_rank_sql('hop_found')} SELECT * FROM ranked),
hop_ok AS (SELECT homepage FROM hop GROUP BY 1 HAVING count(*) > {C.MIN_SITE_LINKS}),
rest AS (SELECT homepage FROM origins WHERE homepage NOT IN (FROM hop_ok)),
{_crawl_sql('rest')},
crawl_found AS (SELECT DISTINCT c.homepage, c.url AS link FROM crawl c JOIN facts f ON f.url = c.url WHERE f.text IS NOT NULL),
crawled AS (WITH {_rank_sql('crawl_found')} SELECT * FROM ranked),
{_sitemap_sql('facts')},
found_sites AS (
SELECT homepage, 'one_hop' AS method, position, link FROM hop WHERE homepage IN (FROM hop_ok)
UNION ALL SELECT homepage, 'crawl', position, link FROM crawled
UNION ALL SELECT homepage, 'sitemap', position, link FROM listed
  WHERE position <= {C.SITEMAP_CAP} AND homepage IN (FROM rest) AND homepage NOT IN (SELECT homepage FROM crawled))
"""

DISCOVER_SITES = f"""
WITH RECURSIVE origins AS (SELECT DISTINCT {S.origin('url')} AS homepage FROM pages), {PAGE_TEXTS}, {FOUND_SITES}
SELECT homepage, method, position, link FROM found_sites
"""


def _page_rows(spark, sf_dir):
    p = T.pages(spark, sf_dir)
    clean = p.select(urls.origin(F.col("url")).alias("homepage"), urls.clean_url(F.col("url")).alias("url"))
    return sites.page_rows(sites.pages_in_order(clean, "homepage", "url"), inputs.page_texts(p))


def _site_texts(spark, sf_dir):
    return sites.site_texts(_page_rows(spark, sf_dir))


def site_text(spark, sf_dir):
    return _site_texts(spark, sf_dir)


SITE_PAGES = f"""{PAGE_TEXTS}, {_sitemap_sql('pages')},
site_pages AS (SELECT homepage, position, link, text
  FROM listed LEFT JOIN facts ON {S.is_good('link')} AND facts.url = {S.page_key('link')})"""

SITE_TEXTS = f"""{SITE_PAGES},
site_texts AS (SELECT homepage, (position - 1) // {sites.PAGES_PER_PART} AS part, count(*) AS n_pages,
  coalesce(string_agg(text, ' ' ORDER BY position), '') AS raw_text FROM site_pages GROUP BY 1, 2)"""

SITE_TEXT = f"WITH {SITE_TEXTS} SELECT homepage, part, n_pages, raw_text FROM site_texts"


def site_report(spark, sf_dir):
    r = F.col("subdomain_reports")
    return sites.site_report(_page_rows(spark, sf_dir)).select(
        "homepage",
        F.array_join(r["subdomains"], "|").alias("subdomains"),
        F.array_join(r["phoneNumbers"], "|").alias("phones"),
        F.array_join(r["emails"], "|").alias("emails"),
        F.array_join(r["addresses"], "|").alias("addresses"),
    )


def _site_values(pattern: str, group: int = 0) -> str:
    """Distinct matches of the pages of site s."""
    found = f"SELECT DISTINCT unnest({S.matches('text', pattern, group)}) AS v FROM site_pages p WHERE p.homepage = s.homepage"
    return f"coalesce((SELECT string_agg(v, '|' ORDER BY v) FROM ({found})), '')"


SITE_REPORT = f"""
WITH {SITE_PAGES}, s AS (SELECT homepage, string_agg(link, '|' ORDER BY position) AS subdomains FROM site_pages GROUP BY 1)
SELECT homepage, subdomains, {_site_values(C.PHONE)} AS phones, {_site_values(C.EMAIL)} AS emails,
  {_site_values(text.US_ADDRESS, 1)} AS addresses FROM s
"""


def site_record_text(spark, sf_dir):
    return sites.record_texts(_site_texts(spark, sf_dir))


SITE_RECORD_TEXT = f"""
WITH {SITE_TEXTS}, whole AS (SELECT homepage, string_agg(raw_text, ' ' ORDER BY part) AS raw_text FROM site_texts GROUP BY 1)
SELECT homepage, {S.gated('raw_text')} AS txt FROM whole
"""

QUERIES = {
    "rank_site_links": (rank_site_links, RANK_SITE_LINKS),
    "one_hop": (one_hop, ONE_HOP),
    "prefix_crawl": (prefix_crawl, PREFIX_CRAWL),
    "sitemap_topn": (sitemap_topn, SITEMAP_TOPN),
    "discover_sites": (discover_sites, DISCOVER_SITES),
    "site_text": (site_text, SITE_TEXT),
    "site_report": (site_report, SITE_REPORT),
    "site_record_text": (site_record_text, SITE_RECORD_TEXT),
}

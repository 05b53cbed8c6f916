"""Discovery of the pages of a site: one hop, prefix-bounded crawl, published list, and the cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitemill import constants as C
from sitemill.functions import urls
from sitemill.operators.ranking import rank_within, top_k
from sitemill.sources import inputs
from sitemill.workspace import stage

ONE_HOP, CRAWL, SITEMAP = 1, 2, 3
METHOD_NAMES = {ONE_HOP: "one_hop", CRAWL: "crawl", SITEMAP: "sitemap"}


def _usable(found: DataFrame) -> DataFrame:
    """Distinct usable ``(homepage, link)`` rows, each homepage included.

    Self links are dropped, links with a junk suffix repaired and taken unchecked, all others must
    pass the link filter and are cleaned.
    """
    home, link = F.col("homepage"), F.col("link")
    junk = urls.has_junk_suffix(link)
    clean = urls.clean_url(link)
    usable = link.isNotNull() & ~urls.is_self_link(home, link) & (junk | urls.is_good(link))
    shown = F.when(junk, urls.strip_junk(link)).otherwise(clean)
    page = F.struct(shown.alias("link"), (~junk & urls.is_priority(clean)).alias("priority"), F.lit(False).alias("own"))
    own = F.struct(home.alias("link"), F.lit(False).alias("priority"), F.lit(True).alias("own"))
    rows = found.select(home, F.explode(F.array(F.when(usable, page), own)).alias("row")).where("row IS NOT NULL")
    return (
        rows.select("homepage", "row.*")
        .groupBy("homepage", "link")
        .agg(F.max("priority").alias("priority"), F.max("own").alias("own"))
    )


def _sort_group(pages: DataFrame) -> DataFrame:
    """Add the sort fields: when a site has a priority page, its priority pages and the homepage come
    before the rest; otherwise all pages sort together.

    The join key is the site, which may be skewed; the ranking that follows brings its own exchange,
    so adaptive execution is free to split the join.
    """
    sites = pages.where("priority").select("homepage", F.lit(True).alias("site_priority")).distinct()
    late = F.coalesce("site_priority", F.lit(False)) & ~F.col("priority") & ~F.col("own")
    return pages.join(sites, "homepage", "left").select(
        "homepage", late.cast("int").alias("late"), F.length("link").alias("size"), "link"
    )


RANK_ORDER = ("late", "size", "link")


def rank_site_links(found: DataFrame) -> DataFrame:
    """Crawl results ``(homepage, link)`` in visiting order; sites of any size."""
    ranked = rank_within(_sort_group(stage(_usable(found), "usable")), ["homepage"], RANK_ORDER)
    return ranked.select("homepage", "position", "link")


def _rank_small_sites(found: DataFrame) -> DataFrame:
    """As ``rank_site_links`` where every site has a bounded number of links."""
    place = F.row_number().over(Window.partitionBy("homepage").orderBy(*RANK_ORDER))
    return _sort_group(stage(_usable(found), "usable")).select("homepage", place.cast("bigint").alias("position"), "link")


def one_hop(homepages: DataFrame, edges: DataFrame) -> DataFrame:
    """Links found on the homepage itself that stay on its host, the first hundred in page order."""
    starts = homepages.distinct().withColumn("src", urls.page_key(F.col("homepage")))
    found = starts.join(inputs.keyed_edges(edges), "src")
    found = found.where(F.lower(urls.host(F.col("dst"))) == F.lower(urls.host(F.col("homepage"))))
    known = found.groupBy("homepage", F.col("dst").alias("link")).agg(F.min("position").alias("seen"))
    return top_k(known, ["homepage"], ["seen", "link"], C.KNOWN_URL_CAP, "known").select("homepage", "link")


def _stretches(key: Column) -> Column:
    """All beginnings of a key that it may extend, and the key itself.  Scheme and bare host are no pages."""
    pieces = F.split(key, r"(?<=/)|(?=[/?#])")
    first = F.when(key.rlike("^[^/?#]+://"), 5).otherwise(1)
    return F.transform(F.sequence(F.least(first, F.size(pieces)), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, 1, n), ""))


def _shortest(chain: Column, start: Column) -> Column:
    """The end of the chain as ``struct<size, depth, url>``: its distance from the page of length ``start``.

    The chain is in order of length and links lead to longer pages only, so one pass settles every page.
    """
    begin = F.struct(start.alias("size"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("string").alias("url"))

    def step(settled: Column, page: Column) -> Column:
        def ways(before: Column) -> Column:
            used = F.filter(page["edges"], lambda e: e["source"] == before["size"])
            return F.transform(used, lambda e: F.struct((before["depth"] + 1).alias("depth"), e["url"].alias("url")))

        best = F.slice(F.array_sort(F.flatten(F.transform(settled, ways))), 1, 1)
        here = F.transform(best, lambda w: F.struct(page["size"].alias("size"), w["depth"].alias("depth"), w["url"].alias("url")))
        return F.concat(settled, here)

    later = F.filter(chain, lambda page: page["size"] > start)
    return F.aggregate(later, F.array(begin), step, lambda settled: F.element_at(settled, -1))


def prefix_crawl(homepages: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """All pages reachable from a homepage through links that lie below the page they are found on.

    Returns ``(homepage, url, depth)`` with the homepage at depth 0; ``max_rounds`` is for callers who
    want a shallower crawl.  Such a link is longer than its source and begins with it, so everything on
    a way to a page is a beginning of that page's key.  Each page therefore gathers the links between its
    own beginnings, a chain no longer than its key, and finds its distance from the homepages among them:
    one join and one grouping for a crawl of any depth, with no rounds and nothing carried between them.
    The beginnings of a large site are hot in that join and the homepage in the next one; both have few
    rows on the other side and are followed by an exchange on another key or by none, so Spark may split them.
    """
    home, key = F.col("homepage"), F.col("key")
    start = homepages.distinct().select(home, urls.clean_url(home).alias("url"), urls.page_key(home).alias("key"))
    start = stage(start, "starts")
    linked = inputs.keyed_edges(edges).withColumn("key", urls.rooted(F.col("dst")))
    below = linked.where(urls.extends(key, F.col("src"))).groupBy("key", F.length("src").alias("source")).agg(F.min("dst").alias("url"))
    rows = below.select("key", F.struct("source", "url").alias("edge"), F.lit(False).alias("home"))
    rows = rows.unionByName(start.select("key", F.lit(None).cast(rows.schema["edge"].dataType).alias("edge"), F.lit(True).alias("home")))
    # At most one link per separator of the key, so the list is no longer than the key.
    pages = stage(rows.groupBy("key").agg(F.collect_list("edge").alias("edges"), F.max("home").alias("home")), "crawl-pages")

    linked_to = pages.where(F.size("edges") > 0).select("key", F.explode(_stretches(key)).alias("stretch"))
    steps = linked_to.join(pages.withColumnRenamed("key", "stretch"), "stretch")
    bare = F.transform("edges", lambda e: F.struct(e["source"].alias("source"), F.when(F.col("stretch") == key, e["url"]).alias("url")))
    page = F.struct(F.length("stretch").alias("size"), bare.alias("edges"), "home")
    chains = steps.groupBy("key").agg(F.array_sort(F.collect_list(page)).alias("chain"))
    homes = F.filter("chain", lambda p: p["home"] & (p["size"] < F.length(key)))
    asked = chains.select("key", "chain", F.explode(F.transform(homes, lambda p: p["size"])).alias("start"))
    found = asked.select("key", "start", _shortest(F.col("chain"), F.col("start")).alias("end")).where(F.col("end.size") == F.length(key))
    reached = found.select(F.expr("substr(key, 1, start)").alias("key"), "end.url", "end.depth")
    if max_rounds is not None:
        reached = reached.where(F.col("depth") <= max_rounds)
    below_homes = reached.join(start.select("homepage", "key"), "key").select("homepage", "url", "depth")
    return start.select("homepage", "url", F.lit(0).cast("bigint").alias("depth")).unionByName(below_homes)


def sitemap_top(sitemap: DataFrame) -> DataFrame:
    """Published pages per homepage, shortest first; a longer list is cut to the first 29."""
    listed = sitemap.select("homepage", F.col("url").alias("link")).distinct()
    listed = listed.withColumn("size", F.length("link"))
    return top_k(listed, ["homepage"], ["size", "link"], C.SITEMAP_CAP).select("homepage", "position", "link")


def discover_sites(homepages: DataFrame, store: inputs.PageStore) -> tuple[DataFrame, DataFrame]:
    """Pages of each site by the first method that works, and the homepages where none does.

    One hop counts when it ranks more than two links; the crawl counts when it reaches a page with
    text; the published list counts when it is not empty.  Each method runs only on the homepages
    the earlier ones left over, and asks the store for no more than that.
    """
    homes = stage(homepages.select("homepage").distinct(), "homepages")

    starts = homes.select(urls.page_key(F.col("homepage")).alias("url")).distinct()
    hop = _rank_small_sites(one_hop(homes, store.edges(starts)))
    enough = F.count("*").over(Window.partitionBy("homepage")) > C.MIN_SITE_LINKS
    hop = stage(hop.withColumn("_enough", enough).where("_enough").drop("_enough"), "hop")
    rest = stage(homes.join(hop, "homepage", "left_anti"), "rest")

    of_rest = rest.select(urls.site_key(F.col("homepage")).alias("site")).distinct()
    visited = prefix_crawl(rest, store.site_edges(of_rest)).withColumn("key", urls.rooted(F.col("url")))
    readable = store.texts(visited.select(F.col("key").alias("url")).distinct()).where(F.col("text").isNotNull())
    readable = readable.select(F.col("url").alias("key"))
    crawled = visited.join(readable, "key", "left_semi").select("homepage", F.col("url").alias("link"))
    crawl = rank_site_links(crawled)
    crawl = stage(crawl, "crawl")
    left = stage(rest.join(crawl, "homepage", "left_anti"), "left")

    listed = sitemap_top(store.published(left))
    found = (
        hop.withColumn("method", F.lit(ONE_HOP))
        .unionByName(crawl.withColumn("method", F.lit(CRAWL)))
        .unionByName(listed.withColumn("method", F.lit(SITEMAP)))
    )
    found = stage(found.select("homepage", "method", F.col("position").cast("bigint").alias("position"), "link"), "sites")
    return found, left.join(found, "homepage", "left_anti")


def method_name(method: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in METHOD_NAMES.items() for x in pair]), method)

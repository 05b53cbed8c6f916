import os
import random

from pyspark.sql import functions as F

from sitemill.operators import discovery, site_keywords, sites
from sitemill.operators.ranking import rank_within, top_k
from sitemill.sources import inputs
from sitemill.workspace import staging_root

HOME = "https://a.org"


def _found(spark, links):
    return spark.createDataFrame([(HOME, x) for x in links], "homepage string, link string")


def _ranked(df):
    return [r.link for r in df.orderBy("position").collect()]


def test_ranking_with_priority_pages(spark):
    links = [HOME + "/zeta", HOME + "/about-us", HOME + "/b", HOME + "/", None]
    want = [HOME, HOME + "/about-us", HOME + "/b", HOME + "/zeta"]
    assert _ranked(discovery.rank_site_links(_found(spark, links))) == want
    assert _ranked(discovery._rank_small_sites(_found(spark, links))) == want


def test_ranking_without_priority_pages(spark):
    got = discovery.rank_site_links(_found(spark, [HOME + "/zeta", HOME + "/b", "http://b.io"]))
    assert _ranked(got) == ["http://b.io", HOME, HOME + "/b", HOME + "/zeta"]


def test_ranking_scans_its_input_once(spark):
    found = spark.range(3).selectExpr("'https://a.org' AS homepage", "concat('https://a.org/', id) AS link")
    plan = discovery._usable(found)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 3") == 1


def test_junk_suffix_is_repaired_and_not_validated(spark):
    assert _ranked(discovery.rank_site_links(_found(spark, [HOME + "/b\\"]))) == [HOME, HOME + "/b"]
    assert _ranked(discovery.rank_site_links(_found(spark, ["ftp:/about/\""]))) == ["ftp:/about/", HOME]


def test_rank_within_matches_brute_force_on_a_hot_group(spark):
    rng = random.Random(7)
    rows = list({("hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}", rng.randrange(5), str(rng.random())) for _ in range(5000)})
    got = rank_within(spark.createDataFrame(rows, "k string, a int, b string").repartition(7), ["k"], ["a", "b"])
    groups = {}
    for k, a, b in rows:
        groups.setdefault(k, []).append((a, b))
    want = {(k, a, b): i + 1 for k, v in groups.items() for i, (a, b) in enumerate(sorted(v))}
    assert {(r.k, r.a, r.b): r.position for r in got.collect()} == want


def test_top_k_matches_brute_force_on_a_hot_group(spark):
    rng = random.Random(8)
    rows = [("hot" if i % 3 else f"k{i % 50}", rng.random()) for i in range(4000)]
    got = top_k(spark.createDataFrame(rows, "k string, x double").repartition(9), ["k"], ["x"], 7)
    groups = {}
    for k, x in rows:
        groups.setdefault(k, []).append(x)
    want = {(k, x, i + 1) for k, v in groups.items() for i, x in enumerate(sorted(v)[:7])}
    assert {(r.k, r.x, r.position) for r in got.collect()} == want


def test_top_k_cuts_before_the_shuffle(spark):
    df = top_k(spark.range(100).withColumn("k", F.col("id") % 3), ["k"], ["id"], 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Partial") == 2  # one group limit below each of the two exchanges


EDGES = [
    (HOME, HOME + "/x"),
    (HOME + "/x", HOME + "/x/y"),
    (HOME + "/x", HOME + "/z"),
    (HOME + "/x/y", HOME),
    (HOME, "https://b.org"),
    (HOME, HOME + "/x"),
    (HOME, HOME),
]


def _edges(spark, pairs):
    return spark.createDataFrame([(s, i, d) for i, (s, d) in enumerate(pairs)], "src string, position int, dst string")


def test_prefix_crawl(spark):
    homes = spark.createDataFrame([(HOME,)], "homepage string")
    got = discovery.prefix_crawl(homes, _edges(spark, EDGES))
    assert {(r.url, r.depth) for r in got.collect()} == {(HOME, 0), (HOME + "/x", 1), (HOME + "/x/y", 2)}
    again = discovery.prefix_crawl(homes, _edges(spark, EDGES).unionByName(_edges(spark, EDGES)))
    assert again.count() == 3
    assert discovery.prefix_crawl(homes, _edges(spark, EDGES), max_rounds=1).count() == 2


def test_crawl_matches_brute_force(spark):
    rng = random.Random(3)
    nodes = [HOME] + [HOME + "".join("/" + rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(600)]
    seen, todo = {HOME}, [HOME]
    while todo:
        at = todo.pop()
        for s, d in pairs:
            if s == at and d.startswith(s + "/") and d not in seen:
                seen.add(d)
                todo.append(d)
    homes = spark.createDataFrame([(HOME,)], "homepage string")
    got = [r.url for r in discovery.prefix_crawl(homes, _edges(spark, pairs)).collect()]
    assert len(got) == len(set(got)) and set(got) == seen


def test_crawl_depths_match_brute_force(spark):
    """Nested homepages, queries and fragments as separators, both forms of the root: shortest ways and smallest addresses."""
    rng = random.Random(11)
    homes = [HOME, HOME + "/", HOME + "/a", HOME + "/a/", HOME + "/b?x"]
    tails = ["".join(rng.choice(("/", "/", "?", "#")) + rng.choice(("a", "b", "")) for _ in range(rng.randrange(1, 7))) for _ in range(90)]
    nodes = homes + [HOME + t for t in tails]
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(1500)]

    def rooted(u):
        rest = u[len(HOME) :]
        return u if rest.startswith("/") else HOME + "/" + rest

    def below(k, s):
        return k.startswith(s) and k != s and (s.endswith("/") or k[len(s)] in "/?#")

    want = set()
    for home in homes:
        seen, last, depth = {rooted(home)}, {rooted(home)}, 0
        want.add((home, home, 0))
        while last:
            depth += 1
            found = {}
            for s, d in pairs:
                if rooted(s) in last and below(rooted(d), rooted(s)) and rooted(d) not in seen:
                    found[rooted(d)] = min(d, found.get(rooted(d), d))
            want |= {(home, d, depth) for d in found.values()}
            seen |= set(found)
            last = set(found)
    got = discovery.prefix_crawl(spark.createDataFrame([(h,) for h in homes], "homepage string"), _edges(spark, pairs)).collect()
    assert len(got) == len(want) and {(r.homepage, r.url, r.depth) for r in got} == want


def test_crawl_of_any_depth_is_one_plan(spark):
    """A chain of sixty pages stages as many tables as a chain of two, and no table holds a round."""
    staged = []
    for n in (2, 60):
        chain = [HOME + "/x" * i for i in range(n + 1)]
        folder = staging_root(spark) + "/sitemill"
        before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
        got = discovery.prefix_crawl(spark.createDataFrame([(HOME,)], "homepage string"), _edges(spark, list(zip(chain, chain[1:], strict=False))))
        assert {(r.url, r.depth) for r in got.collect()} == {(u, i) for i, u in enumerate(chain)}
        staged.append(sorted(f.rsplit("-", 1)[0] for f in set(os.listdir(folder)) - before))
    assert staged[0] == staged[1] == ["crawl-pages", "starts"]


def test_one_hop_keeps_the_first_hundred(spark):
    pairs = [(HOME, f"{HOME}/{i:03d}") for i in range(130)]
    homes = spark.createDataFrame([(HOME,)], "homepage string")
    got = {r.link for r in discovery.one_hop(homes, _edges(spark, pairs)).collect()}
    assert got == {f"{HOME}/{i:03d}" for i in range(100)}


def test_sitemap_caps(spark):
    rows = [(f"https://s{n}.org", f"https://s{n}.org/" + "p" * i) for n in (29, 30, 40) for i in range(n)]
    got = discovery.sitemap_top(spark.createDataFrame(rows, "homepage string, url string"))
    assert {r.homepage: r["count"] for r in got.groupBy("homepage").count().collect()} == {
        f"https://s{n}.org": 29 for n in (29, 30, 40)
    }
    assert max(len(r.link) for r in got.collect()) == len("https://s29.org/") + 28


def test_cascade_uses_each_method(spark):
    homes = [f"https://{n}.org" for n in ("hop", "crawl", "map", "none")]
    pairs = [(homes[0], homes[0] + "/a"), (homes[0], homes[0] + "/b"), (homes[1], homes[1] + "/a"), (homes[2], homes[2] + "/a")]
    texts = spark.createDataFrame([(homes[1] + "/a", "text"), (homes[2] + "/a", None)], "url string, text string")
    listed = spark.createDataFrame([(h, h + "/s") for h in homes[:3]], "homepage string, url string")
    store = inputs.TableStore(_edges(spark, pairs), texts, listed)
    found, lost = discovery.discover_sites(spark.createDataFrame([(h,) for h in homes] * 2, "homepage string"), store)
    by_site = {}
    for r in found.orderBy("homepage", "position").collect():
        by_site.setdefault((r.homepage, r.method), []).append(r.link)
    assert by_site == {
        (homes[0], discovery.ONE_HOP): [homes[0], homes[0] + "/a", homes[0] + "/b"],
        (homes[1], discovery.CRAWL): [homes[1], homes[1] + "/a"],
        (homes[2], discovery.SITEMAP): [homes[2] + "/s"],
    }
    assert [r.homepage for r in lost.collect()] == [homes[3]]


def test_root_page_in_both_forms(spark):
    """With and without its slash, stored and asked, the root page is one page."""
    body = "<body>Home <a href='/a'>a</a><a href='/b'>b</a><a href='https://twitter.com/x'>t</a></body>"
    for stored in (HOME, HOME + "/"):
        pages = spark.createDataFrame([(stored, body)], "url string, html string")
        for asked in (HOME, HOME + "/"):
            found, lost = discovery.discover_sites(spark.createDataFrame([(asked,)], "homepage string"), inputs.PageStore(pages))
            rows = found.orderBy("position").collect()
            assert {r.method for r in rows} == {discovery.ONE_HOP} and lost.count() == 0
            assert {r.link for r in rows} == {asked, HOME + "/a", HOME + "/b"}


def test_listed_pages_of_a_homepage_with_slash(spark):
    pages = spark.createDataFrame([("https://b.org/x", "<body>text</body>")], "url string, html string")
    homes = spark.createDataFrame([("https://b.org/",), ("https://b.org",)], "homepage string")
    found, lost = discovery.discover_sites(homes, inputs.PageStore(pages))
    assert {(r.homepage, r.method, r.link) for r in found.collect()} == {
        (h, discovery.SITEMAP, "https://b.org/x") for h in ("https://b.org/", "https://b.org")
    }
    assert lost.count() == 0


def test_hop_and_crawl_stay_on_the_site(spark):
    homes = spark.createDataFrame([(HOME,)], "homepage string")
    pairs = [(HOME, "https://twitter.com/a"), (HOME, "https://a.org.evil.com/x"), (HOME, HOME + "/x"), (HOME + "/x", HOME + "/xy")]
    assert {r.link for r in discovery.one_hop(homes, _edges(spark, pairs)).collect()} == {HOME + "/x"}
    assert {r.url for r in discovery.prefix_crawl(homes, _edges(spark, pairs)).collect()} == {HOME, HOME + "/x"}


def _site(spark, texts):
    pages = spark.createDataFrame([(HOME, i + 1, f"{HOME}/{i}") for i in range(len(texts))], "homepage string, position bigint, link string")
    facts = spark.createDataFrame([(f"{HOME}/{i}", t) for i, t in enumerate(texts)], "url string, text string")
    return pages, facts


def test_site_parts_hold_the_whole_site(spark):
    texts = [f"text {i} <b>x</b>" for i in range(11)] + [None, "last"]
    rows = sites.page_rows(*_site(spark, texts))
    parts = sites.site_texts(rows, pages_per_part=4).orderBy("part").collect()
    assert [p.n_pages for p in parts] == [4, 4, 4, 1]
    whole = sites.site_texts(rows, pages_per_part=100).first()
    assert " ".join(p.raw_text for p in parts) == whole.raw_text == " ".join(t for t in texts if t)


def test_second_pass_keeps_signs_and_blanks_line_ends_of_crawled_sites(spark):
    pages, facts = _site(spark, ["price < 5 EUR\nand weight > 3 kg"])
    for method, text in ((discovery.CRAWL, "price < 5 EUR and weight > 3 kg"), (discovery.SITEMAP, "price < 5 EUR\nand weight > 3 kg")):
        assert sites.page_rows(pages.withColumn("method", F.lit(method)), facts).first().text == text


def test_reports_of_small_and_large_sites_have_one_shape(spark):
    """Two hundred pages and more change nothing but the content."""

    def report(n):
        texts = [f"Bread mill number {i}. Mail a{i % 7}@b.org or call 212-555-{1000 + i}." for i in range(n)]
        rows = sites.page_rows(*_site(spark, texts))
        words = site_keywords.keywords(sites.site_texts(rows).select(F.col("homepage").alias("unit"), "part", F.col("raw_text").alias("text")))
        found = sites.site_report(rows, words.withColumnRenamed("unit", "homepage")).collect()
        assert len(found) == 1
        return found[0].subdomain_reports

    small, large = report(50), report(450)
    assert [len(r.subdomains) for r in (small, large)] == [50, 450] and [len(r.phoneNumbers) for r in (small, large)] == [50, 450]
    assert small.emails == large.emails == [f"a{i}@b.org" for i in range(7)]
    assert set(small.asDict()) == set(large.asDict()) and "Bread" in " ".join(small.yake_tags) and "Bread" in " ".join(large.yake_tags)


def test_record_texts_equal_the_cut_of_the_joined_text(spark):
    rng = random.Random(5)
    texts = [None if rng.random() < 0.2 else "w" * rng.randrange(0, 900) + "  " for _ in range(60)]
    pages, facts = _site(spark, texts)
    joined = " ".join(" ".join(t for t in texts if t is not None).split())
    assert len(joined) >= 10000
    for size in (1, 7, 100):
        got = sites.record_texts(sites.site_texts(sites.page_rows(pages, facts), size)).first()
        assert got.txt == joined[:9999]


def test_short_sites_give_no_text(spark):
    for n, text in ((20, None), (21, "x" * 21)):
        assert sites.record_texts(sites.site_texts(sites.page_rows(*_site(spark, ["x" * n])))).first().txt == text

import pytest
from pyspark.sql import functions as F

from sitemill.functions import markup, urls
from sitemill.operators import routing
from sitemill.sources import inputs

ROUTES = [
    # link, homepage, is_subdomain, dont_scrape
    ("https://a.org", "https://a.org", False, False),
    ("https://a.org/", "https://a.org/", False, False),
    ("https://a.org/x", "https://a.org", True, False),
    ("https://a.org/x", "https://a.org", True, False),
    ("https://a.org?q=1", "https://a.org", True, False),
    ("https://twitter.com/x", None, True, True),
    ("https://twitter.com/", "https://twitter.com/", False, False),
    ("HTTPS://a.org", "https://a.org", True, False),
]


def test_router_table(spark):
    links = spark.createDataFrame([(r[0],) for r in ROUTES] + [("a.org/x",), (None,)], "link string")
    routed = routing.route_links(links)
    got = sorted(map(str, (tuple(r) for r in routed.where("failure_reason is null").drop("failure_reason").collect())))
    assert got == sorted(map(str, ROUTES))
    assert routed.count() == len(ROUTES) + 2
    bad = routed.where("failure_reason is not null").collect()
    assert len(bad) == 2 and all(r.failure_reason == "invalid_link" and r.homepage is None for r in bad)
    assert routing.dont_scrape(routed).count() == 1
    assert routing.subdomains(routed).count() == 5
    assert routing.subdomains(routed, honour_deny_list=True).count() == 4
    counts = routing.link_counts(routed).first()
    assert (counts.n_homepages, counts.n_subdomains, counts.n_dont_scrape, counts.n_invalid) == (7, 5, 1, 2)


def test_plain_router_ignores_deny_list(spark):
    links = spark.createDataFrame([("https://twitter.com/x",)], "link string")
    assert routing.route_links(links, ()).first().homepage == "https://twitter.com"


@pytest.mark.parametrize(
    "base,href,want",
    [
        ("https://a.org/d/p?q=1#f", "", "https://a.org/d/p?q=1#f"),
        ("https://a.org/d/p?q=1#f", "x", "https://a.org/d/x"),
        ("https://a.org/d/p?q=1#f", "/x?y#z", "https://a.org/x?y#z"),
        ("https://a.org/d/p?q=1#f", "//b.org/x", "https://b.org/x"),
        ("https://a.org/d/p?q=1#f", "#top", "https://a.org/d/p?q=1#top"),
        ("https://a.org/d/p?q=1#f", "?z=2", "https://a.org/d/p?z=2"),
        ("https://a.org/d/e/p", "../x", "https://a.org/d/x"),
        ("https://a.org/d/e/p", "../../../x", "https://a.org/x"),
        ("https://a.org/d/e/p", "./x/./y", "https://a.org/d/e/x/y"),
        ("https://a.org/d/e/p", "..", "https://a.org/d/"),
        ("https://a.org", "x", "https://a.org/x"),
        ("https://a.org", "mailto:m@a.org", "mailto:m@a.org"),
        ("https://a.org/d", "/u?next=/a/../b", "https://a.org/u?next=/a/../b"),
    ],
)
def test_resolve(spark, base, href, want):
    df = spark.createDataFrame([(base, href)], "b string, h string")
    assert df.select(urls.resolve(F.col("b"), F.col("h"))).first()[0] == want


def test_clean_and_good(spark):
    rows = [
        ("https://A.org/X?utm_source=f&b=1&utm_medium=z#top", "https://a.org/X?b=1", True),
        ("https://a.org/x?utm_source=feed", "https://a.org/x", True),
        ("https://a.org/x.PDF", "https://a.org/x.PDF", False),
        ("ftp://a.org/x", "ftp://a.org/x", False),
        ("https://localhost/x", "https://localhost/x", False),
        ("https://a.org/a b", "https://a.org/a b", False),
        ("https://a.org/" + "x" * 490, "https://a.org/" + "x" * 490, False),
    ]
    df = spark.createDataFrame(rows, "u string, clean string, good boolean")
    got = df.select(urls.clean_url(F.col("u")), "clean", urls.is_good(F.col("u")), "good").collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in got)


def test_page_text_and_links(spark):
    html = (
        "<html><head><title>Tom &amp; Co</title><meta name=\"description\" content=\"Fine &quot;things&quot;\">"
        "<style>p{}</style></head><body><nav><a href='/nav'>n</a></nav><!-- x --><p>Body\n text<br>it's"
        "<a class=b href=\"sub?x=1&amp;y=2\">l</a><a>none</a></p><script>var a='<p>';</script><footer>f</footer></body></html>"
    )
    df = spark.createDataFrame([("https://a.org/d/p", html), ("https://a.org/e", "<html></html>")], "url string, html string")
    rows = df.select(markup.page_text(F.col("html")), markup.page_links(F.col("url"), F.col("html"))).collect()
    assert rows[0][0] == "Tom & Co Fine  things  Body text it s l none"
    assert rows[0][1] == ["https://a.org/nav", "https://a.org/d/sub?x=1&y=2", "https://a.org/d/p"]
    assert rows[1][0] is None and rows[1][1] == []


def test_page_text_prefers_article(spark):
    html = "<body>before<article>in<b>side</article>after</body>"
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(markup.page_text(F.col("html"))).first()[0] == "in side"


def test_sources(spark, tmp_path):
    assert [r.link for r in inputs.links(spark, "b,a,,b").collect()] == ["b", "a", "", "b"]
    assert sorted(r.term for r in inputs.vocabulary(spark, ["x", "y", "x"]).collect()) == ["x", "y"]
    (tmp_path / "l.txt").write_text("https://a.org,https://b.org\nhttps://c.org\n")
    assert inputs.read_links(spark, str(tmp_path / "l.txt")).count() == 3


def test_page_keys(spark):
    rows = [
        ("https://A.org", "https://a.org/"),
        ("https://a.org/", "https://a.org/"),
        ("https://a.org?b=1", "https://a.org/?b=1"),
        ("https://a.org#x", "https://a.org/"),
        ("https://a.org/x?utm_a=1", "https://a.org/x"),
    ]
    df = spark.createDataFrame(rows, "u string, want string")
    assert all(r[0] == r[1] for r in df.select(urls.page_key(F.col("u")), "want").collect())
    pairs = [("https://a.org/", "https://a.org/x", True), ("https://a.org/x", "https://a.org/x/y", True),
             ("https://a.org/x", "https://a.org/x?y", True), ("https://a.org/x", "https://a.org/xy", False),
             ("https://a.org/", "https://a.org.evil.com/x", False), ("https://a.org/x", "https://a.org/x", False)]
    df = spark.createDataFrame(pairs, "s string, d string, want boolean")
    assert all(r[0] == r[1] for r in df.select(urls.extends(F.col("d"), F.col("s")), "want").collect())


def test_long_links_are_a_parameter(spark):
    link = F.lit("https://a.org/" + "x" * 490)
    row = spark.range(1).select(urls.is_good(link), urls.is_good(link, 600), urls.is_good(link, None), urls.is_too_long(link)).first()
    assert tuple(row) == (False, True, True, True)


def test_only_asked_pages_are_parsed(spark):
    """The semi-join stands below the HTML expressions, so a page nobody asks for is never parsed."""
    pages = spark.createDataFrame([(f"https://s{i}.org/p", "<body>text</body>") for i in range(50)], "url string, html string")
    links = spark.createDataFrame([("https://s3.org/p",), ("https://s9.org/p",)], "link string")
    plan = inputs.fetch(links, inputs.PageStore(pages))._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    semi = next(i for i, line in enumerate(lines) if "LeftSemi" in line)
    parsing = [i for i, line in enumerate(lines) if "<title" in line]
    assert parsing and max(parsing) < semi


def test_fetch_keeps_every_asking_row_and_folds_copies(spark):
    pages = spark.createDataFrame(
        [("https://a.org/x#1", "<body>one</body>"), ("https://a.org/x#2", "<body>one</body>")], "url string, html string"
    )
    links = spark.createDataFrame([("https://A.org/x",)] * 50 + [("https://a.org/y",)], "link string")
    got = inputs.fetch(links, inputs.PageStore(pages))
    assert got.count() == 51 and got.where("text = 'one'").count() == 50

from pyspark.sql import functions as F

from sitemill.functions import urls
from sitemill.operators import discovery
from sitemill.sources import inputs, page_store
from sitemill.workspace import new_path


def _pages(spark, sites=40, each=30, big=1500):
    rows = [(f"https://s{s}.org/p{i}", f"<body><a href='/p{i + 1}'>text {s} {i}</a></body>") for s in range(sites) for i in range(each)]
    rows += [(f"https://Big.org/dir/{i:05d}?utm_a=1", f"<body>{'big page ' * 20}{i}</body>") for i in range(big)]
    return spark.createDataFrame([*rows, ("https://s1.org/p1#again", "<body>text 1 1</body>")], "url string, html string").repartition(3)


def _scan(df):
    """Files and rows that the scan of a plan without shuffle reads."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    scan = plan.collectLeaves().head()
    while scan.nodeName().startswith("InputAdapter"):
        scan = scan.children().head()
    metrics = scan.metrics()
    return metrics.apply("numFiles").value(), metrics.apply("numOutputRows").value()


def _store(spark, pages, **how):
    return page_store.IndexedPages(spark, page_store.write_pages(pages, new_path(spark, "page-store"), **how))


def test_a_store_answers_as_the_table_does(spark):
    pages = _pages(spark)
    indexed, plain = _store(spark, pages), inputs.PageStore(pages)
    assert indexed.buckets == page_store.LEAST_BUCKETS
    some = [f"https://s{s}.org/p{i}" for s in range(0, 40, 3) for i in (0, 7, 99)] + ["https://big.org/dir/00007", "https://none.org/"]
    for links in (some, some[:3], ["https://big.org/dir/00007", None], []):
        asked = spark.createDataFrame([(x,) for x in links], "link string")
        got, want = (sorted(map(tuple, inputs.fetch(asked, s).collect()), key=str) for s in (indexed, plain))
        assert got == want
        keys = asked.select(F.col("link").alias("url"))
        got, want = (sorted(map(tuple, s.edges(keys).collect()), key=str) for s in (indexed, plain))
        assert got == want
    homes = spark.createDataFrame([("https://s4.org",), ("https://big.org/",)], "homepage string")
    sites = homes.select(urls.site_key(F.col("homepage")).alias("site"))
    for ask in (lambda s: s.published(homes), lambda s: s.site_edges(sites), lambda s: discovery.discover_sites(homes, s)[0]):
        got, want = (sorted(map(tuple, ask(s).collect()), key=str) for s in (indexed, plain))
        assert got == want and got


def test_one_link_reads_one_file_and_few_rows(spark):
    pages = _pages(spark, big=6000)
    indexed = _store(spark, pages, group_bytes=64 << 10)
    files = indexed.rows.select(F.input_file_name()).distinct().count()
    one = spark.createDataFrame([("https://big.org/dir/04321",)], "url string")
    read, rows = _scan(indexed.page_rows(one).select("url", "html"))
    in_bucket = indexed.rows.where(F.col("bucket") == indexed.page_rows(one).first()["bucket"]).select(F.input_file_name()).distinct().count()
    assert read == in_bucket < files and 1 <= rows < 6000 / 4
    missing = spark.createDataFrame([("https://big.org/dir/nothing",)], "url string")
    assert _scan(indexed.page_rows(missing).select("url", "html"))[1] < 6000 / 4


def test_a_large_site_is_many_files(spark):
    indexed = _store(spark, _pages(spark, big=6000))
    spread = indexed.rows.where("site = 'https://big.org'").select(F.input_file_name().alias("f"), "url").groupBy("f").agg(F.min("url").alias("a"), F.max("url").alias("z"))
    ranges = sorted((r.a, r.z) for r in spread.collect())
    assert len(ranges) >= 2 and all(z < a for (_, z), (a, _) in zip(ranges, ranges[1:], strict=False))


def test_an_empty_store(spark):
    indexed = _store(spark, _pages(spark).where("false"))
    assert inputs.fetch(spark.createDataFrame([("https://a.org/",)], "link string"), indexed).first().text is None

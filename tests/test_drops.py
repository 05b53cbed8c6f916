"""Run manifests and link drops."""

import pytest
from pyspark.sql import functions as F

from sitemill.operators.records import References
from sitemill.plans import drops, jobs
from sitemill.sources import jsonl

BODY = "<body>We bake bread daily in the old mill of New York and sell it to all people of the town.</body>"
PAGES = [(f"https://{s}.org{p}", BODY.replace("bread", f"bread {s}{p}")) for s in "abc" for p in ("", "/x", "/y")]


@pytest.fixture(scope="module")
def world(spark):
    pages = spark.createDataFrame(PAGES, "url string, html string")
    house = spark.createDataFrame([("bread",), ("mill",)], "term string")
    gaz = spark.createDataFrame([("New York", "LOC")], "name string, tag string")
    places = spark.createDataFrame([("nowhere",)], "description string")
    return pages, house, References(gaz, places)


def _read(spark, root, kind):
    return spark.read.schema("mainURL string").json(f"{root}/kind={kind}").select("mainURL", "run").collect()


def test_the_manifest_counts_what_was_written(spark, world, tmp_path):
    pages, house, refs = world
    links = ["https://a.org", "https://a.org/x", "https://none.org/z", "no-scheme", "https://twitter.com/t"]
    made = jobs.run_job(spark, links, pages, "job", house, refs)
    paths = made.write(str(tmp_path), "job", 7)
    found = {r.kind: r for r in jobs.read_manifest(spark, str(tmp_path), "job", 7).collect()}
    assert set(found) == {*paths, jobs.LINKS}
    for kind, path in paths.items():
        assert found[kind].n_rows == spark.read.text(path).count()
        assert found[kind].n_bytes >= sum(len(r.value) + 1 for r in spark.read.text(path).collect())
    reasons = {r.failure_reason: r["count"] for r in made.failures.groupBy("failure_reason").count().collect()}
    assert {k: n for k, n in found[jsonl.FAILURES].counts.items() if n} == reasons
    assert found[jobs.LINKS].n_rows == 5 and found[jobs.LINKS].counts == made.counts.first().asDict()
    assert found[jobs.LINKS].counts["n_invalid"] == found[jobs.LINKS].counts["n_dont_scrape"] == 1


def test_drops_that_overlap_give_each_link_once(spark, world, tmp_path):
    pages, house, refs = world
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def run():
        return drops.run_drops(spark, str(source), root, pages, "job", house, refs)

    (source / "1.txt").write_text("https://a.org,https://a.org/x\nhttps://a.org/x\n")
    first = run()
    assert len(first) == 1 and run() == []
    (source / "2.txt").write_text("https://a.org/x\nhttps://b.org/x,https://b.org\n")
    (source / "3.txt").write_text("https://a.org,https://b.org/x\n")
    second = run()
    assert len(second) == 1 and second[0] > first[0]
    got = {(r.mainURL, r.run) for r in _read(spark, root, jsonl.SUBDOMAIN_RECORDS)}
    assert got == {("https://a.org/x", first[0]), ("https://b.org/x", second[0])}
    homes = _read(spark, root, jsonl.FAILURES) + _read(spark, root, jsonl.DOMAIN_RECORDS)
    assert sorted(r.mainURL for r in homes) == ["https://a.org", "https://b.org"]


def test_a_stopped_drop_is_taken_up_again(spark, world, tmp_path, monkeypatch):
    pages, house, refs = world
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "1.txt").write_text("https://c.org,https://c.org/x,https://c.org/y\n")
    write = jobs.JobResult.write

    def stopped(self, *args, **how):
        write(self, *args, **how)
        raise RuntimeError("stopped before the batch was noted")

    monkeypatch.setattr(jobs.JobResult, "write", stopped)
    with pytest.raises(Exception, match="stopped before"):
        drops.run_drops(spark, str(source), root, pages, "job", house, refs)
    monkeypatch.setattr(jobs.JobResult, "write", write)
    runs = drops.run_drops(spark, str(source), root, pages, "job", house, refs)
    assert len(runs) == 1
    got = _read(spark, root, jsonl.SUBDOMAIN_RECORDS)
    assert sorted((r.mainURL, r.run) for r in got) == [("https://c.org/x", runs[0]), ("https://c.org/y", runs[0])]
    found = jobs.read_manifest(spark, root, "job", runs[0]).where(F.col("kind") == jsonl.SUBDOMAIN_RECORDS)
    assert [r.n_rows for r in found.collect()] == [2]

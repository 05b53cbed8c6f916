import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitemill import models, schemas
from sitemill.operators.records import References, records, texts_from_links
from sitemill.plans import jobs
from sitemill.sources import inputs, jsonl

ABOUT = (
    "<html><head><title>Acme Mill</title></head><body><p>We help Acme Mill in New York. Mail info@acme.org or call "
    "212-555-7890. Bakers love fresh bread. Bread from Acme Mill wins prizes.</p><a href='/about'>a</a></body></html>"
)
HOMEPAGE = "<body>Welcome home to the mill of bread. <a href='/about'>about</a><a href='/shop'>shop</a></body>"
PAGES = [
    ("https://acme.org", HOMEPAGE),
    ("https://acme.org/about", ABOUT),
    ("https://acme.org/shop", "<body>Shop for bread and rolls here, open daily.</body>"),
    ("https://tiny.org/x", "<body>tiny text</body>"),
    ("https://tiny.org/y", "<body></body>"),
]
LINKS = ["https://acme.org", "https://acme.org/about", "https://acme.org/about", "https://tiny.org/x", "https://gone.org/z",
         "https://twitter.com/t", "no-scheme"]


@pytest.fixture(scope="module")
def world(spark):
    pages = spark.createDataFrame(PAGES, "url string, html string")
    house = spark.createDataFrame([("bread",), ("mill",), ("bread",)], "term string")
    paradigm = spark.createDataFrame([("acme mill",), ("prizes",)], "term string")
    gaz = spark.createDataFrame([("New York", "LOC"), ("Acme Mill", "ORG")], "name string, tag string")
    places = spark.createDataFrame([("nowhere",)], "description string")
    return pages, house, paradigm, References(gaz, places)


@pytest.fixture(scope="module")
def bulk(spark, world):
    pages, house, _, refs = world
    return jobs.run_job(spark, ",".join(LINKS), pages, "job", house, refs)


def test_bulk_job(bulk):
    domain = {r.mainURL: r for r in bulk.domain_records.collect()}
    assert set(domain) == {"https://acme.org"}
    record = domain["https://acme.org"]
    assert record.contactEmail == ["info@acme.org"] and record.phoneNumber == ["212-555-7890"]
    assert record.location_tags == ["New York"] and record.name == "Acme Mill"
    assert {"bread", "mill"} <= set(record.all_keywords) and record.forEcosystem == "job"
    pages = {r.mainURL for r in bulk.subdomain_records.collect()}
    assert pages == {"https://acme.org/about"}
    assert {(r.mainURL, r.failure_reason) for r in bulk.failures.collect()} == {
        ("https://tiny.org/x", "short_text"),
        ("https://tiny.org", "short_site_text"),
        ("https://gone.org/z", "no_text"),
        ("https://gone.org", "no_pages"),
        ("https://twitter.com/t", "no_text"),
        ("no-scheme", "invalid_link"),
    }
    reports = {r.homepage: r.subdomain_reports for r in bulk.site_reports.collect()}
    assert reports["https://acme.org"].subdomains == ["https://acme.org", "https://acme.org/about", "https://acme.org/shop"]
    assert reports["https://acme.org"].emails == ["info@acme.org"] and "bread" in reports["https://acme.org"].yake_tags
    assert len(reports["https://acme.org"].raw_text) > 20
    assert set(reports) == {"https://acme.org", "https://tiny.org"}


def test_success_and_failure_add_up(bulk):
    n = bulk.domain_records.count() + bulk.subdomain_records.count() + bulk.failures.count()
    assert n == 3 + 4 + 1  # homepages, distinct sub-pages, the invalid link


def test_schemas_and_outputs(spark, bulk, tmp_path):
    paths = bulk.write(str(tmp_path), "job", run=1700000000)
    assert paths["domain-records"].endswith("kind=domain-records/job=job/run=1700000000")
    want = spark.createDataFrame([], schemas.RECORD).schema
    assert bulk.domain_records.schema.simpleString() == want.simpleString()
    back = jsonl.read_jsonl(spark, paths["domain-records"], schemas.RECORD)
    assert back.collect() == bulk.domain_records.collect()
    line = json.loads(spark.read.text(paths["subdomain-records"]).first()[0])
    assert list(line)[:2] == ["name", "mainURL"] and len(line) == 15
    reports = jsonl.read_jsonl(spark, paths["site-reports"], schemas.SITE_REPORT)
    assert reports.schema.simpleString() == bulk.site_reports.schema.simpleString()
    assert reports.count() == 2
    assert spark.read.json(str(tmp_path)).where("kind = 'failures'").count() == 6
    texts = jsonl.read_jsonl(spark, paths["site-texts"], schemas.SITE_TEXT)
    assert texts.schema.simpleString() == bulk.site_texts.schema.simpleString() and texts.count() == 2


def test_sample_record_reads_with_the_schema(spark, tmp_path):
    sample = {"all_keywords": ["Weaving"], "yake_tags": ["loom"], "ner_tags": [{"named_entity": "Elm Hill", "tag": "MISC"}],
              "location_tags": [], "name": "Elm Hill Weavers", "embedding": None, "address": []}
    (tmp_path / "s.json").write_text(json.dumps(sample))
    row = jsonl.read_jsonl(spark, str(tmp_path), schemas.RECORD).first()
    assert row.embedding is None and row.ner_tags[0].tag == "MISC" and row.forEcosystem is None


def test_paradigm_job_uses_the_paradigm_for_domains_only(spark, world):
    pages, house, paradigm, refs = world
    made = jobs.run_job(spark, LINKS, pages, "job", house, refs, paradigm=paradigm, mode=jobs.PARADIGM, keep_duplicates=True)
    assert "acme mill" in made.domain_records.first().all_keywords
    assert not {"bread", "mill"} & set(made.domain_records.first().all_keywords)
    assert made.domain_records.count() == 3  # one per listing of the site
    subs = made.subdomain_records.collect()
    assert len(subs) == 2 and all("bread" in r.all_keywords for r in subs)


def test_dual_job(spark, world):
    pages, house, paradigm, refs = world
    made = jobs.run_job(spark, LINKS, pages, "job", house, refs, paradigm=paradigm, mode=jobs.DUAL)
    assert made.domain_records.schema.simpleString() == spark.createDataFrame([], schemas.DUAL_RECORD).schema.simpleString()
    row = made.domain_records.first()
    assert "bread" in row.vocabulary_keywords and "acme mill" in row.paradigm_keywords and row.failure is False
    assert ("https://twitter.com", "no_pages") in {(r.mainURL, r.failure_reason) for r in made.failures.collect()}


def test_dual_job_without_parameters_fails_every_item(spark, world):
    pages, house, _, refs = world
    made = jobs.run_job(spark, LINKS, pages, "job", house, refs, mode=jobs.DUAL)
    assert made.domain_records.count() == made.subdomain_records.count() == 0
    reasons = {r.failure_reason for r in made.failures.where("mainURL LIKE '%acme%'").collect()}
    assert reasons == {"insufficient kwargs"}


def test_single_job(spark, world, tmp_path):
    pages, house, _, refs = world
    links = spark.createDataFrame([(["https://acme.org/about"],), (["https://gone.org/z"],)], "links array<string>")
    got = {r.mainURL: r for r in jobs.run_single(links, pages, "eco", house, refs).collect()}
    assert got["https://acme.org/about"].msg is None and got["https://acme.org/about"].forEcosystem == "eco"
    assert "short_text" in got["https://gone.org/z"].msg and got["https://gone.org/z"].name is None
    with pytest.raises(ValueError, match="several"):
        jobs.write_single_record(jobs.run_single(links, pages, "eco", house, refs), str(tmp_path), "eco", run=6)
    one = jobs.run_single(links.limit(1), pages, "eco", house, refs)
    path = jobs.write_single_record(one, str(tmp_path), "eco", run=7)
    assert path.endswith("eco-7.json") and spark.read.schema(schemas.RECORD).json(path).count() == 1


def test_single_job_keeps_its_lists_apart(spark, world):
    pages, house, _, refs = world
    same = "https://acme.org/about"
    rows = [([same],), ([same, "https://acme.org/shop"],), ([],), ([same],)]
    links = spark.createDataFrame(rows, "links array<string>")
    got = jobs.run_single(links, pages, "eco", house, refs).collect()
    assert len(got) == 4 and sorted(r.mainURL or "" for r in got) == ["", same, same, same]
    assert [r.msg for r in got if r.mainURL is None] == ["no record for an empty list: no links"]
    tags = [tuple(r.yake_tags) for r in got if r.mainURL]
    assert len(set(tags)) == 2 and sorted(map(tags.count, set(tags))) == [1, 2]


def test_model_failures_become_failure_rows(spark, world):
    """One bad item per slot: its unit fails with the message, all others are as before."""
    _, house, _, refs = world
    texts = spark.createDataFrame(
        [(k, f"We bake {k} bread daily in the old mill.") for k in ("good", "entities", "name", "keywords", "embedding", "vector")], "unit string, text string"
    )

    def failing(mark, answer):
        def model(batch):
            if batch.str.contains(mark).any():
                raise RuntimeError(f"bad {mark}")
            return batch.map(answer)

        return model

    def vector(batch):
        if batch.str.contains("vector bread").any():
            raise RuntimeError("bad vector")
        return batch.map(lambda t: [1.0 if "bread" in t else 0.0] + [0.5] * 7)

    plugged = References(
        refs.gazetteer,
        refs.places,
        models.Models(
            entities=failing("entities", lambda t: []),
            name=failing("name", lambda t: "n"),
            keywords=failing("keywords", lambda t: [" ".join(t.split()[2:4])]),
            embedding=failing("embedding", lambda t: [1.0]),
            key_vector=vector,
        ),
    )
    every = records(texts, [(F.lit(True), house)], "eco", plugged, keep_failed=True)
    assert {r.mainURL: r.failure_reason for r in every.collect()} == {"good": None} | {
        k: f"{slot}: RuntimeError: bad {k}"
        for k, slot in (("entities", "entities"), ("name", "name"), ("keywords", "keywords"), ("embedding", "embedding"), ("vector", "key_vector"))
    }
    kept = records(texts, [(F.lit(True), house)], "eco", plugged).collect()
    assert [r.mainURL for r in kept] == ["good"] and "failure_reason" not in kept[0].asDict() and kept[0].type is not None


def test_records_of_any_width(spark, world):
    _, house, _, refs = world
    texts = spark.createDataFrame([("u", "Fresh bread from the mill, every single day.")], "unit string, text string")
    wide = records(texts, [(F.lit(True), house)], "eco", References(refs.gazetteer, refs.places, models.Models(dim=768))).first()
    assert len(wide.embedding) == 768 and wide.type in ("Organization", "Resource") and "bread" in wide.all_keywords


def test_a_model_sees_each_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def model(batch):
        seen.add(len(batch))
        return batch.map(lambda t: [float(len(t))])

    df = spark.createDataFrame([("a",), ("bb",), ("a",), ("ccc",)], "t string")
    made = models.with_key_vectors(df, "t", models.Models(key_vector=model))
    assert made.where("vector[0] > 1").count() == 2 and made.count() == 4 and seen.value == 3


def test_long_links_have_a_reason_of_their_own(spark, world):
    pages, house, _, refs = world
    long_link = "https://acme.org/" + "x" * 600
    made = jobs.run_job(spark, [long_link], pages, "job", house, refs)
    assert (long_link, "long_link") in {(r.mainURL, r.failure_reason) for r in made.failures.collect()}


def test_texts_follow_the_link_order(spark, world):
    facts = inputs.PageStore(world[0])
    lists = spark.createDataFrame([("u", ["https://acme.org/shop", "bad link", "https://tiny.org/x"])], "unit string, links array<string>")
    assert texts_from_links(lists, facts).first().text == "Shop for bread and rolls here, open daily. tiny text"


def test_plug_in_models(spark, world):
    pages, house, _, refs = world

    def name(batch):
        return batch.str.slice(0, 4)

    def flaky(batch):
        if batch.str.contains("Acme").any():
            raise RuntimeError("rate limit")
        return batch.str.upper()

    def key_vector(batch):
        return batch.map(lambda t: [1.0 if "bread" in t else 0.0] + [0.0] * 63)

    plugged = References(
        refs.gazetteer,
        refs.places,
        models.Models(name=name, short_description=flaky, long_description=models.with_fallback(flaky, lambda b: b.str.len().astype(str)), key_vector=key_vector),
    )
    made = jobs.run_job(spark, LINKS, pages, "job", house, plugged).subdomain_records.first()
    assert made.shortDescription == "re-extract me!" and made.longDescription.isdigit()
    assert made.name == "re-e" and made.all_keywords == ["bread"]


def test_model_errors_stay_values(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "t string").coalesce(1)

    def picky(batch):
        if (batch == "b").any():
            raise ValueError("no b")
        return batch + "!"

    rows = df.select(models.model_column(picky, F.col("t"), "string").alias("r")).select("r.*").collect()
    assert [tuple(r) for r in rows] == [("a!", None), (None, "ValueError: no b"), ("c!", None)]
    assert list(models.with_fallback(picky, lambda s: s)(pd.Series(["a", "b"]))) == ["a!", "b"]

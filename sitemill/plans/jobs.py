"""Whole jobs: links and stored pages in, record, report and failure tables out.

    links -> route -> sub-pages ---------------------> texts --+
                  \\-> homepages -> discover -> site texts -----+-> records
    pages -> page facts (text, anchors), one scan, used by all of them

Every table that more than one branch needs is staged once in the shared folder.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sitemill import constants as C
from sitemill.functions import urls
from sitemill.operators import discovery, records, routing, site_keywords, sites
from sitemill.operators.facts import complete_addresses
from sitemill.operators.records import References
from sitemill.sources import inputs, jsonl
from sitemill.workspace import stage

HOUSE, PARADIGM, DUAL = "house", "paradigm", "dual"
NO_PAGES = "no_pages"
SHORT_SITE = "short_site_text"
LONG_LINK = "long_link"
LINKS, MODEL_MESSAGES = "links", "model"
REASONS = (NO_PAGES, SHORT_SITE, LONG_LINK, routing.INVALID_LINK, records.NO_TEXT, records.SHORT_TEXT, C.NO_PARAMETERS)


@dataclass(frozen=True)
class JobResult:
    domain_records: DataFrame
    subdomain_records: DataFrame
    site_reports: DataFrame
    site_texts: DataFrame
    failures: DataFrame
    counts: DataFrame
    link_counts: dict[str, int] = field(default_factory=dict)

    def outputs(self) -> dict[str, DataFrame]:
        return {
            jsonl.DOMAIN_RECORDS: self.domain_records,
            jsonl.SUBDOMAIN_RECORDS: self.subdomain_records,
            jsonl.SITE_REPORTS: self.site_reports,
            jsonl.SITE_TEXTS: self.site_texts,
            jsonl.FAILURES: self.failures,
        }

    def write(self, root: str, job: str, run: int | None = None, mode: str = "errorifexists") -> dict[str, str]:
        """Write all outputs as JSON lines; the run is the epoch second unless given.

        Last comes the manifest of the run (``read_manifest``), so a run that has one is complete.
        """
        run = int(time.time()) if run is None else run
        paths, rows = {}, [(LINKS, self.link_counts.get("n_links"), None, {k: n for k, n in self.link_counts.items() if k != "n_links"})]
        for kind, df in self.outputs().items():
            paths[kind] = jsonl.output_path(root, kind, job, run)
            found = jsonl.write_counted(df, paths[kind], _failure_counters() if kind == jsonl.FAILURES else (), mode)
            rows.append((kind, found.pop("n_rows", 0), found.pop("n_bytes"), found))
        manifest = self.failures.sparkSession.createDataFrame(rows, jsonl.MANIFEST_FIELDS).coalesce(1)
        jsonl.write_jsonl(manifest, jsonl.manifest_path(root, job, run), mode)
        return paths


def _failure_counters() -> list[Column]:
    """Failures by reason; messages of models are counted together."""
    reason = F.col("failure_reason")
    named = [F.count_if(reason == r).alias(r) for r in REASONS]
    return [*named, F.count_if(~reason.isin(*REASONS)).alias(MODEL_MESSAGES)]


def read_manifest(spark: SparkSession, root: str, job: str, run: int) -> DataFrame:
    """``kind, n_rows, n_bytes, counts`` of a written run.

    ``counts`` holds failures by reason for the failures, and the roles of the links for the kind
    ``links``, whose rows are the links given; all were counted by the tasks that wrote the tables.
    """
    return jsonl.read_jsonl(spark, jsonl.manifest_path(root, job, run), jsonl.MANIFEST_FIELDS)


def site_reports(pages: DataFrame, site_texts: DataFrame, texts: DataFrame, refs: References) -> DataFrame:
    """Full reports, one per site, with keywords, completed addresses and the text of its record ``(homepage, txt)``."""
    words = site_keywords.keywords(site_texts.select(F.col("homepage").alias("unit"), "part", F.col("raw_text").alias("text")))
    found = sites.site_contacts(pages).where(F.size("address") > 0)
    addresses = complete_addresses(found.select(F.col("homepage").alias("unit"), "address"), refs.places)
    return sites.site_report(
        pages, words.withColumnRenamed("unit", "homepage"), addresses.withColumnRenamed("unit", "homepage"), texts
    )


def run_job(
    spark: SparkSession,
    links: str | Sequence[str] | DataFrame,
    pages: DataFrame | inputs.PageStore,
    job: str | None,
    house: DataFrame,
    refs: References,
    *,
    paradigm: DataFrame | None = None,
    mode: str = HOUSE,
    deny_hosts: Sequence[str] = C.DENY_HOSTS,
    honour_deny_list: bool = False,
    sitemap: DataFrame | None = None,
    extra_edges: DataFrame | None = None,
    keep_duplicates: bool = False,
    unique_pages: bool = False,
    pages_per_part: int = sites.PAGES_PER_PART,
) -> JobResult:
    """Run a bulk job.

    ``house`` mode maps all records to the house vocabulary; ``paradigm`` mode maps domain records to
    the paradigm and sub-page records to the house vocabulary; ``dual`` mode routes without a deny
    list and maps every record to both.  Each homepage and each sub-page gives one record however
    often it was listed; ``keep_duplicates`` gives one per listing.  ``unique_pages`` states that the
    pages hold each clean address once, which saves a shuffle of the page texts.  A ``PageStore`` given
    as the pages, an indexed one for instance, has these settings of its own.
    """
    routed = routing.route_links(inputs.links(spark, links), () if mode == DUAL else deny_hosts)
    seen = Observation()
    routed = stage(routed.observe(seen, F.count("*").alias("n_links"), *routing.counters()), "routed")
    link_counts = {name: int(n) for name, n in seen.get.items()}
    counts = spark.createDataFrame([link_counts], ", ".join(f"{name} long" for name in link_counts)).drop("n_links")
    invalid = routed.where("failure_reason is not null").select(F.col("link").alias("mainURL"), "failure_reason").distinct()
    homes = routing.homepages(routed)
    subs = routing.subdomains(routed, honour_deny_list)
    once_homes, once_subs = homes.distinct(), stage(subs.distinct(), "subdomains")

    store = pages if isinstance(pages, inputs.PageStore) else inputs.PageStore(pages, unique_pages, extra_edges, sitemap)
    found, lost = discovery.discover_sites(once_homes, store)
    valid_subs = once_subs.where(urls.is_good(F.col("link")))
    asked = found.select("link").unionByName(valid_subs).where(urls.is_good(F.col("link")))
    asked = asked.select(urls.page_key(F.col("link")).alias("url")).distinct()
    facts = stage(store.texts(asked), "facts")

    site_pages = stage(sites.page_rows(found, facts), "site-pages")
    site_texts = stage(sites.site_texts(site_pages, pages_per_part), "site-texts")
    gated = sites.record_texts(site_texts).select(F.col("homepage").alias("unit"), F.col("txt").alias("text"))
    keyed = once_subs.withColumn("url", F.when(urls.is_good(F.col("link")), urls.page_key(F.col("link"))))
    fetched = keyed.join(facts, "url", "left").select(F.col("link").alias("unit"), "text")
    texts = gated.withColumn("domain", F.lit(True)).unionByName(fetched.withColumn("domain", F.lit(False)))
    texts = stage(texts, "record-texts")

    reason = F.coalesce(
        F.when(F.col("domain") & F.col("text").isNull(), SHORT_SITE),
        F.when(~F.col("domain") & urls.is_too_long(F.col("unit")), LONG_LINK),
        records.text_failure(F.col("text")),
    )
    if mode == DUAL:
        given = F.lit(job), F.lit(None if paradigm is None else "given")
        reason = F.coalesce(records.parameter_failure(*given), reason)
    failed = texts.select(F.col("unit").alias("mainURL"), reason.alias("failure_reason"))
    no_pages = lost.select(F.col("homepage").alias("mainURL"), F.lit(NO_PAGES).alias("failure_reason"))
    domain = F.col("domain")
    if mode == DUAL and (job is None or paradigm is None):
        made = records.dual_records(texts.where(F.lit(False)), house, house, job or "", refs, keep_failed=True)
    elif mode == DUAL:
        made = records.dual_records(texts, house, paradigm, job, refs, keep_failed=True)
    elif mode == PARADIGM:
        made = records.records(texts, [(domain, paradigm), (~domain, house)], job, refs, keep_failed=True)
    else:
        made = records.records(texts, [(F.lit(True), house)], job, refs, keep_failed=True)
    every = stage(made, "records")
    broken = every.where("failure_reason IS NOT NULL").select("mainURL", "failure_reason")
    failures = records.failure_rows(failed.unionByName(no_pages).unionByName(invalid).unionByName(broken))
    made = every.where("failure_reason IS NULL").drop("failure_reason")
    kinds = texts.select(F.col("unit").alias("mainURL"), "domain")
    of_domain = made.join(kinds.where(domain), "mainURL", "left_semi").select(*made.columns)
    of_pages = made.join(kinds.where(~domain), "mainURL", "left_semi").select(*made.columns)
    if keep_duplicates:
        of_domain = homes.select(F.col("homepage").alias("mainURL")).join(of_domain, "mainURL").select(*made.columns)
        of_pages = subs.select(F.col("link").alias("mainURL")).join(of_pages, "mainURL").select(*made.columns)
    own = texts.where(domain).select(F.col("unit").alias("homepage"), F.col("text").alias("txt"))
    reports = site_reports(site_pages, site_texts, own, refs)
    return JobResult(of_domain, of_pages, reports, site_texts, failures, counts, link_counts)


def run_single(
    links: DataFrame, pages: DataFrame | inputs.PageStore, ecosystem: str, vocabulary: DataFrame, refs: References
) -> DataFrame:
    """One record from the link list of each ``(links ARRAY)`` row; failed ones carry a message.

    Returns the record fields, named by the first link of the list, plus ``msg``, which is null for a
    record.  Every row gives one row, also if lists share their first link or are empty.
    """
    # The row key is staged with the lists: it is made up, and must not change between its two uses.
    lists = stage(links.select(F.expr("uuid()").alias("unit"), "links"), "lists")
    store = pages if isinstance(pages, inputs.PageStore) else inputs.PageStore(pages)
    given = records.texts_from_links(lists, store, records.LINKS_PER_PART)
    given = stage(given, "single") if isinstance(given, DataFrame) else given
    texts = given if isinstance(given, DataFrame) else given.starts()
    made = records.records(given, [(F.lit(True), vocabulary)], ecosystem, refs, keep_failed=True)
    first = F.get(F.col("links"), F.lit(0))
    asked = lists.select("unit", first.alias("first")).join(texts, "unit").withColumnRenamed("text", "_text")
    joined = asked.join(made.withColumnRenamed("mainURL", "unit"), "unit", "left")
    reason = F.when(F.col("first").isNull(), "no links").otherwise(
        F.coalesce(records.text_failure(F.col("_text")), F.col("failure_reason"))
    )
    note = F.concat(F.lit("no record for "), F.coalesce("first", F.lit("an empty list")), F.lit(": "), reason)
    fields = [F.when(reason.isNull(), F.col(c)).alias(c) for c in made.columns if c not in ("mainURL", "failure_reason")]
    return joined.select(F.col("first").alias("mainURL"), *fields, note.alias("msg"))


def write_single_record(record: DataFrame, root: str, ecosystem: str, run: int | None = None) -> str:
    run = int(time.time()) if run is None else run
    return jsonl.write_single(record.drop("msg"), f"{root.rstrip('/')}/{ecosystem}-{run}.json")

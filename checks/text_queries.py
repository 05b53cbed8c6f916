"""Text and pattern-fact queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqlparts as S
from checks import tables as T
from sitemill import constants as C
from sitemill.functions import markup, text, urls
from sitemill.operators import facts


def page_text(spark, sf_dir):
    return T.pages(spark, sf_dir).select("page_id", markup.page_text(F.col("html")).alias("text"))


PAGE_TEXT = f"SELECT page_id, {S.page_text('html')} AS text FROM pages"


def contact_report(spark, sf_dir):
    pages = T.pages(spark, sf_dir).select(
        urls.origin(F.col("url")).alias("origin"), markup.page_text(F.col("html")).alias("text")
    )
    return facts.contact_report(pages, "origin")


CONTACT_REPORT = f"""
WITH texts AS (SELECT {S.origin('url')} AS origin, {S.page_text('html')} AS text FROM pages),
found AS (
  SELECT origin, 'email' AS kind, unnest({S.matches('text', C.EMAIL)}) AS value FROM texts
  UNION ALL SELECT origin, 'phone', unnest({S.matches('text', C.PHONE)}) FROM texts)
SELECT origin, kind, value, count(*) AS n_pages FROM found GROUP BY ALL
"""


def clean_text(spark, sf_dir):
    return T.documents(spark, sf_dir).select("doc_id", text.clean_text(F.col("text")).alias("text"))


CLEAN_TEXT = f"SELECT doc_id, {S.clean_text('text')} AS text FROM documents"


def sanitize_text(spark, sf_dir):
    return T.documents(spark, sf_dir).select("doc_id", text.sanitize_text(F.col("text")).alias("text"))


SANITIZE_TEXT = f"SELECT doc_id, {S.sanitize_text('text')} AS text FROM documents"


def length_gate(spark, sf_dir):
    cleaned = T.documents(spark, sf_dir).select("doc_id", text.clean_text(F.col("text")).alias("txt"))
    gated = cleaned.withColumn("txt", text.gated(F.col("txt")))
    return gated.withColumn("failure", F.col("txt").isNull())


LENGTH_GATE = f"SELECT doc_id, {S.gated('text')} AS txt, ({S.gated('text')}) IS NULL AS failure FROM documents"


def min_context(spark, sf_dir):
    d = T.documents(spark, sf_dir)
    return d.select("doc_id", text.has_context(text.clean_text(F.col("text"))).alias("has_context"))


MIN_CONTEXT = f"SELECT doc_id, length({S.clean_text('text')}) > {C.RECORD_TEXT_MIN} AS has_context FROM documents"


def summary_cap(spark, sf_dir):
    return T.documents(spark, sf_dir).select("doc_id", text.summary_input(F.col("text")).alias("text"))


SUMMARY_CAP = f"SELECT doc_id, {S.summary_input('text')} AS text FROM documents"


def extract_emails(spark, sf_dir):
    return T.documents(spark, sf_dir).select("doc_id", F.array_join(text.emails(F.col("text")), "|").alias("emails"))


EXTRACT_EMAILS = f"SELECT doc_id, {S.joined_matches('text', C.EMAIL)} AS emails FROM documents"


def extract_phones(spark, sf_dir):
    return T.documents(spark, sf_dir).select("doc_id", F.array_join(text.phones(F.col("text")), "|").alias("phones"))


EXTRACT_PHONES = f"SELECT doc_id, {S.joined_matches('text', C.PHONE)} AS phones FROM documents"

# The stored texts hold no street address, so letters with one or two addresses are made from customers.
_SENDER = "cast({k} AS {s}) || ' ' || {b} || ' Street, ' || {b} || ' City, IL ' || lpad(cast({k} % 100000 AS {s}), 5, '0')"

def _letter(s):
    one = _SENDER.format(k="c_custkey", b="'Mill Oak'", s=s)
    two = _SENDER.format(k="(c_nationkey + 1)", b="'Harbor'", s=s)
    return (
        f"'Dear ' || c_name || ', write to ' || {one} || ' or to ' || {two} || '. Ref ' "
        f"|| cast(c_custkey AS {s}) || ' at ' || {one} || '.'"
    )


def _letters(spark, sf_dir):
    return T.table(spark, sf_dir, "customer").select("c_custkey", F.expr(_letter("string")).alias("text"))


LETTERS = f"letters AS (SELECT c_custkey, {_letter('varchar')} AS text FROM customer)"


def extract_addresses(spark, sf_dir):
    return _letters(spark, sf_dir).select(
        "c_custkey", F.array_join(text.addresses(F.col("text")), "|").alias("addresses")
    )


EXTRACT_ADDRESSES = f"""
WITH {LETTERS} SELECT c_custkey, {S.joined_matches('text', text.US_ADDRESS, 1)} AS addresses FROM letters
"""


def complete_addresses(spark, sf_dir):
    """Addresses of the letters completed from places, which are the senders with a country added."""
    letters = _letters(spark, sf_dir)
    found = letters.select(F.col("c_custkey").alias("unit"), text.addresses(F.col("text")).alias("address"))
    cust = T.table(spark, sf_dir, "customer")
    places = cust.select(
        F.explode(
            F.array(
                F.concat(F.expr(_SENDER.format(k="c_custkey", b="'Mill Oak'", s="string")), F.lit(", USA")),
                F.concat(F.expr(_SENDER.format(k="c_custkey", b="'Mill Oak'", s="string")), F.lit("-0001, United States")),
                F.concat(F.expr(_SENDER.format(k="(c_nationkey + 1)", b="'Harbor'", s="string")), F.lit(", usa")),
            )
        ).alias("description")
    )
    done = facts.complete_addresses(found, places)
    return done.select(F.col("unit").alias("c_custkey"), F.array_join("address", "|").alias("addresses"))


COMPLETE_ADDRESSES = f"""
WITH {LETTERS},
found AS (SELECT c_custkey, unnest({S.matches('text', text.US_ADDRESS, 1)}) AS address FROM letters),
senders AS (SELECT {_SENDER.format(k="c_custkey", b="'Mill Oak'", s="varchar")} AS a,
  {_SENDER.format(k="(c_nationkey + 1)", b="'Harbor'", s="varchar")} AS b FROM customer),
places AS (SELECT DISTINCT description FROM (SELECT a || ', USA' AS description FROM senders
  UNION ALL SELECT a || '-0001, United States' FROM senders UNION ALL SELECT b || ', usa' FROM senders)),
wanted AS (SELECT DISTINCT address FROM found),
ranked AS (SELECT address, description, row_number() OVER (PARTITION BY address
  ORDER BY length(description), description) AS rn
  FROM wanted JOIN places ON left(lower(description), length(address)) = lower(address)),
best AS (SELECT address, description FROM ranked)
SELECT c_custkey, coalesce(string_agg(DISTINCT description, '|' ORDER BY description), '') AS addresses
FROM letters LEFT JOIN found USING (c_custkey) LEFT JOIN best USING (address) GROUP BY c_custkey
"""

QUERIES = {
    "contact_report": (contact_report, CONTACT_REPORT),
    "page_text": (page_text, PAGE_TEXT),
    "clean_text": (clean_text, CLEAN_TEXT),
    "sanitize_text": (sanitize_text, SANITIZE_TEXT),
    "length_gate": (length_gate, LENGTH_GATE),
    "min_context": (min_context, MIN_CONTEXT),
    "summary_cap": (summary_cap, SUMMARY_CAP),
    "extract_emails": (extract_emails, EXTRACT_EMAILS),
    "extract_phones": (extract_phones, EXTRACT_PHONES),
    "extract_addresses": (extract_addresses, EXTRACT_ADDRESSES),
    "complete_addresses": (complete_addresses, COMPLETE_ADDRESSES),
}

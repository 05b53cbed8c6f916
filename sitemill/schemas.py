"""Record and report schemas."""

TAGS = "ARRAY<STRUCT<named_entity: STRING, tag: STRING>>"

RECORD = f"""
    name STRING, mainURL STRING, address ARRAY<STRING>, contactEmail ARRAY<STRING>, phoneNumber ARRAY<STRING>,
    shortDescription STRING, longDescription STRING, embedding ARRAY<FLOAT>, all_keywords ARRAY<STRING>,
    ner_tags {TAGS}, location_tags ARRAY<STRING>, yake_tags ARRAY<STRING>, type STRING, subtype STRING,
    forEcosystem STRING
"""

DUAL_RECORD = f"""
    name STRING, mainURL STRING, address ARRAY<STRING>, contactEmail ARRAY<STRING>, phoneNumber ARRAY<STRING>,
    shortDescription STRING, longDescription STRING, embedding ARRAY<FLOAT>, vocabulary_keywords ARRAY<STRING>,
    paradigm_keywords ARRAY<STRING>, yake_tags ARRAY<STRING>, ner_tags {TAGS}, location_tags ARRAY<STRING>,
    type STRING, subtype STRING, forEcosystem STRING, failure BOOLEAN
"""

SITE_REPORT = """
    homepage STRING, subdomain_reports STRUCT<subdomains: ARRAY<STRING>, addresses: ARRAY<STRING>,
    phoneNumbers: ARRAY<STRING>, emails: ARRAY<STRING>, yake_tags: ARRAY<STRING>,
    raw_text: STRING>
"""

SITE_TEXT = "homepage STRING, part BIGINT, n_pages BIGINT, raw_text STRING"

FAILURE = "mainURL STRING, failure BOOLEAN, failure_reason STRING"

"""Record, sink, plug-in and job queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import language_queries as L
from checks import sqlparts as S
from checks import tables as T
from checks import text_queries, vector_queries
from checks.link_queries import DENIED, PAGE_TEXTS, ROUTE_LINKS
from checks.site_queries import FOUND_SITES, _sitemap_sql
from sitemill import constants as C
from sitemill import models, schemas
from sitemill.functions import text as X
from sitemill.functions import markup, urls
from sitemill.functions.vectors import DIM
from sitemill.operators import keywords, records, sites
from sitemill.operators import site_keywords as per_site
from sitemill.operators.ranking import rank_within
from sitemill.plans import drops, jobs
from sitemill.sources import inputs, jsonl
from sitemill.workspace import new_path, stage

ECOSYSTEM = "test-job"


def _texts(spark, sf_dir):
    """The documents, each with the letter of the customer of its number, so that texts hold addresses."""
    letters = text_queries._letters(spark, sf_dir).select(F.col("c_custkey").alias("doc_id"), F.col("text").alias("letter"))
    joined = T.documents(spark, sf_dir).select("doc_id", "text").join(letters, "doc_id", "left")
    return joined.select(F.col("doc_id").cast("string").alias("unit"), F.concat_ws(" ", "text", "letter").alias("text"))


def _house(spark, sf_dir):
    """Words of the benchmark texts."""
    b = T.table(spark, sf_dir, "benchmark")
    word = F.explode(F.split(X.sanitize_text(F.col("text")), " ")).alias("term")
    return b.select(word).where(F.length("term") > 3).distinct()


def _paradigm(spark, sf_dir):
    part = T.table(spark, sf_dir, "part")
    return part.select(F.explode(F.split(F.concat_ws(",", "p_name", "p_brand", "p_type"), ",")).alias("term")).distinct()


def _refs(spark, sf_dir):
    nation = T.table(spark, sf_dir, "customer")
    places = nation.select(F.concat(F.expr(text_queries._SENDER.format(k="c_custkey", b="'Mill Oak'", s="string")), F.lit(", USA")).alias("description"))
    return records.References(L.gazetteer(spark, sf_dir), places)


def _flat(df):
    """Array fields as joined strings, the vector as whole millionths."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if name == "embedding":
            c = F.array_join(F.transform(c, lambda x: F.round(x.cast("double") * 10_000).cast("bigint").cast("string")), "|")
        elif name == "ner_tags":
            c = F.array_join(F.transform(c, lambda e: F.concat(e["named_entity"], F.lit("/"), e["tag"])), "|")
        elif kind.startswith("array"):
            c = F.array_join(c, "|")
        out.append(c.alias(name))
    return df.select(*out)


def record_house(spark, sf_dir):
    made = records.records(_texts(spark, sf_dir), [(F.lit(True), _house(spark, sf_dir))], ECOSYSTEM, _refs(spark, sf_dir))
    return _flat(made)


def record_paradigm(spark, sf_dir):
    made = records.records(
        _texts(spark, sf_dir), [(F.lit(True), _paradigm(spark, sf_dir))], ECOSYSTEM, _refs(spark, sf_dir)
    )
    return _flat(made)


def record_dual(spark, sf_dir):
    made = records.dual_records(
        _texts(spark, sf_dir), _house(spark, sf_dir), _paradigm(spark, sf_dir), ECOSYSTEM, _refs(spark, sf_dir)
    )
    return _flat(made)


# --- SQL of the records: each step in its own nested WITH --------------------------------------

# Edit distance counts bytes in the checking engine, so letters outside ASCII get single-byte stand-ins.
_LETTERS = "àâäáãåæçèéêëìíîïñòóôöõøùúûüýÿßœ"
_STAND_INS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&"


def yake_sql(source: str, key: str, value: str) -> str:
    """Keywords of each text: phrases in score order, each kept unless close to one kept before."""
    far = (
        "len(list_filter(k.kept, lambda p: 1 - levenshtein(p, r.plain) / "
        f"greatest(length(p), length(r.plain)) > {keywords.SIMILAR})) = 0"
    )
    return f"""
WITH RECURSIVE ranked_phrases AS (SELECT {key}, surface, translate(phrase, '{_LETTERS}', '{_STAND_INS}') AS plain,
    row_number() OVER (PARTITION BY {key} ORDER BY score, phrase) AS n
  FROM ({L.candidates_sql_of(source, key, value)})),
walk AS (SELECT DISTINCT {key}, 0::BIGINT AS n, []::VARCHAR[] AS kept, []::VARCHAR[] AS shown FROM ranked_phrases
  UNION ALL SELECT k.{key}, r.n, CASE WHEN {far} THEN list_append(k.kept, r.plain) ELSE k.kept END,
    CASE WHEN {far} THEN list_append(k.shown, r.surface) ELSE k.shown END
  FROM walk k JOIN ranked_phrases r ON r.{key} = k.{key} AND r.n = k.n + 1 WHERE len(k.kept) < {keywords.TOP})
SELECT {key}, list_sort(list_distinct(arg_max(shown, n))) AS yake_tags FROM walk GROUP BY 1"""


YAKE_KEYWORDS = f"""
SELECT d.doc_id, coalesce(array_to_string(yake_tags, '|'), '') AS yake_tags FROM documents d
LEFT JOIN ({yake_sql('documents', 'doc_id', 'text')}) y ON y.doc_id = d.doc_id
"""

HOUSE = f"""(SELECT DISTINCT term FROM (SELECT unnest(string_split({S.sanitize_text('text')}, ' ')) AS term FROM benchmark)
  WHERE length(term) > 3)"""
PARADIGM = """(SELECT DISTINCT term FROM (
  SELECT unnest(string_split(concat_ws(',', p_name, p_brand, p_type), ',')) AS term FROM part))"""


def reached_sql(pairs: str, vocabulary: str, threshold: float) -> str:
    """(unit, terms) for pairs(unit, keyword)."""
    return f"""
WITH used AS (SELECT DISTINCT keyword FROM {pairs}),
k AS ({vector_queries._dense('used', 'keyword', 'keyword')}),
v AS ({vector_queries._dense(vocabulary, 'term', 'term')}),
hits AS (SELECT k.keyword, v.term FROM k JOIN v USING (b) GROUP BY 1, 2 HAVING round(sum(k.x * v.x), 4) > {threshold})
SELECT unit, list_sort(list_distinct(list(term))) AS terms FROM {pairs} p JOIN hits h ON h.keyword = p.keyword GROUP BY 1"""


def class_sql(source: str) -> str:
    """(unit, type, subtype) for source(unit, text)."""
    return f"""
WITH anchors AS (SELECT level || ':' || pos AS anchor, * FROM (VALUES {vector_queries._anchor_values()}) v(level, pos, label, text)),
d AS ({vector_queries._dense(source, 'unit', 'text')}),
a AS ({vector_queries._dense('anchors', 'anchor', 'text')}),
dots AS (SELECT d.unit, a.anchor, sum(d.x * a.x) AS score FROM d JOIN a USING (b) GROUP BY 1, 2),
best AS (SELECT k.unit, a.level, arg_max(a.label, (round(coalesce(score, 0), 6), -a.pos)) AS label
  FROM {source} k CROSS JOIN anchors a LEFT JOIN dots t ON t.unit = k.unit AND t.anchor = a.anchor GROUP BY 1, 2)
SELECT t.unit, t.label AS type, CASE WHEN t.label = 'Organization' THEN t.label ELSE s.label END AS subtype
FROM best t JOIN best s ON s.unit = t.unit AND s.level = 'subtype' WHERE t.level = 'type'"""


def common_ctes(source: str) -> str:
    """Fields that need no vocabulary, for source(unit, text)."""
    return f"""
src AS (SELECT unit, text FROM {source} WHERE length(text) > {C.RECORD_TEXT_MIN}),
described AS (WITH {L.description_ctes('src', 'unit', 'text')} SELECT * FROM described),
both_texts AS (SELECT unit, short_description || long_description AS body FROM described),
names AS (WITH spans AS ({L.spans_sql('both_texts', 'unit', 'body')}),
  counted_names AS (SELECT unit, named_entity, count(*) AS n, min(pos) AS pos FROM spans GROUP BY 1, 2)
  SELECT unit, arg_max(named_entity, (n, -pos)) AS name FROM counted_names GROUP BY 1),
gaz AS (SELECT DISTINCT named_entity AS name, CASE WHEN md5(named_entity)[1] < '6' THEN 'LOC' ELSE 'ORG' END AS tag
  FROM ({L.spans_sql('documents', 'doc_id', 'text')}) WHERE md5(named_entity)[1] < 'c'),
mentions AS (SELECT unit, named_entity, min(pos) AS pos, coalesce(any_value(g.tag), 'MISC') AS tag
  FROM ({L.spans_sql('src', 'unit', 'text')}) LEFT JOIN gaz g ON g.name = named_entity GROUP BY 1, 2),
tags AS (SELECT unit, string_agg(named_entity || '/' || tag, '|' ORDER BY pos) AS ner_tags,
  list(named_entity ORDER BY pos) AS entity_names,
  string_agg(named_entity, '|' ORDER BY pos) FILTER (tag = 'LOC') AS location_tags FROM mentions GROUP BY 1),
cells AS ({vector_queries._dense('src', 'unit', 'text')}),
places AS (SELECT DISTINCT {text_queries._SENDER.format(k="c_custkey", b="'Mill Oak'", s="varchar")} || ', USA' AS description FROM customer),
completed AS (SELECT unit, string_agg(DISTINCT description, '|' ORDER BY description) AS address
  FROM (SELECT unit, unnest({S.matches('text', X.US_ADDRESS, 1)}) AS asked FROM src)
  JOIN places ON left(lower(description), length(asked)) = lower(asked) GROUP BY 1),
vectors AS (SELECT k.unit, string_agg(round(coalesce(x, 0)::FLOAT::DOUBLE * 10000)::BIGINT::VARCHAR, '|' ORDER BY s.b) AS embedding
  FROM src k CROSS JOIN range(0, {DIM}) s(b) LEFT JOIN cells c ON c.unit = k.unit AND c.b = s.b GROUP BY 1)"""


COMMON_FIELDS = f"""n.name, s.unit AS "mainURL", coalesce(a.address, '') AS address, {S.joined_matches('s.text', C.EMAIL)} AS "contactEmail",
  {S.joined_matches('s.text', C.PHONE)} AS "phoneNumber", d.short_description AS "shortDescription",
  d.long_description AS "longDescription", v.embedding, coalesce(t.ner_tags, '') AS ner_tags,
  coalesce(t.location_tags, '') AS location_tags, coalesce(array_to_string(y.yake_tags, '|'), '') AS yake_tags,
  c.type, c.subtype, '{ECOSYSTEM}' AS "forEcosystem" """
COMMON_JOINS = """src s JOIN described d USING (unit) LEFT JOIN names n USING (unit) LEFT JOIN tags t USING (unit)
  LEFT JOIN completed a USING (unit) LEFT JOIN vectors v USING (unit) LEFT JOIN yake y USING (unit) LEFT JOIN classes c USING (unit)"""


def record_ctes(source: str, vocabulary: str) -> str:
    return f"""{common_ctes(source)},
yake AS ({yake_sql('src', 'unit', 'text')}),
pairs AS (SELECT unit, unnest(yake_tags) AS keyword FROM yake),
reached AS ({reached_sql('pairs', vocabulary, C.HOUSE_THRESHOLD)}),
joined AS (SELECT unit, array_to_string(list_concat(coalesce(yake_tags, []), coalesce(terms, [])), ',') AS text
  FROM src LEFT JOIN yake USING (unit) LEFT JOIN reached USING (unit)),
classes AS ({class_sql('joined')})"""


def record_sql(source: str, vocabulary: str) -> str:
    return f"""WITH RECURSIVE {record_ctes(source, vocabulary)}
SELECT {COMMON_FIELDS}, coalesce(array_to_string(r.terms, '|'), '') AS all_keywords
FROM {COMMON_JOINS} LEFT JOIN reached r USING (unit)"""


def dual_sql(source: str) -> str:
    return f"""WITH RECURSIVE {common_ctes(source)},
long_texts AS (SELECT unit, s.text || ' ' || d.long_description AS text FROM src s JOIN described d USING (unit)),
yake AS ({yake_sql('long_texts', 'unit', 'text')}),
pairs AS (SELECT unit, unnest(yake_tags) AS keyword FROM yake),
reached AS ({reached_sql('pairs', HOUSE, C.DUAL_HOUSE_THRESHOLD)}),
pool AS (SELECT unit, unnest(list_concat(coalesce(yake_tags, []), coalesce(terms, []), coalesce(entity_names, []))) AS keyword
  FROM src LEFT JOIN yake USING (unit) LEFT JOIN reached USING (unit) LEFT JOIN tags USING (unit)),
in_paradigm AS ({reached_sql('pool', PARADIGM, C.DUAL_PARADIGM_THRESHOLD)}),
joined AS (SELECT unit, array_to_string(list_concat(coalesce(yake_tags, []), coalesce(terms, [])), ',') AS text
  FROM src LEFT JOIN yake USING (unit) LEFT JOIN reached USING (unit)),
classes AS ({class_sql('joined')})
SELECT {COMMON_FIELDS}, coalesce(array_to_string(r.terms, '|'), '') AS vocabulary_keywords,
  coalesce(array_to_string(p.terms, '|'), '') AS paradigm_keywords, false AS failure
FROM {COMMON_JOINS} LEFT JOIN reached r USING (unit) LEFT JOIN in_paradigm p USING (unit)"""


DOC_TEXTS = f"""(WITH {text_queries.LETTERS}
SELECT doc_id::VARCHAR AS unit, concat_ws(' ', d.text, l.text) AS text FROM documents d LEFT JOIN letters l ON l.c_custkey = d.doc_id)"""


def record_to_json(spark, sf_dir):
    """Facts of each document as JSON text, read back by its schema."""
    d = T.documents(spark, sf_dir)
    t = F.col("text")
    made = d.select(
        F.col("doc_id").cast("string").alias("mainURL"),
        X.emails(t).alias("contactEmail"),
        X.phones(t).alias("phoneNumber"),
        F.lit(None).cast("string").alias("name"),
        F.col("lang").alias("forEcosystem"),
    )
    return jsonl.record_json(made)


def _json_list(pattern):
    m = S.matches("text", pattern)
    return f"'[' || coalesce(array_to_string(list_transform({m}, lambda x: to_json(x)::VARCHAR), ','), '') || ']'"


RECORD_TO_JSON = f"""
SELECT '{{"mainURL":"' || doc_id || '","contactEmail":' || {_json_list(C.EMAIL)} || ',"phoneNumber":' || {_json_list(C.PHONE)}
  || ',"name":null,"forEcosystem":"' || lang || '"}}' AS json FROM documents
"""


def jsonl_roundtrip(spark, sf_dir):
    d = T.documents(spark, sf_dir)
    made = d.select("doc_id", "text", X.phones(F.col("text")).alias("phones"), F.lit(None).cast("string").alias("name"))
    path = jsonl.write_jsonl(made, new_path(spark, "roundtrip"))
    back = jsonl.read_jsonl(spark, path, "doc_id bigint, text string, phones array<string>, name string")
    return back.select("doc_id", "text", F.array_join("phones", "|").alias("phones"), "name")


JSONL_ROUNDTRIP = f"""
SELECT doc_id, text, {S.joined_matches('text', C.PHONE)} AS phones, NULL::VARCHAR AS name FROM documents
"""


def missing_params(spark, sf_dir):
    d = T.documents(spark, sf_dir)
    eco = F.when(F.col("lang") != "de", F.col("lang"))
    par = F.when(~F.col("source").endswith("7"), F.col("source"))
    return d.select("doc_id", records.parameter_failure(eco, par).alias("failure_reason"))


MISSING_PARAMS = f"""
SELECT doc_id, CASE WHEN lang = 'de' OR ends_with(source, '7') THEN '{C.NO_PARAMETERS}' END AS failure_reason FROM documents
"""


def _items(spark, sf_dir):
    """Every link of a page list with the text stored for it."""
    fetched = inputs.fetch(T.links(spark, sf_dir), inputs.PageStore(T.pages(spark, sf_dir)))
    return fetched.select(F.col("link").alias("mainURL"), "text", records.text_failure(F.col("text")).alias("failure_reason"))


def failure_rows(spark, sf_dir):
    return records.failure_rows(_items(spark, sf_dir))


ITEMS = f"""links AS (SELECT url AS link FROM pages UNION ALL SELECT DISTINCT {S.origin('url')} FROM pages), {PAGE_TEXTS},
items AS (SELECT l.link AS "mainURL", f.text, CASE WHEN f.text IS NULL THEN '{records.NO_TEXT}'
  WHEN length(f.text) <= {C.RECORD_TEXT_MIN} THEN '{records.SHORT_TEXT}' END AS failure_reason
  FROM links l LEFT JOIN facts f ON {S.page_key('l.link')} = f.url)"""

FAILURE_ROWS = f'WITH {ITEMS} SELECT "mainURL", true AS failure, failure_reason FROM items WHERE failure_reason IS NOT NULL'


def success_rows(spark, sf_dir):
    items = _items(spark, sf_dir).withColumn("failure", F.col("failure_reason").isNotNull())
    return records.success_rows(items).select("mainURL", "text", "failure")


SUCCESS_ROWS = f'WITH {ITEMS} SELECT "mainURL", text, false AS failure FROM items WHERE failure_reason IS NULL'


def plug_model(spark, sf_dir):
    """A model that counts words and fails on texts without letters; the failures stay rows."""

    def count_words(batch):
        if not batch.str.contains("[A-Za-z]").all():
            raise ValueError("no letters")
        return batch.str.count(" ") + 1

    d = T.documents(spark, sf_dir)
    done = models.model_column(count_words, F.col("text"), "bigint")
    return d.select("doc_id", done.alias("r")).select("doc_id", "r.value", "r.error")


PLUG_MODEL = """
SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN len(regexp_extract_all(text, ' ')) + 1 END::BIGINT AS value,
  CASE WHEN NOT regexp_matches(text, '[A-Za-z]') THEN 'ValueError: no letters' END AS error FROM documents
"""


def model_failures(spark, sf_dir):
    """Records from plug-in models of which one refuses tables: each refused text is one failure with its message."""

    def no_tables(batch):
        if batch.str.contains("|", regex=False).any():
            raise ValueError("a table")
        return batch.map(lambda t: [])

    plugged = models.Models(
        entities=no_tables,
        name=lambda batch: batch.str.slice(0, 5),
        short_description=lambda batch: batch.str.slice(0, 20),
        long_description=lambda batch: batch.str.slice(0, 40),
        keywords=lambda batch: batch.map(lambda t: [t[:3]]),
        embedding=lambda batch: batch.map(lambda t: [float(len(t))]),
        key_vector=lambda batch: batch.map(lambda t: [float(len(t)), 1.0, 0.0, 0.0]),
    )
    refs = _refs(spark, sf_dir)
    made = records.records(
        _texts(spark, sf_dir), [(F.lit(True), _house(spark, sf_dir))], ECOSYSTEM, records.References(refs.gazetteer, refs.places, plugged), keep_failed=True
    )
    return made.select("mainURL", "name", "failure_reason")


MODEL_FAILURES = f"""
SELECT unit AS "mainURL", left(text, 5) AS name,
  CASE WHEN contains(text, '|') THEN 'entities: ValueError: a table' END AS failure_reason
FROM {DOC_TEXTS} WHERE length(text) > {C.RECORD_TEXT_MIN}
"""


def single_json(spark, sf_dir):
    """One record over all documents, written as one object in one file, and the text of the file."""
    d = T.documents(spark, sf_dir)
    one = d.agg(
        F.count("*").alias("n_documents"),
        F.array_sort(F.collect_set("lang")).alias("langs"),
        F.sum(F.size(X.phones(F.col("text")))).alias("n_phones"),
    )
    return spark.read.text(jsonl.write_single(one, new_path(spark, "single"))).select("value")


SINGLE_JSON = f"""
SELECT '{{"n_documents":' || count(*) || ',"langs":["' || string_agg(DISTINCT lang, '","' ORDER BY lang) || '"],"n_phones":' ||
  sum(len({S.matches('text', C.PHONE)})) || '}}' AS value FROM documents
"""


def record_from_links(spark, sf_dir):
    """All pages of each site as one link list, shortest first; the first link names the record."""
    p = T.pages(spark, sf_dir)
    page = urls.clean_url(F.col("url"))
    each = p.select(urls.origin(F.col("url")).alias("homepage"), F.struct(F.length(page).alias("size"), page.alias("link")).alias("page"))
    lists = each.distinct().groupBy("homepage").agg(F.array_sort(F.collect_list("page")).alias("found"))
    lists = lists.select(F.col("found.link").alias("links")).withColumn("unit", F.col("links")[0])
    texts = records.texts_from_links(lists, inputs.PageStore(p), records.LINKS_PER_PART)
    return _flat(
        records.dual_records(texts, _house(spark, sf_dir), _paradigm(spark, sf_dir), ECOSYSTEM, _refs(spark, sf_dir))
    )


LINK_TEXTS = f"""(WITH {PAGE_TEXTS}, {_sitemap_sql('pages')}
SELECT min_by(link, position) AS unit, coalesce(string_agg(text, ' ' ORDER BY position), '') AS text
FROM listed LEFT JOIN facts ON {S.is_good('link')} AND facts.url = {S.page_key('link')} GROUP BY homepage)"""


def _job(spark, sf_dir, mode, paradigm=None):
    return jobs.run_job(
        spark,
        T.links(spark, sf_dir),
        T.pages(spark, sf_dir),
        ECOSYSTEM,
        _house(spark, sf_dir),
        _refs(spark, sf_dir),
        paradigm=paradigm,
        mode=mode,
        deny_hosts=DENIED,
        extra_edges=T.page_tree(spark, sf_dir),
    )


def subdomain_records(spark, sf_dir):
    return _flat(_job(spark, sf_dir, jobs.HOUSE).subdomain_records)


def domain_records(spark, sf_dir):
    return _flat(_job(spark, sf_dir, jobs.HOUSE).domain_records)


def _kinds(result):
    """Domain and sub-page records of one job in one table."""
    kinds = [
        result.domain_records.withColumn("kind", F.lit(jsonl.DOMAIN_RECORDS)),
        result.subdomain_records.withColumn("kind", F.lit(jsonl.SUBDOMAIN_RECORDS)),
    ]
    return _flat(kinds[0].unionByName(kinds[1]))


def job_bulk(spark, sf_dir):
    return _kinds(_job(spark, sf_dir, jobs.HOUSE))


def job_bulk_paradigm(spark, sf_dir):
    return _kinds(_job(spark, sf_dir, jobs.PARADIGM, _paradigm(spark, sf_dir)))


def job_dual(spark, sf_dir):
    return _kinds(_job(spark, sf_dir, jobs.DUAL, _paradigm(spark, sf_dir)))


def _denied_homes(denied):
    hosts = ", ".join(S.lit(h) for h in denied) or "''"
    return f"""
job_links AS (SELECT url AS link FROM pages UNION SELECT {S.origin('url')} FROM pages),
homes AS (SELECT DISTINCT CASE WHEN link = {S.origin('link')} THEN link ELSE {S.origin('link')} END AS homepage FROM job_links
  WHERE link = {S.origin('link')} OR {S.host('link')} NOT IN ({hosts})),
subs AS (SELECT link FROM job_links WHERE link <> {S.origin('link')})"""


def _job_sites(denied):
    """CTEs up to job_pages(homepage, position, link, text): the pages of all sites of a bulk job."""
    return f"""{_denied_homes(denied)}, origins AS (SELECT homepage FROM homes), {PAGE_TEXTS}, {FOUND_SITES},
job_pages AS (SELECT homepage, position, link, f.text FROM found_sites
  LEFT JOIN facts f ON {S.is_good('link')} AND f.url = {S.page_key('link')})"""


def job_texts(denied=DENIED):
    """(unit, text, domain) as the bulk jobs see them; sites come from one hop, the crawl and page lists."""
    return f"""(WITH RECURSIVE {_job_sites(denied)},
site AS (SELECT homepage, coalesce(string_agg(text, ' ' ORDER BY position), '') AS raw_text FROM job_pages GROUP BY 1)
SELECT homepage AS unit, {S.gated('raw_text')} AS text, true AS domain FROM site
UNION ALL SELECT link, f.text, false FROM subs LEFT JOIN facts f ON {S.is_good('link')} AND f.url = {S.page_key('link')})"""


def job_sql(house_of_domain, dual=False):
    denied = () if dual else DENIED
    texts = job_texts(denied)
    kind = f"""CASE WHEN j.domain THEN '{jsonl.DOMAIN_RECORDS}' ELSE '{jsonl.SUBDOMAIN_RECORDS}' END AS kind"""
    if dual:
        return f'SELECT r.*, {kind} FROM ({dual_sql(texts)}) r JOIN {texts} j ON j.unit = r."mainURL"'
    domain = record_sql(f"(SELECT unit, text FROM {texts} WHERE domain)", house_of_domain)
    pages = record_sql(f"(SELECT unit, text FROM {texts} WHERE NOT domain)", HOUSE)
    return (
        f"SELECT *, '{jsonl.DOMAIN_RECORDS}' AS kind FROM ({domain}) "
        f"UNION ALL BY NAME SELECT *, '{jsonl.SUBDOMAIN_RECORDS}' AS kind FROM ({pages})"
    )


def job_outputs(spark, sf_dir):
    """Lines per kind after all outputs were written under their job and run, and read back as text."""
    root = new_path(spark, "outputs")
    paths = _job(spark, sf_dir, jobs.HOUSE).write(root, ECOSYSTEM)
    lines = spark.read.text(root, recursiveFileLookup=False)
    assert len(paths) == 5
    return lines.groupBy("kind", "job").agg(F.count("*").alias("n_lines"))


def job_drops(spark, sf_dir):
    """Lines per kind after two link drops: the links of half the sites, then all links, the former among them."""
    source, root = new_path(spark, "drops"), new_path(spark, "drop-outputs")
    links = T.links(spark, sf_dir)
    early = links.where(F.pmod(F.xxhash64(urls.site_key(F.col("link"))), F.lit(2)) == 0)
    job = T.pages(spark, sf_dir), ECOSYSTEM, _house(spark, sf_dir), _refs(spark, sf_dir)
    for number, drop in enumerate((early, links)):
        drop.write.text(f"{source}/{number}")
        drops.run_drops(
            spark, f"{source}/*", root, *job, files_per_run=100_000, deny_hosts=DENIED, extra_edges=T.page_tree(spark, sf_dir)
        )
    return spark.read.text(root).groupBy("kind", "job").agg(F.count("*").alias("n_lines"))


def job_manifest(spark, sf_dir):
    """The manifest of a written run: rows per kind, failures by reason, roles of the links."""
    root = new_path(spark, "outputs")
    _job(spark, sf_dir, jobs.HOUSE).write(root, ECOSYSTEM, 1)
    found = jobs.read_manifest(spark, root, ECOSYSTEM, 1)
    counted = F.explode(F.map_concat(F.create_map(F.lit("rows"), "n_rows"), F.coalesce("counts", F.create_map().cast("map<string,bigint>"))))
    return found.select("kind", counted.alias("counter", "n")).where("n > 0")


def job_manifest_sql():
    links = f"FROM ({ROUTE_LINKS})"
    reason = f"""CASE WHEN domain AND text IS NULL THEN '{jobs.SHORT_SITE}' WHEN text IS NULL THEN '{records.NO_TEXT}'
  ELSE '{records.SHORT_TEXT}' END"""
    return f"""
SELECT kind, 'rows' AS counter, n_lines AS n FROM ({job_outputs_sql()})
UNION ALL SELECT '{jsonl.FAILURES}', {reason}, count(*) FROM {job_texts()} WHERE NOT coalesce(length(text) > {C.RECORD_TEXT_MIN}, false) GROUP BY 2
UNION ALL SELECT 'links', 'rows', count(*) {links}
UNION ALL SELECT 'links', c, n FROM (SELECT unnest(['n_homepages', 'n_subdomains', 'n_dont_scrape', 'n_invalid']) AS c,
  unnest([count(homepage), count(*) FILTER (is_subdomain), count(*) FILTER (dont_scrape), count(failure_reason)]) AS n {links}) WHERE n > 0
"""


def job_outputs_sql():
    made = f"length(text) > {C.RECORD_TEXT_MIN}"
    return f"""
WITH texts AS (SELECT *, coalesce({made}, false) AS made FROM {job_texts()}), kinds AS (
  SELECT '{jsonl.DOMAIN_RECORDS}' AS kind, count(*) FILTER (made AND domain) AS n_lines FROM texts
  UNION ALL SELECT '{jsonl.SUBDOMAIN_RECORDS}', count(*) FILTER (made AND NOT domain) FROM texts
  UNION ALL SELECT '{jsonl.SITE_REPORTS}', count(*) FILTER (domain) FROM texts
  UNION ALL SELECT '{jsonl.SITE_TEXTS}', count(*) FROM (WITH RECURSIVE {_job_sites(DENIED)}
    SELECT DISTINCT homepage, (position - 1) // {sites.PAGES_PER_PART} FROM job_pages)
  UNION ALL SELECT '{jsonl.FAILURES}', count(*) FILTER (NOT made) FROM texts)
SELECT kind, '{ECOSYSTEM}' AS job, n_lines FROM kinds WHERE n_lines > 0
"""


def site_reports(spark, sf_dir):
    r = F.col("subdomain_reports")
    return _job(spark, sf_dir, jobs.HOUSE).site_reports.select(
        "homepage",
        F.array_join(r["subdomains"], "|").alias("subdomains"),
        F.array_join(r["yake_tags"], "|").alias("yake_tags"),
        r["raw_text"].alias("raw_text"),
    )


def site_reports_sql():
    return f"""WITH RECURSIVE {_job_sites(DENIED)},
site AS (SELECT homepage, string_agg(link, '|' ORDER BY position) AS subdomains,
  coalesce(string_agg(text, ' ' ORDER BY position), '') AS raw_text FROM job_pages GROUP BY 1),
yake AS ({yake_sql('site', 'homepage', 'raw_text')})
SELECT s.homepage, subdomains, coalesce(array_to_string(yake_tags, '|'), '') AS yake_tags, {S.gated('raw_text')} AS raw_text
FROM site s LEFT JOIN yake y ON y.homepage = s.homepage"""


def site_keywords(spark, sf_dir):
    """Keywords of whole sites, each page a part of its own."""
    p = T.pages(spark, sf_dir).select(urls.origin(F.col("url")).alias("unit"), "url", "page_id", markup.page_text(F.col("html")).alias("text"))
    parts = rank_within(p, ["unit"], ["url", "page_id"], "part").select("unit", "part", F.coalesce("text", F.lit("")).alias("text"))
    found = per_site.keywords(stage(parts, "page-parts"))
    return found.select(F.col("unit").alias("homepage"), F.array_join("yake_tags", "|").alias("yake_tags"))


def site_keywords_sql():
    return f"""WITH RECURSIVE site AS (SELECT {S.origin('url')} AS homepage,
  coalesce(string_agg({S.page_text('html')}, chr(10) ORDER BY url, page_id), '') AS raw_text FROM pages GROUP BY 1),
yake AS ({yake_sql('site', 'homepage', 'raw_text')})
SELECT s.homepage, coalesce(array_to_string(yake_tags, '|'), '') AS yake_tags FROM site s LEFT JOIN yake y ON y.homepage = s.homepage"""


def _single(spark, sf_dir, vocabulary):
    p = T.pages(spark, sf_dir)
    first = p.where(urls.is_good(F.col("url"))).agg(F.array(F.min("url")).alias("links"))
    return _flat(jobs.run_single(first, p, ECOSYSTEM, vocabulary, _refs(spark, sf_dir)))


def job_single(spark, sf_dir):
    return _single(spark, sf_dir, _house(spark, sf_dir))


def job_single_paradigm(spark, sf_dir):
    return _single(spark, sf_dir, _paradigm(spark, sf_dir))


def single_sql(vocabulary):
    source = f"""(WITH {PAGE_TEXTS}, one AS (SELECT min(url) AS link FROM pages WHERE {S.is_good('url')})
SELECT link AS unit, f.text FROM one JOIN facts f ON f.url = {S.page_key('link')})"""
    return f"SELECT *, NULL::VARCHAR AS msg FROM ({record_sql(source, vocabulary)})"


QUERIES = {
    "yake_keywords": (L.yake_keywords, YAKE_KEYWORDS),
    "jsonl_roundtrip": (jsonl_roundtrip, JSONL_ROUNDTRIP),
    "record_to_json": (record_to_json, RECORD_TO_JSON),
    "missing_params": (missing_params, MISSING_PARAMS),
    "failure_rows": (failure_rows, FAILURE_ROWS),
    "success_rows": (success_rows, SUCCESS_ROWS),
    "plug_model": (plug_model, PLUG_MODEL),
    "model_failures": (model_failures, MODEL_FAILURES),
    "single_json": (single_json, SINGLE_JSON),
    "record_house": (record_house, lambda: record_sql(DOC_TEXTS, HOUSE)),
    "record_paradigm": (record_paradigm, lambda: record_sql(DOC_TEXTS, PARADIGM)),
    "record_dual": (record_dual, lambda: dual_sql(DOC_TEXTS)),
    "record_from_links": (record_from_links, lambda: dual_sql(LINK_TEXTS)),
    "job_single": (job_single, lambda: single_sql(HOUSE)),
    "job_single_paradigm": (job_single_paradigm, lambda: single_sql(PARADIGM)),
    "subdomain_records": (
        subdomain_records,
        lambda: record_sql(f"(SELECT unit, text FROM {job_texts()} WHERE NOT domain)", HOUSE),
    ),
    "domain_records": (domain_records, lambda: record_sql(f"(SELECT unit, text FROM {job_texts()} WHERE domain)", HOUSE)),
    "site_keywords": (site_keywords, lambda: site_keywords_sql()),
    "site_reports": (site_reports, lambda: site_reports_sql()),
    "job_bulk": (job_bulk, lambda: job_sql(HOUSE)),
    "job_bulk_paradigm": (job_bulk_paradigm, lambda: job_sql(PARADIGM)),
    "job_dual": (job_dual, lambda: job_sql(None, dual=True)),
    "job_outputs": (job_outputs, lambda: job_outputs_sql()),
    "job_drops": (job_drops, lambda: job_outputs_sql()),
    "job_manifest": (job_manifest, lambda: job_manifest_sql()),
}

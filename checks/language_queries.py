"""Entity, description and keyword queries over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqlparts as S
from checks import tables as T
from sitemill import constants as C
from sitemill.functions import text as X
from sitemill.operators import entities, keywords, names, summaries, tokens


def _stop_list() -> str:
    return ", ".join(S.lit(w) for w in tokens.stop_words())


def weak(term: str) -> str:
    return f"(length({term}) < {tokens.MIN_WORD} OR NOT regexp_matches({term}, '\\p{{L}}') OR {term} IN ({_stop_list()}))"


def sentence_sql(source: str, key: str, value: str) -> str:
    return f"""SELECT {key}, len(found) AS n_sentences, unnest(range(0, len(found))) AS sentence, unnest(found) AS body
    FROM (SELECT {key}, {S.sentences(value)} AS found FROM {source})"""


def word_sql(source: str, key: str, value: str) -> str:
    return f"""SELECT {key}, n_sentences, sentence, chunk, unnest(range(0, len(near))) AS place, unnest(near) AS word, near
    FROM (SELECT {key}, n_sentences, sentence, unnest(range(0, len(found))) AS chunk,
            list_transform(found, lambda c: {S.chunk_words('c')}) AS split_chunks,
            unnest(list_transform(found, lambda c: {S.chunk_words('c')})) AS near
          FROM (SELECT {key}, n_sentences, sentence, {S.chunks('body')} AS found FROM ({sentence_sql(source, key, value)})))"""


def _texts(spark, sf_dir):
    return T.documents(spark, sf_dir).select(F.col("doc_id").alias("unit"), "text")


def gazetteer(spark, sf_dir):
    """Names of the documents themselves; the tag follows from a digest of the name."""
    names = entities.entity_spans(_texts(spark, sf_dir)).select(F.col("named_entity").alias("name")).distinct()
    digit = F.substring(F.md5("name"), 1, 1)
    names = names.where(digit < "c")
    return names.withColumn("tag", F.when(digit < "6", "LOC").otherwise("ORG"))


def entity_last_tag(spark, sf_dir):
    """Tags that depend on the sentence of a mention: the last mention of a name decides."""
    names = entities.entity_spans(_texts(spark, sf_dir)).select(F.col("named_entity").alias("name")).distinct()
    plain = names.select("name", F.lit("ORG").alias("tag"), F.lit(None).cast("string").alias("cue"))
    cued = names.select("name", F.lit("LOC").alias("tag"), F.lit(CUE).alias("cue"))
    shown = F.transform("ner_tags", lambda e: F.concat(e["named_entity"], F.lit("/"), e["tag"]))
    found = entities.entity_tags(_texts(spark, sf_dir), plain.unionByName(cued))
    return found.select(F.col("unit").alias("doc_id"), F.array_join(shown, "|").alias("ner_tags"))


def name_mentions(spark, sf_dir):
    """Names of one to six words, the first ones of each document, sought in all documents."""
    d = T.documents(spark, sf_dir)
    words = F.regexp_extract_all("text", F.lit(names.WORD), 0)
    first = d.select(F.array_join(F.slice(words, 1, (1 + F.col("doc_id") % 6).cast("int")), " ").alias("name")).distinct()
    first = first.withColumn("tag", F.when(F.substring(F.md5("name"), 1, 1) < "8", "LOC").otherwise("ORG"))
    found = names.name_mentions(_texts(spark, sf_dir), first)
    return found.select(F.col("unit").alias("doc_id"), *(F.col(c).cast("bigint").alias(c) for c in ("sentence", "place")), "named_entity", "tag")


def name_mentions_sql():
    return f"""
WITH RECURSIVE gaz AS (SELECT DISTINCT regexp_extract_all(text, '{names.WORD}', 0)[1:1 + doc_id % 6] AS words FROM documents),
known AS (SELECT array_to_string(words, ' ') AS name, len(words) AS size FROM gaz WHERE len(words) > 0),
s AS (SELECT doc_id, sentence, regexp_extract_all(body, '{names.WORD}', 0) AS words FROM ({sentence_sql('documents', 'doc_id', 'text')})),
spots AS (SELECT doc_id, sentence, words, unnest(range(0, len(words))) AS place FROM s),
tried AS (SELECT doc_id, sentence, place, n.size, array_to_string(words[place + 1:place + n.size], ' ') AS name
  FROM spots, (SELECT DISTINCT size FROM known) n WHERE place + n.size <= len(words)),
hits AS (SELECT t.*, row_number() OVER (PARTITION BY doc_id, sentence ORDER BY t.size DESC, place) AS nth FROM tried t SEMI JOIN known USING (name)),
walk AS (SELECT DISTINCT doc_id, sentence, 0::BIGINT AS nth, []::BIGINT[] AS taken, false AS kept FROM hits
  UNION ALL SELECT w.doc_id, w.sentence, h.nth, CASE WHEN list_has_any(w.taken, range(h.place, h.place + h.size)) THEN w.taken
      ELSE list_concat(w.taken, range(h.place, h.place + h.size)) END, NOT list_has_any(w.taken, range(h.place, h.place + h.size))
  FROM walk w JOIN hits h ON h.doc_id = w.doc_id AND h.sentence = w.sentence AND h.nth = w.nth + 1)
SELECT h.doc_id, h.sentence, h.place, h.name AS named_entity, CASE WHEN md5(h.name)[1] < '8' THEN 'LOC' ELSE 'ORG' END AS tag
FROM hits h JOIN walk w ON w.doc_id = h.doc_id AND w.sentence = h.sentence AND w.nth = h.nth AND w.kept
"""


CUE = "the"


def last_tag_sql():
    return f"""
WITH spans AS (SELECT doc_id, unnest(found) AS named_entity, contains(body, '{CUE}') AS cued,
    sentence * {entities.SPANS_PER_SENTENCE} + unnest(range(0, len(found))) AS pos
    FROM (SELECT doc_id, sentence, body, {S.proper_spans('body')} AS found FROM ({sentence_sql('documents', 'doc_id', 'text')}))),
each_name AS (SELECT doc_id, named_entity, min(pos) AS pos, CASE WHEN arg_max(cued, pos) THEN 'LOC' ELSE 'ORG' END AS tag
  FROM spans GROUP BY 1, 2)
SELECT d.doc_id, coalesce(string_agg(named_entity || '/' || tag, '|' ORDER BY pos), '') AS ner_tags
FROM documents d LEFT JOIN each_name e ON e.doc_id = d.doc_id GROUP BY 1
"""


def _tags(spark, sf_dir):
    return entities.entity_tags(_texts(spark, sf_dir), gazetteer(spark, sf_dir))


def entity_tags(spark, sf_dir):
    shown = F.transform("ner_tags", lambda e: F.concat(e["named_entity"], F.lit("/"), e["tag"]))
    return _tags(spark, sf_dir).select(F.col("unit").alias("doc_id"), F.array_join(shown, "|").alias("ner_tags"))


def spans_sql(source: str, key: str, value: str) -> str:
    return f"""SELECT {key}, unnest(found) AS named_entity,
    sentence * {entities.SPANS_PER_SENTENCE} + unnest(range(0, len(found))) AS pos
    FROM (SELECT {key}, sentence, {S.proper_spans('body')} AS found FROM ({sentence_sql(source, key, value)}))"""


SPANS = f"spans AS ({spans_sql('documents', 'doc_id', 'text')})"
TAGGED = f"""{SPANS},
gaz AS (SELECT DISTINCT named_entity AS name, CASE WHEN md5(named_entity)[1] < '6' THEN 'LOC' ELSE 'ORG' END AS tag
  FROM spans WHERE md5(named_entity)[1] < 'c'),
each_name AS (SELECT doc_id, named_entity, min(pos) AS pos, coalesce(any_value(g.tag), 'MISC') AS tag
  FROM spans LEFT JOIN gaz g ON g.name = named_entity GROUP BY 1, 2)"""

ENTITY_TAGS = f"""
WITH {TAGGED} SELECT d.doc_id, coalesce(string_agg(named_entity || '/' || tag, '|' ORDER BY pos), '') AS ner_tags
FROM documents d LEFT JOIN each_name e ON e.doc_id = d.doc_id GROUP BY 1
"""


def location_tags(spark, sf_dir):
    found = _tags(spark, sf_dir).withColumn("found", entities.location_tags(F.col("ner_tags")))
    return found.select(F.col("unit").alias("doc_id"), F.array_join("found", "|").alias("location_tags"))


LOCATION_TAGS = f"""
WITH {TAGGED} SELECT d.doc_id, coalesce(string_agg(named_entity, '|' ORDER BY pos) FILTER (tag = 'LOC'), '') AS location_tags
FROM documents d LEFT JOIN each_name e ON e.doc_id = d.doc_id GROUP BY 1
"""


def _descriptions(spark, sf_dir):
    return summaries.descriptions(_texts(spark, sf_dir))


def short_description(spark, sf_dir):
    return _descriptions(spark, sf_dir).select(F.col("unit").alias("doc_id"), "short_description")


def long_description(spark, sf_dir):
    return _descriptions(spark, sf_dir).select(F.col("unit").alias("doc_id"), "long_description")


def description_ctes(source: str, key: str, value: str) -> str:
    return f"""
capped AS (SELECT {key}, {S.summary_input(value)} AS body FROM {source}),
words AS (SELECT {key}, sentence, lower(word) AS term FROM ({word_sql('capped', key, 'body')})),
counted AS (SELECT *, count(*) OVER (PARTITION BY {key}, term) AS tf FROM words),
scored AS (SELECT {key}, sentence, coalesce(round(avg(tf) FILTER (NOT {weak('term')}), 6), 0) AS score FROM counted GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, sentence) AS place FROM scored),
described AS (SELECT c.{key},
  coalesce(string_agg(s.body, ' ' ORDER BY s.sentence) FILTER (place <= {C.SHORT_SENTENCES}), '{C.EMPTY_SUMMARY}') AS short_description,
  coalesce(string_agg(s.body, ' ' ORDER BY s.sentence) FILTER (place <= {C.LONG_SENTENCES}), '{C.EMPTY_SUMMARY}') AS long_description
  FROM capped c LEFT JOIN ({sentence_sql('capped', key, 'body')}) s ON s.{key} = c.{key}
  LEFT JOIN placed p ON p.{key} = s.{key} AND p.sentence = s.sentence GROUP BY 1)"""


def _described():
    return description_ctes("documents", "doc_id", "text")


def short_sql():
    return f"WITH {_described()} SELECT doc_id, short_description FROM described"


def long_sql():
    return f"WITH {_described()} SELECT doc_id, long_description FROM described"


def record_name(spark, sf_dir):
    both = _descriptions(spark, sf_dir).select("unit", F.concat("short_description", "long_description").alias("text"))
    return entities.record_name(both).select(F.col("unit").alias("doc_id"), "name")


def name_sql():
    return f"""
WITH {_described()},
both_texts AS (SELECT doc_id, short_description || long_description AS body FROM described),
spans AS ({spans_sql('both_texts', 'doc_id', 'body')}),
counted_names AS (SELECT doc_id, named_entity, count(*) AS n, min(pos) AS pos FROM spans GROUP BY 1, 2)
SELECT d.doc_id, arg_max(named_entity, (n, -pos)) AS name FROM documents d LEFT JOIN counted_names c ON c.doc_id = d.doc_id GROUP BY 1
"""


def yake_terms(spark, sf_dir):
    t = keywords.term_statistics(_texts(spark, sf_dir))
    return t.select(
        F.col("unit").alias("doc_id"),
        "term",
        "tf",
        F.col("cased").cast("bigint").alias("cased"),
        F.col("in_sentences").cast("bigint").alias("in_sentences"),
        "middle",
        F.round("score", 6).alias("score"),
    )


def term_ctes(source: str, key: str, value: str) -> str:
    return f"""
all_words AS (SELECT {key}, n_sentences, sentence, chunk, place, word, lower(word) AS term, near,
  CASE WHEN place > 0 THEN lower(near[place]) END AS before, lower(near[place + 2]) AS after
  FROM ({word_sql(source, key, value)})),
topic AS (SELECT * FROM all_words WHERE NOT {weak('term')}),
stats AS (SELECT {key}, term, any_value(n_sentences) AS n_sentences, count(*) AS tf,
  greatest(count(*) FILTER (word = upper(word) AND length(word) > 1),
    count(*) FILTER (regexp_matches(word, '^\\p{{Lu}}') AND NOT (chunk = 0 AND place = 0))) AS cased,
  count(DISTINCT sentence) AS in_sentences, median(sentence)::DOUBLE AS middle,
  coalesce(count(DISTINCT before) / nullif(count(before), 0), 0) AS l, coalesce(count(DISTINCT after) / nullif(count(after), 0), 0) AS r
  FROM topic GROUP BY 1, 2),
wide AS (SELECT *, max(tf) OVER w AS max_tf, sum(tf) OVER w / count(*) OVER w AS mean_tf,
  sqrt(greatest(sum(tf * tf) OVER w / count(*) OVER w - (sum(tf) OVER w / count(*) OVER w) ** 2, 0)) AS std_tf
  FROM stats WINDOW w AS (PARTITION BY {key})),
rel AS (SELECT *, 1 + (l + r) * tf / max_tf AS related FROM wide),
terms AS (SELECT {key}, term, tf, cased, in_sentences, middle,
  related * ln(ln(3 + middle)) / (cased / (1 + ln(tf)) + tf / (mean_tf + std_tf) / related + in_sentences / n_sentences / related) AS score
  FROM rel)"""


def terms_sql():
    return f"""
WITH {term_ctes('documents', 'doc_id', 'text')}
SELECT doc_id, term, tf, cased, in_sentences, middle, round(score, 6) AS score FROM terms
"""


def yake_keywords(spark, sf_dir):
    k = keywords.keywords(_texts(spark, sf_dir))
    return k.select(F.col("unit").alias("doc_id"), F.array_join("yake_tags", "|").alias("yake_tags"))


def yake_candidates(spark, sf_dir):
    c = keywords.candidates(_texts(spark, sf_dir))
    return c.select(F.col("unit").alias("doc_id"), "phrase", "tf", "score")


def candidates_sql_of(source: str, key: str, value: str) -> str:
    return f"""
WITH {term_ctes(source, key, value)},
runs AS (
  SELECT {key}, sentence, chunk, place, word AS surface, [term] AS used FROM topic
  UNION ALL SELECT {key}, sentence, chunk, place, word || ' ' || near[place + 2], [term, lower(near[place + 2])]
    FROM topic WHERE NOT {weak('lower(near[place + 2])')}
  UNION ALL SELECT {key}, sentence, chunk, place, word || ' ' || near[place + 2] || ' ' || near[place + 3],
    CASE WHEN {weak('lower(near[place + 2])')} THEN [term, lower(near[place + 3])]
      ELSE [term, lower(near[place + 2]), lower(near[place + 3])] END
    FROM topic WHERE NOT {weak('lower(near[place + 3])')}),
phrases AS (SELECT {key}, lower(surface) AS phrase, arg_min(surface, (sentence, chunk, place)) AS surface,
  count(*) AS tf, any_value(used) AS used FROM runs GROUP BY 1, 2),
parts AS (SELECT {key}, phrase, surface, tf, unnest(used) AS term FROM phrases),
joined AS (SELECT p.{key}, p.phrase, p.surface, p.tf, product(t.score) AS prod, sum(t.score) AS total
  FROM parts p JOIN terms t ON t.{key} = p.{key} AND t.term = p.term GROUP BY 1, 2, 3, 4)
SELECT {key}, phrase, surface, tf, round(prod / (tf * (1 + total)), {keywords.SCORE_DIGITS}) AS score FROM joined
"""


def candidates_sql():
    inner = candidates_sql_of("documents", "doc_id", "text")
    return f"SELECT doc_id, phrase, tf, score FROM ({inner})"


QUERIES = {
    "entity_tags": (entity_tags, ENTITY_TAGS),
    "entity_last_tag": (entity_last_tag, lambda: last_tag_sql()),
    "name_mentions": (name_mentions, lambda: name_mentions_sql()),
    "location_tags": (location_tags, LOCATION_TAGS),
    "short_description": (short_description, lambda: short_sql()),
    "long_description": (long_description, lambda: long_sql()),
    "record_name": (record_name, lambda: name_sql()),
    "yake_terms": (yake_terms, lambda: terms_sql()),
    "yake_candidates": (yake_candidates, lambda: candidates_sql()),
}

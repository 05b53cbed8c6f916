"""The registered queries of the subpackage and the SQL that states the same results."""

from __future__ import annotations

import corpus_pipeline
from sitemill.llm import config_pack, decontaminate, factor_toxicity, hilbert_negatives, lattice_lm, line_windows, lsh_forest, mixing_coder, pairwise_quality, rotation_codes, shards, turn_trees, warc_segments
from sitemill.llm.frames import table
from sitemill.workspace import new_path

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def op1_warc_segments(spark, sf_dir):
    return warc_segments.report(table(spark, sf_dir, "pages"), new_path(spark, "warc"))


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f"""


def op2_lsh_forest(spark, sf_dir):
    return lsh_forest.report(table(spark, sf_dir, "documents"))


def op3_line_windows(spark, sf_dir):
    return line_windows.report(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(0, len(x) - 2)) AS line FROM l WHERE len(x) >= 3),
w AS (SELECT doc_id, line, x[line + 1:line + 3] AS gram FROM p),
r AS (SELECT gram, min((doc_id, line)) AS stays FROM w GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(line, line + 3)) AS line FROM w JOIN r USING (gram) WHERE (doc_id, line) > stays),
g AS (SELECT doc_id, list(line) AS gone FROM gone GROUP BY 1)
SELECT doc_id, coalesce(len(x), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN text ELSE array_to_string(
    list_transform(list_filter(range(0, len(x)), lambda i: NOT list_contains(gone, i)), lambda i: x[i + 1]), chr(10)) END) AS kept_sha256
FROM l LEFT JOIN g USING (doc_id)"""


def op4_shards(spark, sf_dir):
    return shards.report(table(spark, sf_dir, "documents"), new_path(spark, "shards"))


def op5_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_mixing_coder(spark, sf_dir):
    path = new_path(spark, "token-ids")
    mixing_coder.write(table(spark, sf_dir, "documents"), path)
    return mixing_coder.read(spark, path, with_ids=False)


def op7_config_pack(spark, sf_dir):
    return config_pack.pack_documents(table(spark, sf_dir, "documents"))


def op8_quality(spark, sf_dir):
    return pairwise_quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_rotation_codes(spark, sf_dir):
    return rotation_codes.near_duplicates(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c"""


def op10_toxicity(spark, sf_dir):
    return factor_toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_lattice_lm(spark, sf_dir):
    return lattice_lm.scores(table(spark, sf_dir, "documents"))


def op12_turn_trees(spark, sf_dir):
    return turn_trees.prefix_nodes(table(spark, sf_dir, "conversations"))


#: crc32 of a decimal number, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

OP12_SQL = f"""
WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, sha256(length(role)::VARCHAR || ':' || role || text) AS id, strlen(text)::BIGINT AS size FROM given),
own AS (SELECT conv_id, list(struct_pack(id := id, size := size) ORDER BY turn NULLS FIRST, id) AS x FROM t GROUP BY 1),
c AS (SELECT conv_id, x, conv_id - conv_id % 5 AS base, {_CRC32} % 9 AS h FROM own),
s AS (SELECT c.conv_id, list_concat(coalesce(b.x[1:c.h], []), c.x[c.h + 1:len(c.x)]) AS x FROM c LEFT JOIN own b ON b.conv_id = c.base),
m AS (SELECT conv_id, unnest(range(0, len(x) + 1)) AS depth, x FROM s),
n AS (SELECT depth, list_transform(x[1:depth], lambda e: e.id) AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
    any_value(CASE WHEN depth > 0 THEN x[depth].size ELSE 0 END) AS size,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(x) = depth), '') AS ends FROM m GROUP BY 1, 2),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
u AS (SELECT path[1:unnest(range(0, depth + 1))] AS path, (n_children = 0)::BIGINT AS leaf, (n_convs - 1) * size AS saved FROM w),
g AS (SELECT path, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM u GROUP BY 1)
SELECT w.conv_id, w.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
  g.n_leaves::BIGINT AS n_leaves, g.saved_tokens::BIGINT AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN g USING (path) LEFT JOIN n p ON w.depth > 0 AND p.path = w.path[1:w.depth - 1]"""


def op13_hilbert_negatives(spark, sf_dir):
    return hilbert_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""


def _words(text: str) -> str:
    lowered = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"coalesce(regexp_extract_all({lowered}, '{WORD}'), [])"


OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
i AS (SELECT DISTINCT item_id, {_words('text')} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS gram
      FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM g),
spot AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size),
found AS (SELECT doc_id, a.size, p, item_id FROM (SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS gram FROM spot) a
          JOIN g ON g.size = a.size AND g.gram = a.gram),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS listed
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM found WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


QUERIES = {
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
    "op1_warc_segments": (op1_warc_segments, OP1_SQL),
    "op2_lsh_forest": (op2_lsh_forest, None),
    "op3_line_windows": (op3_line_windows, OP3_SQL),
    "op4_shards": (op4_shards, None),
    "op5_decontaminate": (op5_decontaminate, OP5_SQL),
    "op6_mixing_coder": (op6_mixing_coder, None),
    "op7_config_pack": (op7_config_pack, None),
    "op8_quality": (op8_quality, None),
    "op9_rotation_codes": (op9_rotation_codes, OP9_SQL),
    "op10_toxicity": (op10_toxicity, None),
    "op11_lattice_lm": (op11_lattice_lm, None),
    "op12_turn_trees": (op12_turn_trees, OP12_SQL),
    "op13_hilbert_negatives": (op13_hilbert_negatives, OP13_SQL),
}


def queries():
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in QUERIES.items() if sql is not None}

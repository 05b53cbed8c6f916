"""Vector, vocabulary and classifier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqlparts as S
from checks import tables as T
from sitemill import constants as C
from sitemill.functions import text
from sitemill.functions import vectors as V
from sitemill.models import Models
from sitemill.operators import classify, embedding, term_vectors, vocabulary
from sitemill.workspace import stage

MICRO = 1_000_000


def _micro(vector):
    """Vector as a string of whole millionths, equal in both engines."""
    return F.array_join(F.transform(vector, lambda x: F.round(x * MICRO).cast("bigint").cast("string")), "|")


def _doc_texts(spark, sf_dir):
    return T.documents(spark, sf_dir).select(F.col("doc_id").alias("unit"), "text")


def _doc_vectors(spark, sf_dir):
    return embedding.embed_texts(_doc_texts(spark, sf_dir)).withColumnRenamed("unit", "doc_id")


def text_embedding(spark, sf_dir):
    return _doc_vectors(spark, sf_dir).select("doc_id", _micro(F.col("vector")).alias("vector"))


def _slots(source: str, key: str, value: str, dim: int = V.DIM) -> str:
    return f"""SELECT {key}, b, ln(1 + count(*)) AS w FROM (
    SELECT {key}, (('0x' || substr(md5(word), 1, 8))::BIGINT % {dim}) AS b FROM (
      SELECT {key}, unnest(string_split({S.sanitize_text(value)}, ' ')) AS word FROM {source}) WHERE word <> '')
    GROUP BY 1, 2"""


def _dense(source: str, key: str, value: str, dim: int = V.DIM) -> str:
    """(key, b, x): unit vectors in long form, zero cells left out."""
    return f"""SELECT {key}, b, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS x FROM ({_slots(source, key, value, dim)})"""


def _embedding_sql(source: str, key: str, value: str) -> str:
    return f"""
WITH cells AS ({_dense(source, key, value)})
SELECT k.{key}, string_agg(round(coalesce(x, 0) * {MICRO})::BIGINT::VARCHAR, '|' ORDER BY s.b) AS vector
FROM (SELECT DISTINCT {key} FROM {source}) k CROSS JOIN range(0, {V.DIM}) s(b)
LEFT JOIN cells c ON c.{key} = k.{key} AND c.b = s.b GROUP BY 1
"""


TEXT_EMBEDDING = _embedding_sql("documents", "doc_id", "text")


def term_embedding(spark, sf_dir):
    terms = T.table(spark, sf_dir, "part").select(F.col("p_name").alias("term")).distinct()
    return terms.select("term", _micro(V.term_vector(F.col("term"))).alias("vector"))


TERM_EMBEDDING = _embedding_sql("(SELECT DISTINCT p_name AS term FROM part)", "term", "term")


def _queries(spark, sf_dir):
    e = T.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))


def _centroids(spark, sf_dir):
    return vocabulary.label_centroids(T.table(spark, sf_dir, "embeddings"), "label", "embedding")


def dot_scores(spark, sf_dir):
    s = vocabulary.dot_scores(_queries(spark, sf_dir), _centroids(spark, sf_dir))
    return s.withColumn("score", F.round("score", 4))


SCORES = f"""
cells AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS slot, unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT label::VARCHAR AS term, slot, avg(x) AS x FROM cells GROUP BY 1, 2),
centroids AS (SELECT term, slot, x / sqrt(sum(x * x) OVER (PARTITION BY term)) AS x FROM means),
scores AS (SELECT c.vec_id, t.term, sum(c.x * t.x) AS score FROM cells c JOIN centroids t USING (slot) GROUP BY 1, 2)"""

DOT_SCORES = f"WITH {SCORES} SELECT vec_id, term, round(score, 4) AS score FROM scores"


def ranked_scores(spark, sf_dir):
    r = vocabulary.ranked_scores(_queries(spark, sf_dir), "vec_id", _centroids(spark, sf_dir))
    return r.select("vec_id", "position", "term", F.round("score", 4).alias("score"))


RANKED_SCORES = f"""
WITH {SCORES} SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 6) DESC, term) AS position,
  term, round(score, 4) AS score FROM scores
"""

JOIN_THRESHOLD = 0.2
THRESHOLDS = (0.02, 0.05, 0.1, 0.2, 0.55, 0.65, 0.675)


def vocab_join(spark, sf_dir):
    found = vocabulary.keywords_to_vocabulary(
        _queries(spark, sf_dir).withColumnRenamed("vec_id", "unit"), _centroids(spark, sf_dir), JOIN_THRESHOLD
    )
    return found.select(F.col("unit").alias("vec_id"), F.array_join("terms", "|").alias("terms"))


VOCAB_JOIN = f"""
WITH {SCORES} SELECT vec_id, coalesce(string_agg(term, '|' ORDER BY term) FILTER (round(score, 4) > {JOIN_THRESHOLD}), '') AS terms
FROM scores GROUP BY 1
"""


def vocab_join_thresholds(spark, sf_dir):
    s = vocabulary.dot_scores(_queries(spark, sf_dir), _centroids(spark, sf_dir))
    over = F.filter(F.array(*[F.lit(t) for t in THRESHOLDS]), lambda t: F.round("score", 4) > t)
    return s.select("vec_id", "term", F.explode(over).alias("threshold")).groupBy("threshold").agg(
        F.count("*").alias("n_pairs"), F.countDistinct("term").alias("n_terms")
    )


VOCAB_JOIN_THRESHOLDS = f"""
WITH {SCORES} SELECT t.threshold, count(*) AS n_pairs, count(DISTINCT term) AS n_terms
FROM scores JOIN (VALUES {', '.join(f'({t}::DOUBLE)' for t in THRESHOLDS)}) t(threshold) ON round(score, 4) > t.threshold
GROUP BY 1
"""


def classify_type(spark, sf_dir):
    return classify.classify(_doc_vectors(spark, sf_dir)).select("doc_id", "type")


def classify_subtype(spark, sf_dir):
    return classify.classify(_doc_vectors(spark, sf_dir))


def _anchor_values() -> str:
    rows = []
    for level, anchors in (("type", C.TYPE_ANCHORS), ("subtype", C.SUBTYPE_ANCHORS)):
        rows += [f"('{level}', {i}, {S.lit(label)}, {S.lit(t)})" for i, (label, t) in enumerate(anchors)]
    return ", ".join(rows)


def classes_sql(dim: int = V.DIM) -> str:
    return f"""
anchors AS (SELECT level || ':' || pos AS anchor, * FROM (VALUES {_anchor_values()}) v(level, pos, label, text)),
doc_cells AS ({_dense('documents', 'doc_id', 'text', dim)}),
anchor_cells AS ({_dense('anchors', 'anchor', 'text', dim)}),
dots AS (SELECT d.doc_id, a.anchor, sum(d.x * a.x) AS score FROM doc_cells d JOIN anchor_cells a USING (b) GROUP BY 1, 2),
best AS (SELECT k.doc_id, a.level, arg_max(a.label, (round(coalesce(score, 0), 6), -a.pos)) AS label
  FROM documents k CROSS JOIN anchors a LEFT JOIN dots t ON t.doc_id = k.doc_id AND t.anchor = a.anchor GROUP BY 1, 2)"""

CLASSIFY_TYPE = f"WITH {classes_sql()} SELECT doc_id, label AS type FROM best WHERE level = 'type'"


def _subtype_sql(dim: int = V.DIM) -> str:
    return f"""
WITH {classes_sql(dim)} SELECT t.doc_id, t.label AS type,
  CASE WHEN t.label = 'Organization' THEN 'Organization' ELSE s.label END AS subtype
FROM best t JOIN best s ON s.doc_id = t.doc_id AND s.level = 'subtype' WHERE t.level = 'type'
"""


def classify_dim768(spark, sf_dir):
    """The classifier over vectors of another width, its anchors embedded alike."""
    wide = embedding.embed_texts(_doc_texts(spark, sf_dir), 768).withColumnRenamed("unit", "doc_id")
    return classify.classify(wide, classify.anchor_vectors(spark, Models(dim=768)))



def term_pmi(spark, sf_dir):
    """Positive pointwise mutual information of all words of the documents that are frequent enough."""
    texts = _doc_texts(spark, sf_dir)
    words = stage(term_vectors.word_counts(texts), "words")
    cells = term_vectors.positive_pmi(term_vectors.cooccurrences(texts, words)).where("a <= b")
    named = cells.join(words.select(F.col("id").alias("a"), F.col("term").alias("term")), "a")
    named = named.join(words.select(F.col("id").alias("b"), F.col("term").alias("near")), "b")
    named = term_vectors.both_ways(named.select("term", "near", "n", "x"), "term", "near")
    return named.select("term", "near", "n", F.round("x", 6).alias("pmi"))


TERM_PMI = f"""
WITH w AS (SELECT doc_id, list_filter(string_split({S.sanitize_text('text')}, ' '), lambda x: x <> '') AS words FROM documents),
spots AS (SELECT doc_id, unnest(range(0, len(words))) AS place, unnest(words) AS term FROM w),
known AS (SELECT term FROM spots GROUP BY 1 HAVING count(*) >= {term_vectors.LEAST}),
kept AS (SELECT * FROM spots SEMI JOIN known USING (term)),
pairs AS (SELECT a.term, b.term AS near, count(*) AS n FROM kept a JOIN kept b ON a.doc_id = b.doc_id
  AND b.place BETWEEN a.place - {term_vectors.WINDOW} AND a.place + {term_vectors.WINDOW} AND a.place <> b.place GROUP BY 1, 2),
sums AS (SELECT term, sum(n) AS of_term FROM pairs GROUP BY 1),
cells AS (SELECT p.*, ln(n * (SELECT sum(n) FROM pairs)::DOUBLE / (a.of_term::DOUBLE * b.of_term)) AS x
  FROM pairs p JOIN sums a ON a.term = p.term JOIN sums b ON b.term = p.near)
SELECT term, near, n, round(x, 6) AS pmi FROM cells WHERE x > 0
"""


def trained_vectors(spark, sf_dir):
    """Words of the documents that get a vector, and its length; tests compare the vectors themselves."""
    found = term_vectors.train(_doc_texts(spark, sf_dir))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return found.select("term", "n", F.size("vector").cast("bigint").alias("dim"), F.round(length, 6).alias("length"))


TRAINED_VECTORS = f"""
WITH cells AS ({TERM_PMI}),
w AS (SELECT unnest(list_filter(string_split({S.sanitize_text('text')}, ' '), lambda x: x <> '')) AS term FROM documents)
SELECT term, count(*) AS n, {V.DIM}::BIGINT AS dim, 1::DOUBLE AS length FROM w SEMI JOIN cells USING (term) GROUP BY 1
"""


QUERIES = {
    "text_embedding": (text_embedding, TEXT_EMBEDDING),
    "term_embedding": (term_embedding, TERM_EMBEDDING),
    "term_pmi": (term_pmi, TERM_PMI),
    "trained_vectors": (trained_vectors, TRAINED_VECTORS),
    "dot_scores": (dot_scores, DOT_SCORES),
    "ranked_scores": (ranked_scores, RANKED_SCORES),
    "vocab_join": (vocab_join, VOCAB_JOIN),
    "vocab_join_thresholds": (vocab_join_thresholds, VOCAB_JOIN_THRESHOLDS),
    "classify_type": (classify_type, CLASSIFY_TYPE),
    "classify_subtype": (classify_subtype, lambda: _subtype_sql()),
    "classify_dim768": (classify_dim768, lambda: _subtype_sql(768)),
}

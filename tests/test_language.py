import math
import re
import statistics

import numpy as np
from pyspark.sql import functions as F

from sitemill.operators import entities, keywords, summaries, tokens


def _texts(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "unit string, text string")


def test_entities_are_distinct_with_the_last_tag(spark):
    spans = spark.createDataFrame(
        [("u", "Rome", 0, "ORG"), ("u", "Bern", 1, "LOC"), ("u", "Rome", 2, "LOC")],
        "unit string, named_entity string, pos bigint, tag string",
    )
    row = entities.distinct_entities(spans).select(
        "ner_tags", entities.location_tags(F.col("ner_tags")), entities.entity_names(F.col("ner_tags"))
    ).first()
    assert [tuple(e) for e in row[0]] == [("Rome", "LOC"), ("Bern", "LOC")]
    assert row[1] == ["Rome", "Bern"] and row[2] == ["Rome", "Bern"]


def test_entity_tags_from_gazetteer(spark):
    gaz = spark.createDataFrame([("New York", "LOC"), ("Acme", "ORG")], "name string, tag string")
    texts = _texts(spark, "We met Acme in New York. Then Acme and Bob left.", "nothing here")
    got = {r.unit: [tuple(e) for e in r.ner_tags] for r in entities.entity_tags(texts, gaz).collect()}
    assert got == {"0": [("Acme", "ORG"), ("New York", "LOC"), ("Bob", "MISC")], "1": []}


def test_record_name_is_most_frequent_then_earliest(spark):
    texts = _texts(spark, "See Bob Ray and Acme. See Acme or Bob Ray.", "see Zed. see Ann and Ann.")
    assert {r.unit: r.name for r in entities.record_name(texts).collect()} == {"0": "Bob Ray", "1": "Ann"}


def test_descriptions(spark):
    body = "Bread rises. Yeast makes bread rise slowly. Cats sleep. Warm bread tastes fresh. Yeast loves bread. Dogs bark. Rain."
    got = {r.unit: r for r in summaries.descriptions(_texts(spark, body, "", "a. b.")).collect()}
    assert got["0"].short_description == "Bread rises. Yeast loves bread."
    assert got["0"].long_description.split(". ")[0] == "Bread rises"
    assert len(re.findall(r"\.", got["0"].long_description)) == 5
    assert got["1"].short_description == got["1"].long_description == "re-extract me!"
    assert got["2"].short_description == "a. b."


def _weak(t):
    words = set(re.findall(r"'((?:[^'\\]|\\')*)'", tokens._stop_list()))
    return len(t) < 3 or not re.search(r"[^\W\d_]", t) or t in words


def _brute_keywords(text, top=20):
    """The published features written out for one text."""
    sents = [s.strip() for s in re.split(r"[\r\n]+", re.sub(r"([.!?]+)[ \t\r\f]+", r"\1\n", text)) if s.strip()]
    rows = []
    for si, s in enumerate(sents):
        for ci, c in enumerate(x.strip() for x in re.split(r"[^\w \t\f]+", s) if x.strip()):
            w = re.split(r"[ \t\f]+", c)
            rows += [(si, ci, pi, w) for pi in range(len(w))]
    stats = {}
    for si, ci, pi, w in rows:
        t = w[pi].lower()
        if not _weak(t):
            stats.setdefault(t, []).append((si, ci, pi, w))
    tfs = [len(v) for v in stats.values()]
    score = {}
    for t, uses in stats.items():
        tf = len(uses)
        left = [w[p - 1].lower() for _, _, p, w in uses if p > 0]
        right = [w[p + 1].lower() for _, _, p, w in uses if p + 1 < len(w)]
        ratio = sum(len(set(x)) / len(x) for x in (left, right) if x)
        up = sum(w[p].isupper() and len(w[p]) > 1 for _, _, p, w in uses)
        cap = sum(w[p][0].isupper() and not (c == 0 and p == 0) for _, c, p, w in uses)
        case = max(up, cap) / (1 + math.log(tf))
        pos = math.log(math.log(3 + statistics.median(s for s, *_ in uses)))
        freq = tf / (statistics.mean(tfs) + statistics.pstdev(tfs))
        rel = 1 + ratio * tf / max(tfs)
        spread = len({s for s, *_ in uses}) / len(sents)
        score[t] = rel * pos / (case + freq / rel + spread / rel)
    runs = {}
    for si, ci, pi, w in rows:
        for n in (1, 2, 3):
            part = w[pi : pi + n]
            if len(part) == n and not _weak(part[0].lower()) and not _weak(part[-1].lower()):
                runs.setdefault(" ".join(part).lower(), []).append(" ".join(part))
    scored = []
    for phrase, shown in runs.items():
        s = [score[t] for t in phrase.split() if not _weak(t)]
        scored.append((round(math.prod(s) / (len(shown) * (1 + sum(s))), 9), phrase, shown[0]))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    kept = []
    for _, phrase, shown in sorted(scored):
        if len(kept) < top and not any(1 - distance(k, phrase) / max(len(k), len(phrase)) > 0.9 for k, _ in kept):
            kept.append((phrase, shown))
    return sorted({s for _, s in kept})


def test_keywords_match_brute_force(spark):
    text = (
        "Green Hollow Baking offers cornbread recipes. The recipe for Southern cornbread, tender and moist, has corn flavor!\n"
        "NASA bakers test cornbread recipe ideas; bakers of Northern cornbread add sugar. Internationalisations beat "
        "internationalisation. Pans, cups and 42 spoons: the pan is hot. Corn flavor wins? Green Hollow Baking agrees."
    )
    crowd = " ".join(f"internationalisation{c}." for c in "abcdefghijklmnopqrstuvwxyz") + " " + text
    got = {r.unit: r.yake_tags for r in keywords.keywords(_texts(spark, text, crowd, "", "the of")).collect()}
    assert got["0"] == _brute_keywords(text)
    assert got["1"] == _brute_keywords(crowd)
    assert got["2"] == [] and got["3"] == []


def test_words_are_exploded_after_the_only_text_shuffle(spark):
    plan = keywords.keywords(_texts(spark, "a b c"))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert "ENSURE_REQUIREMENTS" not in plan and "SortAggregate" not in plan


def test_the_last_mention_of_an_entity_decides_its_tag(spark):
    gaz = spark.createDataFrame([("Acme", "ORG", None), ("Acme", "LOC", "town"), ("Bob", "PER", "met")], "name string, tag string, cue string")
    texts = _texts(spark, "We saw Acme today. We live in Acme town. Then Bob left.", "The town is Acme too. Then Acme won. We met Bob.")
    got = {r.unit: [tuple(e) for e in r.ner_tags] for r in entities.entity_tags(texts, gaz).collect()}
    assert got == {"0": [("Acme", "LOC"), ("Bob", "MISC")], "1": [("Acme", "ORG"), ("Bob", "PER")]}


def test_no_row_per_word_is_made(spark):
    for made in (keywords.term_statistics, keywords.candidates, keywords.keywords):
        plan = made(_texts(spark, "a b c"))._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan
        assert not any(step in plan for step in ("Generate", "Window", "Aggregate"))


def test_rows_of_a_unit_are_counted_together_across_batches(spark):
    body = "Green Mill bakes corn bread. The Green Mill sells bread rolls; corn rolls too. "
    rows = [("a", body), ("b", body * 3), ("b", body * 3), (None, body), ("c", None), ("d", "")]
    texts = spark.createDataFrame(rows, "unit string, text string").coalesce(1)

    def found():
        terms = sorted(map(tuple, keywords.term_statistics(texts).select("unit", "term", "tf", "in_sentences").collect()), key=str)
        return terms, sorted(map(tuple, keywords.keywords(texts).collect()), key=str)

    whole = found()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert found() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    counts = {(u, t): (n, k) for u, t, n, k in whole[0]}
    assert counts["a", "mill"] == (2, 2) and counts["b", "mill"] == (12, 6) and counts[None, "mill"] == (2, 2)
    tags = [t for u, t in whole[1] if u == "b"]
    assert len(tags) == 2 and tags[0] == tags[1] != []
    assert [t for u, t in whole[1] if u in (None, "c", "d")] == [[], [], []]


def test_scores_are_rounded_as_spark_rounds_them(spark):
    values = [0.0000005, 1.0000015, 0.1234565, 2.5e-7, 0.30000049999, 7.0]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(F.round("x", keywords.SCORE_DIGITS).alias("x")).collect()
    assert keywords.rounded(np.array(values)).tolist() == [r.x for r in rows]


def test_mentions_are_folded_before_their_cues_are_looked_up(spark):
    rows = [("u", "We met Ann Lee now. They saw Ann Lee here. See Ann Lee there."), ("u", "We met Bob. They left. See Ann Lee here."), ("v", "See Bob."), (None, "See Bob.")]
    texts = spark.createDataFrame(rows, "unit string, text string")
    known = [("Ann Lee", "ORG", None), ("Ann Lee", "LOC", "here"), ("Bob", "PER", "never")]
    cued = entities._cued(texts, spark.createDataFrame(known, "name string, tag string, cue string"))
    assert sorted(map(tuple, cued.collect())) == [
        ("u", "Ann Lee", 0, "LOC"), ("u", "Bob", 0, "MISC"), ("v", "Bob", 0, "MISC"),
    ]


def test_best_sentences_count_the_words_of_their_text(spark):
    rows = [("u", "Red oak. Red. ... The. Oak oak mill!"), ("v", "the. of"), ("u", "Mill. Red mill."), ("w", None)]
    texts = spark.createDataFrame(rows, "unit string, text string")
    found = summaries.top_sentences(texts)
    # Two texts of one unit are counted together, sentence by sentence.
    assert sorted((r.unit, r.sentence, r.score, r.place) for r in found.collect()) == [
        ("u", 0, 3.0, 1), ("u", 1, 3.0, 2), ("u", 3, 0.0, 4), ("u", 4, 3.0, 3), ("v", 0, 0.0, 1), ("v", 1, 0.0, 2),
    ]
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()

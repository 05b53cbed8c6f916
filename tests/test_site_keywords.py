import random
import statistics
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sitemill.operators import keywords, site_keywords
from sitemill.operators.ranking import top_k
from sitemill.workspace import staging_root
from tests.test_language import _brute_keywords

WORDS = "corn bread flour mill oven yeast rolls NASA Bern baker Internationalisation internationalisations dough salt".split()


def _parts(spark, rows):
    return spark.createDataFrame(rows, "unit string, part int, text string")


def _text(rng, n):
    return " ".join(f"{' '.join(rng.choice([*WORDS, 'the', 'of', 'and']) for _ in range(rng.randint(2, 7))).capitalize()}{rng.choice('.!?;,')}" for _ in range(n))


def _site(seed, parts, sentences=4):
    rng = random.Random(seed)
    return [_text(rng, sentences) for _ in range(parts)]


def test_keywords_equal_brute_force_over_the_joined_parts(spark):
    sites = {f"s{i}": _site(i, 1 + i * 2) for i in range(5)} | {"empty": [""], "weak": ["the of", "and"]}
    rows = [(u, p, t) for u, texts in sites.items() for p, t in enumerate(texts)]
    got = {r.unit: r.yake_tags for r in site_keywords.keywords(_parts(spark, rows)).collect()}
    assert got == {u: _brute_keywords("\n".join(texts)) if u.startswith("s") else [] for u, texts in sites.items()}


def test_one_host_with_a_third_of_all_pages(spark):
    """The largest site's terms and phrases lie in many tasks, and the rows are those of one text."""
    big = [("big", p, t) for p, t in enumerate(_site(7, 120))]
    rows = big + [(f"h{i}", p, t) for i in range(80) for p, t in enumerate(_site(100 + i, 3))]
    parts = _parts(spark, rows).repartition(8)
    counted = site_keywords.term_parts(parts)
    assert counted.where("unit = 'big'").select(F.spark_partition_id()).distinct().count() == 4  # all shuffle partitions
    got = {r.unit: r.yake_tags for r in site_keywords.keywords(parts).collect()}
    assert got["big"] == _brute_keywords("\n".join(t for _, _, t in big))
    assert len(got) == 81 and got["h3"] == _brute_keywords("\n".join(t for u, _, t in rows if u == "h3"))


def test_statistics_equal_those_of_one_text(spark):
    texts = _site(11, 9)
    fields = ["unit", "term", "tf", "cased", "in_sentences", "middle", F.round("score", 9).alias("score")]
    whole = keywords.term_statistics(spark.createDataFrame([("u", "\n".join(texts))], "unit string, text string"))
    parts = site_keywords.term_statistics(_parts(spark, [("u", p, t) for p, t in enumerate(texts)]))
    assert sorted(map(tuple, parts.select(fields).collect())) == sorted(map(tuple, whole.select(fields).collect()))


def test_the_median_is_found_in_any_part(spark):
    texts = ["mill. " * n for n in (3, 1, 4, 2, 7)]
    row = site_keywords.term_statistics(_parts(spark, [("u", p, t) for p, t in enumerate(texts)])).first()
    assert row.middle == statistics.median(range(17))
    row = site_keywords.term_statistics(_parts(spark, [("u", p, t) for p, t in enumerate(texts[:4] + ["", "rye. mill."])])).where("term = 'mill'").first()
    assert row.middle == statistics.median([*range(10), 11])


@pytest.mark.parametrize("head", [1, 10])
def test_rounds_go_on_until_enough_are_kept(spark, head):
    crowd = " ".join(f"internationalisation{c}." for c in "abcdefghijklmnopqrstuvwxyz") + " Corn bread wins. Salt mill turns."
    rows = [("crowd", 0, crowd), ("crowd", 1, "Fresh rolls and rye."), ("short", 0, "Bread.")]
    got = {r.unit: r.yake_tags for r in site_keywords.keywords(_parts(spark, rows), 7, head).collect()}
    assert got == {"crowd": _brute_keywords(crowd + "\nFresh rolls and rye.", 7), "short": ["Bread"]}


def test_no_exchange_gathers_the_words_of_a_unit(spark):
    parts = _parts(spark, [("u", 0, "corn bread")])
    for table in (site_keywords.term_parts(parts), site_keywords.phrase_parts(parts)):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "struct(unit, unit" in plan and "REPARTITION_BY_NUM" in plan


def test_no_parts_at_all(spark):
    assert site_keywords.keywords(_parts(spark, [])).collect() == []


def test_parts_are_counted_without_a_row_per_word(spark):
    rows = [("u", 1, "Red oak mill. Oak of mill red."), ("u", 2, None), (None, 1, "Red oak."), ("v", 1, "")]
    parts = spark.createDataFrame(rows, "unit string, part int, text string")
    terms, phrases = site_keywords.term_parts(parts), site_keywords.phrase_parts(parts)
    for table in (terms, phrases):
        assert "Generate" not in table._jdf.queryExecution().executedPlan().toString()
    found = {(r.unit, r.part, r.term): (r.tf, r.sentences, sorted(r.before), sorted(r.after)) for r in terms.collect()}
    assert found[("u", 1, "oak")] == (2, [0, 1], ["red"], ["mill", "of"]) and found[(None, 1, "red")] == (1, [0], [], ["oak"])
    assert {(r.phrase, r.size, r.tf) for r in phrases.where("unit = 'u'").collect()} == {
        ("red", 1, 2), ("oak", 1, 2), ("mill", 1, 2), ("red oak", 2, 1), ("oak mill", 2, 1), ("mill red", 2, 1),
        ("red oak mill", 3, 1), ("oak of mill", 3, 1),
    }


def test_phrases_are_scored_in_their_parts(spark):
    texts = ["Red oak mill. Oak of mill red.", "Corn bread for Red oak! Mill of bread.", "The oak mill of corn."]
    found = site_keywords.candidates(_parts(spark, [("u", p, t) for p, t in enumerate(texts)]))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    whole = keywords.candidates(spark.createDataFrame([("u", "\n".join(texts))], "unit string, text string"))
    expected = {r.phrase: (r.tf, r.size, r.score) for r in whole.collect()}
    assert {r.phrase: (r.tf, r.size, r.score) for r in found.collect()} == expected and len(expected) > 10


def _staged(spark):
    return {p.name for p in Path(staging_root(spark).removeprefix("file://"), "sitemill").glob("*")}


def test_tables_that_are_used_up_leave_the_disk(spark):
    before = _staged(spark)
    rows = [(f"s{i}", p, t) for i in range(3) for p, t in enumerate(_site(i, 4))]
    assert site_keywords.keywords(_parts(spark, rows)).count() == 3
    left = {name.rsplit("-", 1)[0] for name in _staged(spark) - before}
    assert not left & {"term-parts", "term-scores", "part-scores"} and "ranked-phrases" in left


def test_no_more_than_the_wanted_rows_of_a_group_leave_a_task(spark):
    rows = spark.range(20000, numPartitions=4).select((F.col("id") % 2).alias("k"), F.xxhash64("id").alias("x"))
    found = top_k(rows, ["k"], ["x"], 5)
    best = {k: sorted(r.x for r in rows.where(F.col("k") == k).collect())[:5] for k in (0, 1)}
    assert {k: [r.x for r in found.where(F.col("k") == k).orderBy("position").collect()] for k in (0, 1)} == best
    assert "SPARK_PARTITION_ID() AS _salt" in found._jdf.queryExecution().analyzed().toString()

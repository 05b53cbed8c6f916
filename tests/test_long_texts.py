import random

import pytest
from pyspark.sql import functions as F

from sitemill.functions import text as X
from sitemill.operators import records
from sitemill.operators.long_texts import LongTexts

WORDS = "the Quick brown Fox of Rome jumps (555) 123 4567 555 a.b@c.org Bread shops St. Paris 12 Main Street Springfield IL 12345 , 7 Oak Ave. TX 78701".split()
ENDS = [". ", "! ", ".\n", "\n", " ", ".\t", ". \r ", "; ", ""]


class Store:
    def __init__(self, known):
        self.known = known

    def texts(self, keys):
        return self.known.join(keys, "url", "left_semi")


def _page(dice):
    body = "".join(" ".join(dice.choices(WORDS, k=dice.randint(1, 12))) + dice.choice(ENDS) for _ in range(dice.randint(0, 14)))
    before = dice.choice(["", "", "Springfield, IL 12345 ", "\t", "4567 "])
    return before + body + dice.choice(["", "", "12 Main St."])


@pytest.fixture(scope="module")
def given(spark):
    dice = random.Random(5)
    sizes = {"a": 40, "b": 40, "c": 2}
    pages = [(f"https://{u}.org/p{i}", _page(dice)) for u, n in sizes.items() for i in range(n)]
    lists = [(u, [f"https://{u}.org/p{i}" for i in range(n)]) for u, n in sizes.items()] + [("none", ["https://x.org/q"])]
    store = Store(spark.createDataFrame(pages, "url string, text string"))
    return spark.createDataFrame(lists, "unit string, links array<string>"), store


def test_parts_have_the_sentences_of_the_whole_text(given):
    whole, parts = records.texts_from_links(*given), records.texts_from_links(*given, 3)
    assert isinstance(parts, LongTexts)
    longest = {r.unit: r.n for r in whole.select("unit", F.length("text").alias("n")).collect()}
    held = parts.rows().groupBy("unit").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("rows")).collect()
    assert all(r.n < longest[r.unit] / 4 for r in held if r.unit in "ab") and {r.unit: r.rows for r in held}["c"] == 1
    expected = {r.unit: r.s for r in whole.select("unit", X.sentences(F.col("text")).alias("s")).collect()}
    found = parts.rows().select("unit", F.struct("part", X.sentences(F.col("text")).alias("s")).alias("p")).collect()
    got = {}
    for r in sorted(found, key=lambda r: r.p.part):
        got.setdefault(r.unit, []).extend(r.p.s)
    assert got == expected
    assert {r.unit: r.text for r in parts.whole().collect()} == {r.unit: r.text for r in whole.collect()}


def test_records_of_parts_are_those_of_the_whole_text(spark, given):
    house = spark.createDataFrame([(w.lower(),) for w in sorted(set(WORDS)) if w.isalpha()], "term string")
    paradigm = spark.createDataFrame([("rome",), ("bread",)], "term string")
    gazetteer = spark.createDataFrame([("Rome", "LOC"), ("Fox", "ORG")], "name string, tag string")
    places = spark.createDataFrame([("12 Main St. Springfield, IL 12345, USA",)], "description string")
    refs = records.References(gazetteer, places)
    made = []
    for texts in (records.texts_from_links(*given), records.texts_from_links(*given, 3)):
        dual = records.dual_records(texts, house, paradigm, "eco", refs)
        made.append(sorted(dual.collect(), key=lambda r: r.mainURL))
    assert made[0] == made[1] and [r.mainURL for r in made[0]] == ["a", "b", "c"]
    assert made[0][0].phoneNumber and made[0][0].yake_tags and made[0][0].ner_tags


def test_lists_that_fit_a_part_stay_a_plain_table(given):
    texts = records.texts_from_links(*given, 40)
    assert not isinstance(texts, LongTexts)
    assert {r.unit: r.text for r in texts.collect()} == {r.unit: r.text for r in records.texts_from_links(*given).collect()}

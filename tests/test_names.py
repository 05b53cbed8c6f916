import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sitemill.operators import names
from sitemill.operators.records import References, records


def _texts(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "unit string, text string")


def _gazetteer(spark, rows):
    return spark.createDataFrame(rows, "name string, tag string")


def _plain(texts, gazetteer):
    known = {}
    for name, tag in gazetteer:
        words = tuple(re.findall(r"[^\W_]+", name or ""))
        if words:
            old = known.get(words, (name, tag))
            known[words] = (min(old[0], name), max(old[1], tag))
    out = []
    for unit, text in enumerate(texts):
        sentences = [s for s in (x.strip() for x in re.split(r"[\r\n]+", re.sub(r"([.!?]+)[ \t\r\f]+", r"\1\n", text or ""))) if s]
        for n, sentence in enumerate(sentences):
            words = re.findall(r"[^\W_]+", sentence)
            hits = [(-size, i, *known[tuple(words[i : i + size])]) for i in range(len(words)) for size in range(1, min(8, len(words) - i) + 1) if tuple(words[i : i + size]) in known]
            taken = set()
            for minus, i, name, tag in sorted(hits):
                own = set(range(i, i - minus))
                if not taken & own:
                    taken |= own
                    out.append((str(unit), n, i, -minus, name, tag))
    return sorted(out)


def _found(spark, texts, gazetteer, **how):
    return sorted(map(tuple, names.name_mentions(_texts(spark, *texts), _gazetteer(spark, gazetteer), **how).collect()))


def test_any_length_and_the_start_of_a_sentence(spark):
    gaz = [("Rome", "LOC"), ("Society for the Protection of Old Stone Mills", "ORG"), ("New York", "LOC"), ("York Mills", "ORG"), ("O'Neil", "PER")]
    texts = ["Rome is old. We love the Society for the Protection of Old Stone Mills in New York Mills.", "O'Neil left; rome and ROME stayed. NewYork"]
    got = {(unit, name) for unit, _, _, _, name, _ in _found(spark, texts, gaz)}
    assert got == {("0", "Rome"), ("0", "Society for the Protection of Old Stone Mills"), ("0", "New York"), ("1", "O'Neil")}


@pytest.mark.parametrize("how", [{}, {"block_names": 5, "tile_chars": 300}])
def test_mentions_equal_brute_force(spark, how):
    rng = random.Random(4)
    letters = "a b c d e A B Ünder 42".split()
    gaz = [(rng.choice([" ", ", ", "-"]).join(rng.choice(letters) for _ in range(rng.randint(1, 7))), rng.choice(["LOC", "ORG"])) for _ in range(60)]
    gaz += [("", "LOC"), ("?!", "LOC"), (None, "ORG"), ("a b", "LOC"), ("a, b", "ORG")]
    texts = [rng.choice([". ", " ", ", "]).join(" ".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 8))) for _ in range(40)]
    texts += ["", None, "...", " ".join(rng.choice(letters) for _ in range(20000))]
    assert _found(spark, texts, gaz, **how) == _plain(texts, gaz)


def test_spans_outside_of_names_are_unknown(spark):
    gaz = _gazetteer(spark, [("Acme Works of Bern", "ORG"), ("Bern", "LOC")])
    got = names.named_entities(_texts(spark, "The Acme Works of Bern met Bob Ray. Bern is near. Then Acme won.", "no names", ""), gaz)
    assert {r.unit: [tuple(e) for e in r.ner_tags] for r in got.collect()} == {
        "0": [("Acme Works of Bern", "ORG"), ("Bob Ray", "MISC"), ("Bern", "LOC")],
        "1": [],
        "2": [],
    }


def test_nothing_to_find(spark):
    assert _found(spark, [], [("a", "b")]) == [] and _found(spark, ["a"], []) == []


def test_records_with_full_names(spark):
    places = spark.createDataFrame([], "description string")
    house = spark.createDataFrame([("bread",)], "term string")
    gaz = _gazetteer(spark, [("Rome", "LOC"), ("Guild of the Bakers of Old Rome", "ORG")])
    texts = _texts(spark, "Rome is old. There is the Guild of the Bakers of Old Rome today.")
    for full, want in ((True, [("Rome", "LOC"), ("Guild of the Bakers of Old Rome", "ORG")]), (False, [("Guild", "MISC"), ("Bakers", "MISC"), ("Old Rome", "MISC")])):
        row = records(texts, [(names.F.lit(True), house)], "eco", References(gaz, places, full_names=full)).first()
        assert [tuple(e) for e in row.ner_tags] == want


def test_names_that_begin_alike_are_found_by_one_automaton():
    words = [["a", "b", "c"], ["a"], ["b", "c", "d", "e"], ["c", "d"], ["x", "a"]]
    found = names.Automaton(pa.array(words)).matches(pa.array("a b c d y a x a b".split()), np.array([4, 3, 2, 1, 2, 1, 3, 2, 1]))
    assert sorted(map(tuple, found.T.tolist())) == [(0, 1, 1), (0, 3, 0), (2, 2, 3), (5, 1, 1), (6, 2, 4), (7, 1, 1)]


def test_words_go_on_only_where_a_name_may_start(spark):
    gaz = _gazetteer(spark, [(f"Guild {i} of Rome", "ORG") for i in range(2000)] + [("Rome", "LOC")])
    texts = _texts(spark, "Guild 7 of Rome is a guild. Guild of 7 is none.", *[f"plain words {i} and no name of any guild" for i in range(500)])
    texts = texts.select(names.F.col("unit").alias("_u"), "text")
    found = names.name_starts(texts, names.name_words(gaz)).collect()
    starts = {(r["_u"], r["sentence"], r["place"], " ".join(r["words"])) for r in found}
    assert {("0", 0, 0, "Guild 7 of Rome"), ("0", 0, 3, "Rome")} <= starts and len(found) < 100


def test_a_full_filter_loses_no_name(spark, monkeypatch):
    monkeypatch.setattr(names, "MOST_BITS", names._CHUNK)
    gaz = [(f"a{i} b{i % 7} c", "LOC") for i in range(30000)] + [("b1 c", "ORG")]
    texts = [f"x a{i} b{i % 7} c. a{i} b{(i + 1) % 7} c" for i in range(0, 30000, 1000)]
    assert len(names.beginnings(names.name_words(_gazetteer(spark, gaz)))) * 8 == names._CHUNK
    assert _found(spark, texts, gaz) == _plain(texts, gaz)


def test_one_unit_of_several_texts(spark):
    texts = spark.createDataFrame([("1", "Rome"), ("1", "Rome"), (None, "in Rome")], "unit string, text string")
    found = names.name_mentions(texts, _gazetteer(spark, [("Rome", "LOC"), ("in Rome", "ORG")]))
    assert sorted(((r.unit, r.place, r.named_entity) for r in found.collect()), key=str) == [("1", 0, "Rome"), ("1", 0, "Rome"), (None, 0, "in Rome")]

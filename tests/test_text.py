import pytest
from pyspark.sql import functions as F

from sitemill.functions import text as X
from sitemill.operators import facts, records


def _one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize("size,want", [(20, None), (21, 21), (9999, 9999), (10000, 9999), (12000, 9999)])
def test_length_gate(spark, size, want):
    got = _one(spark, "x" * size, X.gated)
    assert (None if got is None else len(got)) == want


@pytest.mark.parametrize("size,want", [(10, False), (11, True)])
def test_min_context(spark, size, want):
    assert _one(spark, "x" * size, X.has_context) is want


@pytest.mark.parametrize("size,want", [(17000, 17000), (17001, 16900)])
def test_summary_cap(spark, size, want):
    assert len(_one(spark, "x" * size, X.summary_input)) == want


@pytest.mark.parametrize(
    "text,want",
    [("a.b@c.org.", ["a.b@c.org."]), ("x@y.co.uk,", ["x@y.co.uk"]), ("a@b", []), ("a@b.c a@b.c", ["a@b.c"]), ("none", [])],
)
def test_emails(spark, text, want):
    assert _one(spark, text, X.emails) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("555-123-4567", ["555-123-4567"]),
        ("(212) 555-7890", ["(212) 555-7890"]),
        ("5551234", ["5551234"]),
        ("5551234567890", ["5551234567"]),
        ("12 34", []),
    ],
)
def test_phones(spark, text, want):
    assert _one(spark, text, X.phones) == want


def test_addresses(spark):
    text = "Visit 12 Mill Oak Street, Old Town, IL 62701-1234 or 7 Elm Ave. Suite 5 Chicago IL 60601. Not 5 apples."
    want = ["12 Mill Oak Street, Old Town, IL 62701-1234", "7 Elm Ave. Suite 5 Chicago IL 60601"]
    assert _one(spark, text, X.addresses) == want


def test_clean_and_sanitize(spark):
    assert _one(spark, " a  b \n\t c ", X.clean_text) == "a b c"
    assert _one(spark, "It's  Élan--42!", X.sanitize_text) == "it s élan 42"


def test_sentences_and_chunks(spark):
    assert _one(spark, "One v1.2 two. Three!  Four\nfive?", X.sentences) == ["One v1.2 two.", "Three!", "Four", "five?"]
    assert _one(spark, "a b1, c (d2) e", X.chunks) == ["a b1", "c", "d2", "e"]


def test_proper_spans(spark):
    got = _one(spark, "The Old Mill in New York,Paris and One Two Three Four Five", X.proper_spans)
    assert got == ["Old Mill", "New York", "Paris", "One Two Three Four", "Five"]


def test_address_completion(spark):
    found = spark.createDataFrame(
        [("u1", ["1 A St, B, IL 11111"]), ("u2", ["1 A St, B, IL 11111", "2 C St, D, IL 22222"]), ("u3", [])],
        "unit string, address array<string>",
    )
    places = spark.createDataFrame(
        [("1 a st, b, il 11111-%04d, USA" % i,) for i in range(7)] + [("2 C St, D, IL 22222, USA",), ("12 C St, D, IL 22222",)],
        "description string",
    )
    got = {r.unit: r.address for r in facts.complete_addresses(found, places).collect()}
    seven = ["1 a st, b, il 11111-%04d, USA" % i for i in range(7)]
    assert got == {"u1": seven, "u2": [*seven, "2 C St, D, IL 22222, USA"], "u3": []}


def test_contact_report_counts(spark):
    texts = spark.createDataFrame([("o", "a@b.org 555-123-4567"), ("o", "a@b.org "), ("p", None)], "origin string, text string")
    got = {tuple(r) for r in facts.contact_report(texts, "origin").collect()}
    assert got == {("o", "email", "a@b.org", 2), ("o", "phone", "555-123-4567", 1)}


def test_failures(spark):
    df = spark.createDataFrame([(None,), ("short",), ("long enough text",)], "t string")
    got = [r[0] for r in df.select(records.text_failure(F.col("t"))).collect()]
    assert got == ["no_text", "short_text", None]
    df = spark.createDataFrame([("e", "p"), (None, "p"), ("e", None)], "e string, p string")
    got = [r[0] for r in df.select(records.parameter_failure(F.col("e"), F.col("p"))).collect()]
    assert got == [None, "insufficient kwargs", "insufficient kwargs"]

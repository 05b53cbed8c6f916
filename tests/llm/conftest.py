import re

import pytest

from sitemill.workspace import ensure_local_root

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

LINES = "\n".join(f"line {i} of a passage that is long enough" for i in range(6))
ODD_TEXTS = [
    (1, "a b c d e f g h i j k l m n"),
    (1, "a b c d e f g h i j k l m n"),
    (2, None),
    (3, ""),
    (None, "x y z"),
    (4, " .,!"),
    (5, "word other " * 30000),
    (6, "A b c d, e f g h i j k l m n!"),
    (7, "é ñ 中文 <|endoftext|> it's"),
    (None, None),
    (8, LINES),
    (9, "before\n" + LINES + "\nafter"),
    (10, "a b c d e f g h i j k l m n o"),
    (None, "a b c d e f g h i j k l m n"),
    (11, "same line\n" * 8),
]
#: Columns that operators use as names of their own.
EXTRA = "row string, score double, toxicity string, quality string, hits int, rk string, tk int, node long, shard string, slot int, component long, _nth int, alone string, removed string, length int"


@pytest.fixture(autouse=True)
def _workers(spark):
    ensure_local_root(spark)


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def frame(spark, rows):
    """Documents with further columns, all null in every second row."""
    names = [c.split()[0] for c in EXTRA.split(", ")]
    full = [
        (i, t, "en", "src0", len(t or ""), *[k if "int" in c or "long" in c else 0.5 if "double" in c else "v" for c in EXTRA.split(", ")])
        if k % 2
        else (i, t, None, None, None, *[None] * len(names))
        for k, (i, t) in enumerate(rows)
    ]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD_TEXTS)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])

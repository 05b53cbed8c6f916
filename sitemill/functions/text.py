"""Text cleaning, gates, pattern facts and text segmentation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sitemill import constants as C
from sitemill.functions.markup import BLANKS

NBSP = "\u00a0"
# Runs that separate words and are not already one blank.
NOT_WORD = r"[^\p{L}\p{N}]{2,}|[^\p{L}\p{N} ]"
SENTENCE_END = r"([.!?]+)[ \t\r\f]+"
LINE_ENDS = r"[\r\n]+"
CHUNK_BREAK = r"[^\p{L}\p{N} \t\f]+"
SPACES = r"[ \t\f]+"
FIRST_WORD = r"^[^ ]+ ?"
PROPER_SPAN = r"(?:^|[^\p{L}\p{N}])(\p{Lu}[\p{L}\p{N}]*(?: \p{Lu}[\p{L}\p{N}]*){0,3})"
US_ADDRESS = (
    r"(\d{1,6} (?:[A-Z][A-Za-z]* ){1,4}"
    r"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl)\.?"
    r"(?: (?:Suite|Ste|Apt|Unit)\.? [A-Za-z0-9]+)?,? [A-Z][A-Za-z]*(?: [A-Z][A-Za-z]*){0,2},? [A-Z]{2} \d{5}(?:-\d{4})?)"
)


def clean_text(text: Column) -> Column:
    """Non-breaking space to blank, blanks collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit(NBSP), F.lit(" ")), BLANKS, " "))


def sanitize_text(text: Column) -> Column:
    """Lower-case words separated by single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " "))


def gated(cleaned: Column) -> Column:
    """Cleaned site text cut to the record length; null when it is too short to use."""
    size = F.length(cleaned)
    return (
        F.when(size <= C.SITE_TEXT_MIN, F.lit(None).cast(StringType()))
        .when(size >= C.SITE_TEXT_LONG, F.substring(cleaned, 1, C.SITE_TEXT_CUT))
        .otherwise(cleaned)
    )


def has_context(text: Column) -> Column:
    return F.coalesce(F.length(text) > C.RECORD_TEXT_MIN, F.lit(False))


def summary_input(text: Column) -> Column:
    return F.when(F.length(text) > C.SUMMARY_LONG, F.substring(text, 1, C.SUMMARY_CUT)).otherwise(text)


def _distinct_matches(text: Column, pattern: str, group: int, possible: Column) -> Column:
    """Sorted distinct matches; a cheap necessary test spares most texts the pattern."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), group)))
    return F.when(possible, found).otherwise(F.array().cast("array<string>"))


def emails(text: Column) -> Column:
    return _distinct_matches(text, C.EMAIL, 0, text.contains("@"))


def phones(text: Column) -> Column:
    return _distinct_matches(text, C.PHONE, 0, text.rlike(r"\d{3}"))


def addresses(text: Column) -> Column:
    return _distinct_matches(text, US_ADDRESS, 1, text.rlike(r" [A-Z]{2} \d{5}"))


def sentences(text: Column) -> Column:
    """Sentences in order, each with its closing punctuation."""
    marked = F.regexp_replace(text, SENTENCE_END, "$1\n")
    parts = F.transform(F.split(marked, LINE_ENDS), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def chunks(sentence: Column) -> Column:
    """Stretches of words not broken by punctuation."""
    parts = F.transform(F.split(sentence, CHUNK_BREAK), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def chunk_words(chunk: Column) -> Column:
    return F.split(chunk, SPACES)


def proper_spans(sentence: Column) -> Column:
    """Runs of one to four capitalised words, the sentence's first word left out."""
    rest = F.regexp_replace(sentence, FIRST_WORD, "")
    return F.regexp_extract_all(rest, F.lit(PROPER_SPAN), 1)

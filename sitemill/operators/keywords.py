"""Keyword extraction from term statistics of one text, after the published YAKE features.

Features per term: casing, position, frequency, relatedness to its neighbours, and spread over
sentences.  A keyword is a run of one to three words that neither starts nor ends with a weak word;
low scores are good.  See Campos et al., Information Sciences 509 (2020).
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemill.functions import text as X
from sitemill.operators.word_counts import Terms, Words, grouped, over_units, term_counts

TOP = 20
BITS = 21  # of a place in its chunk and of a chunk in its sentence
PLACES = 1 << BITS
SIMILAR = 0.9
SCORE_DIGITS = 6  # phrases whose scores agree to so many digits are ordered as text


def neighbour_share(distinct: Column, present: Column) -> Column:
    """Distinct neighbours on one side, as a share of all on that side."""
    return F.when(present > 0, distinct / present).otherwise(F.lit(0.0))


def _score(c: dict, log: Callable):
    """The published score of a term, from its counts and those of its unit, as columns or as arrays."""
    case = c["cased"] / (1 + log(c["tf"]))
    position = log(log(3 + c["middle"]))
    frequency = c["tf"] / (c["mean_tf"] + c["std_tf"])
    related = 1 + (c["left"] + c["right"]) * c["tf"] / c["max_tf"]
    spread = c["in_sentences"] / c["n_sentences"]
    return related * position / (case + frequency / related + spread / related)


def term_score() -> Column:
    names = "tf cased middle mean_tf std_tf left right max_tf in_sentences n_sentences".split()
    return _score({c: F.col(c) for c in names} | {"tf": F.col("tf").cast("double")}, F.log)


def _scored(words: Words) -> Terms:
    """The terms of a slice with ``cased`` and ``score``."""
    terms = term_counts(words)
    c = terms.columns
    c["cased"] = np.maximum(c["shouted"], c["capital"])
    if not len(terms.unit):
        c["score"] = np.zeros(0)
        return terms
    _, first = grouped(terms.unit)
    n = np.diff(np.append(first, len(terms.unit)))
    tf = c["tf"].astype(float)
    mean, squares = np.add.reduceat(tf, first) / n, np.add.reduceat(tf * tf, first) / n
    spread = np.sqrt(np.maximum(squares - mean * mean, 0))
    of_unit = {"max_tf": np.maximum.reduceat(tf, first), "mean_tf": mean, "std_tf": spread}
    shares = {}
    for name, side, present in (("left", "before", c["n_left"]), ("right", "after", c["n_right"])):
        distinct = np.bincount(terms.near(side)[0], minlength=len(tf))
        shares[name] = np.where(present > 0, distinct / np.maximum(present, 1), 0.0)
    c["score"] = _score(c | {"tf": tf} | shares | {k: np.repeat(v, n) for k, v in of_unit.items()}, np.log)
    return terms


def unit_rows(units: pa.Array, words: Words, rows: np.ndarray) -> pa.Array:
    """The units of this number."""
    return units.take(pa.array(np.searchsorted(words.number, rows)))


def term_statistics(texts: DataFrame) -> DataFrame:
    """One row per text and term: counts, sentences and score."""

    def count(units: pa.Array, words: Words) -> list:
        terms = _scored(words)
        c = terms.columns
        found = [c["tf"], c["cased"], pa.array(c["in_sentences"].astype(np.int32)), c["middle"], c["score"]]
        return [unit_rows(units, words, terms.unit), words.terms.take(pa.array(terms.term)), *map(pa.array, found)]

    return over_units(texts, count, "term string, tf long, cased long, in_sentences int, middle double, score double")


def rounded(scores: np.ndarray) -> np.ndarray:
    """Scores to ``SCORE_DIGITS`` digits as Spark rounds them: halves of the shortest decimal form go up."""
    whole = np.floor(scores * 10.0**SCORE_DIGITS + 0.5) / 10.0**SCORE_DIGITS
    digit = Decimal(1).scaleb(-SCORE_DIGITS)
    for i in np.flatnonzero(np.abs(scores * 10.0**SCORE_DIGITS % 1 - 0.5) < 1e-6):
        whole[i] = float(Decimal(repr(float(scores[i]))).quantize(digit, ROUND_HALF_UP))
    return whole


def phrase_counts(words: Words, score_of: Callable[[Terms], np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Arrays over all runs of one to three words of each unit: ``unit, tf, at, size, score, ids, prod, total``.

    The scores of the words are those of their unit, or given; ``prod`` and ``total`` are their product and sum.

    Scores of the next one or two words come from the following topic words of the same chunk; a weak word in
    the middle of three adds nothing.
    """
    terms = _scored(words) if score_of is None else term_counts(words)
    score = terms.columns["score"] if score_of is None else score_of(terms)
    at = (words.sentence * PLACES + words.chunk) * PLACES + words.place
    chunk, n = at >> BITS, len(at)
    s0 = score[terms.of]

    def later(values: np.ndarray, by: int) -> np.ndarray:
        return np.append(values[by:], np.full(min(by, n), -1, values.dtype))

    same = [(later(words.unit, k) == words.unit) & (later(chunk, k) == chunk) for k in (1, 2)]
    scores, there = [], []
    for step in (1, 2):
        hits = [m & (later(words.place, k) == words.place + step) for k, m in zip((1, 2), same, strict=True)]
        scores.append(np.where(hits[0], later(s0, 1), later(s0, 2)))
        there.append(hits[0] | hits[1])
    pairs = there[0] & (words.after >= 0)
    threes = there[1] & (words.second >= 0)
    middle = [np.where(there[0], scores[0], x) for x in (1.0, 0.0)]
    two = np.zeros(n, np.int64)
    near = pairs | threes
    two[near] = np.unique((terms.of * words.n_terms + words.after)[near], return_inverse=True)[1]
    runs = [
        (1, np.ones(n, bool), terms.of, s0, s0),
        (2, pairs, two, s0 * scores[0], s0 + scores[0]),
        (3, threes, two * words.n_terms + words.second, s0 * middle[0] * scores[1], s0 + middle[1] + scores[1]),
    ]
    parts = []
    for size, mask, keys, prod, total in runs:
        spots = np.flatnonzero(mask)
        if not len(spots):
            continue
        order, first = grouped(keys[spots])
        spots = spots[order]
        tf = np.diff(np.append(first, len(spots)))
        best, sums = np.maximum.reduceat(prod[spots], first), np.maximum.reduceat(total[spots], first)
        spot = spots[first]
        ids = np.stack([words.term[spot], words.after[spot] if size > 1 else spot * 0 - 1, words.second[spot] if size > 2 else spot * 0 - 1])
        parts.append((words.unit[spot], tf, at[spot], np.full(len(spot), size, np.int32), rounded(best / (tf * (1 + sums))), ids, best, sums))
    if not parts:
        empty = np.zeros(0, np.int64)
        parts = [(empty, empty, empty, empty.astype(np.int32), empty.astype(float), np.zeros((3, 0), np.int64), empty.astype(float), empty.astype(float))]
    names = "unit", "tf", "at", "size", "score", "ids", "prod", "total"
    return {name: np.concatenate(x, axis=-1) for name, x in zip(names, zip(*parts, strict=True), strict=True)}


def joined(words: Words, ids: np.ndarray) -> pa.Array:
    """Phrases of words by number; -1 is no word."""
    each = [words.terms.take(pa.array(x, mask=x < 0)) for x in ids]
    return pc.binary_join_element_wise(*each, " ", null_handling="skip")


def candidates(texts: DataFrame) -> DataFrame:
    """``(unit, phrase, tf, score, at, size)``: all runs of one to three words with their score.

    ``at`` is the first place of the phrase and ``size`` its number of words.
    """

    def count(units: pa.Array, words: Words) -> list:
        p = phrase_counts(words)
        return [unit_rows(units, words, p["unit"]), joined(words, p["ids"]), *(pa.array(p[c]) for c in ("tf", "score", "at", "size"))]

    return over_units(texts, count, "phrase string, tf long, score double, at long, size int")


def _similar(a: Column, b: Column) -> Column:
    """Whether two phrases nearly agree.

    They differ by one letter at least, and by no fewer than their lengths do, so the cheap tests in front
    rule out most pairs before any edit distance is computed.
    """
    longest = F.greatest(F.length(a["phrase"]), F.length(b["phrase"]))
    most = F.lit(1 - SIMILAR) * longest + 1e-9
    near = (most >= 1) & (F.abs(F.length(a["phrase"]) - F.length(b["phrase"])) <= most)
    return near & (1 - F.levenshtein(a["phrase"], b["phrase"]) / longest > SIMILAR)


def walk(ranked: Column, kept: Column, top: int) -> Column:
    """``kept`` and the phrases of ``ranked`` that are near none kept before, ``top`` at most."""
    return F.aggregate(
        ranked,
        kept,
        lambda acc, x: F.when(
            (F.size(acc) < top) & ~F.exists(acc, lambda k: _similar(k, x)), F.concat(acc, F.array(x))
        ).otherwise(acc),
    )


def as_written(k: Column, sentence: Column) -> Column:
    """A kept phrase as it stands at its first place; ``body`` has the sentences."""
    chunk = F.shiftright(k["at"], BITS).bitwiseAND(PLACES - 1).cast("int")
    first = k["at"].bitwiseAND(PLACES - 1).cast("int") + 1
    words = X.chunk_words(F.get(X.chunks(F.get("body", sentence)), chunk))
    return F.array_join(F.slice(words, first, k["size"]), " ")


def _distance(a: str, b: str) -> int:
    """Edit distance of two phrases."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _alike(a: str, b: str) -> bool:
    """``_similar`` of two strings; of phrases few edits apart, one shares a piece of the other."""
    longest = max(len(a), len(b))
    most = (1 - SIMILAR) * longest + 1e-9
    if most < 1 or abs(len(a) - len(b)) > most:
        return False
    pieces = int(most) + 1
    cuts = [len(b) * i // pieces for i in range(pieces + 1)]
    if not any(b[cuts[i] : cuts[i + 1]] in a for i in range(pieces)):
        return False
    return 1 - _distance(a, b) / longest > SIMILAR


def _near(sized: dict[int, list[str]], phrase: str) -> bool:
    """Whether any of the phrases, given by length, is alike: such phrases differ little in length."""
    n, most = len(phrase), int((1 / SIMILAR - 1) * len(phrase)) + 1
    return any(_alike(k, phrase) for size in range(n - most, n + most + 1) for k in sized.get(size, ()))


def _kept(words: Words, phrases: dict[str, np.ndarray], ranked: np.ndarray, top: int) -> list[tuple[int, int]]:
    """Place and size of the phrases of one unit, by score and as text, that are near none kept before."""
    score, kept, sized, begin = phrases["score"][ranked], [], {}, 0
    while begin < len(ranked) and len(kept) < top:
        end = min(len(ranked), begin + 2 * top)
        end = int(np.searchsorted(score, score[end - 1], side="right"))
        part = ranked[begin:end]
        rows = zip(score[begin:end].tolist(), joined(words, phrases["ids"][:, part]).to_pylist(), phrases["at"][part].tolist(), phrases["size"][part].tolist(), strict=True)
        for _, phrase, at, size in sorted(rows):
            if len(kept) < top and not _near(sized, phrase):
                kept.append((at, size))
                sized.setdefault(len(phrase), []).append(phrase)
        begin = end
    return kept


def keywords(texts: DataFrame, top: int = TOP) -> DataFrame:
    """``(unit, yake_tags)``: the best phrases, near copies of better ones left out, sorted as text.

    A unit is one text, so its phrases are no larger than the row it came from; units of many parts are the
    matter of ``site_keywords``.  They are walked in score order until ``top`` are kept, which is exact however
    many near copies come first.  Kept phrases are shown as written at their first place.
    """

    def count(units: pa.Array, words: Words) -> list:
        phrases = phrase_counts(words)
        order = np.lexsort((phrases["score"], phrases["unit"]))
        ends = np.searchsorted(phrases["unit"][order], np.arange(words.n_units + 1))
        found = [_kept(words, phrases, order[ends[u] : ends[u + 1]], top) for u in range(words.n_units)]
        tags = []
        for row, unit in enumerate(words.number.tolist()):
            places = [(at >> 2 * BITS, (at >> BITS) & (PLACES - 1), at & (PLACES - 1), size) for at, size in found[unit]]
            shown = {words.as_written(row, *p) for p in places} if units[row].is_valid else set()
            tags.append(sorted(shown - {None}) + [None] * (None in shown))
        return [units, pa.array(tags, pa.list_(pa.string()))]

    return over_units(texts, count, "yake_tags array<string>")

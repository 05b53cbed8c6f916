"""Keywords of units that come in many parts, such as the pages of a whole site.

The features are those of ``keywords``, but no step holds a unit's words or phrases.  Each part is brought to
its partition as one row and counted there over Arrow batches, without a row per word; what goes on is one row per part and term, or per part and phrase.
These partial rows are added by (unit, term) and (unit, phrase), so a site with a third of all pages spreads
over all tasks.  The median sentence of a term is found from the counts of its parts in order: only the part
that holds the middle mention is looked into.  The best phrases are taken in rounds: a bounded number of each
unit's next phrases is walked, and a further round runs only for units that are still short.

Sentences end with their part.  Parts without text add nothing; a unit without any phrase has an empty list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitemill.functions import text as X
from sitemill.operators.keywords import (
    BITS,
    SCORE_DIGITS,
    TOP,
    as_written,
    joined,
    neighbour_share,
    phrase_counts,
    term_score,
    unit_rows,
    walk,
)
from sitemill.operators.ranking import top_k
from sitemill.operators.word_counts import Terms, Words, list_sizes, over_units, owner, term_counts
from sitemill.workspace import stage, unstage

#: Phrases of a unit that one round walks, as a multiple of those wanted.
HEAD = 10


def _rows(parts: DataFrame) -> DataFrame:
    """Each part as a unit of its own: ``unit`` is (unit, part)."""
    return parts.select(F.struct("unit", "part").alias("unit"), "text")


def sentence_counts(parts: DataFrame) -> DataFrame:
    """``unit, part, n_before, n_sentences``: sentences of the unit in earlier parts, and in all of them."""
    sizes = parts.select("unit", "part", F.size(X.sentences(F.col("text"))).cast("bigint").alias("n"))
    whole = Window.partitionBy("unit")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before, total = F.coalesce(F.sum("n").over(earlier), F.lit(0)), F.sum("n").over(whole)
    return sizes.select("unit", "part", before.alias("n_before"), total.alias("n_sentences"))


def term_parts(parts: DataFrame) -> DataFrame:
    """One row per part and topic word: its counts, sentences and neighbours in that part."""

    def count(units: pa.Array, words: Words) -> list:
        terms = term_counts(words)
        c = terms.columns

        def near(side: str) -> pa.Array:
            row, word = terms.near(side)
            ends = np.searchsorted(row, np.arange(len(terms.unit) + 1)).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), words.terms.take(pa.array(word)))

        places = pa.array(np.append(terms.first, len(terms.sentences)).astype(np.int32))
        sentences = pa.ListArray.from_arrays(places, pa.array(terms.sentences.astype(np.int32)))
        counts = [pa.array(c[name]) for name in ("tf", "shouted", "capital")]
        sides = [near("before"), pa.array(c["n_left"]), near("after"), pa.array(c["n_right"])]
        return [unit_rows(units, words, terms.unit), words.terms.take(pa.array(terms.term)), *counts, sentences, *sides]

    fields = "term string, tf long, shouted long, capital long, sentences array<int>, before array<string>, n_left long, after array<string>, n_right long"
    counted = over_units(_rows(parts), count, fields)
    return counted.select("unit.unit", "unit.part", *counted.columns[1:])


def _middle(counted: DataFrame, sentences: DataFrame) -> DataFrame:
    """``unit, term, middle``: the median sentence of all mentions."""
    along = Window.partitionBy("unit", "term").orderBy("part")
    before = F.coalesce(F.sum("tf").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("tf").over(Window.partitionBy("unit", "term"))
    slim = counted.select("unit", "term", "part", "tf").withColumn("before", before).withColumn("total", total)
    ranks = F.array(F.expr("(total + 1) div 2"), F.expr("total div 2 + 1"))
    held = F.filter(ranks, lambda r: (r > F.col("before")) & (r <= F.col("before") + F.col("tf")))
    asked = slim.withColumn("held", held).where(F.size("held") > 0).select("unit", "term", "part", "before", "held")
    found = asked.join(counted.select("unit", "term", "part", "sentences"), ["unit", "term", "part"])
    found = found.join(sentences.select("unit", "part", "n_before"), ["unit", "part"])
    spot = F.transform("held", lambda r: F.get("sentences", (r - F.col("before") - 1).cast("int")) + F.col("n_before"))
    each = found.select("unit", "term", F.explode(spot).alias("sentence"))
    return each.groupBy("unit", "term").agg((F.sum("sentence") / F.count("*")).alias("middle"))


def term_statistics(parts: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """``unit, term, tf, cased, in_sentences, middle, score`` over all parts of each unit, which ``counted`` may have.

    What is shuffled for the neighbours and for the medians is off the disk before the next of them begins.
    """
    counted = stage(term_parts(parts), "term-parts") if counted is None else counted
    sentences = stage(sentence_counts(parts), "sentence-counts")
    sums = counted.groupBy("unit", "term").agg(
        F.sum("tf").alias("tf"),
        F.greatest(F.sum("shouted"), F.sum("capital")).alias("cased"),
        F.sum(F.size(F.array_distinct("sentences"))).alias("in_sentences"),
        F.sum("n_left").alias("n_left"),
        F.sum("n_right").alias("n_right"),
    )

    def side(name: str, column: str) -> Column:
        return F.transform(column, lambda w: F.struct(F.lit(name).alias("side"), w.alias("word")))

    near = counted.select("unit", "term", F.explode(F.concat(side("l", "before"), side("r", "after"))).alias("n"))
    near = near.select("unit", "term", "n.side", "n.word").distinct()
    near = near.groupBy("unit", "term").agg(F.count_if(F.col("side") == "l").alias("lefts"), F.count_if(F.col("side") == "r").alias("rights"))
    near, middle = stage(near, "term-neighbours"), stage(_middle(counted, sentences), "term-middles")
    sums = stage(sums, "term-sums")
    per_unit = sums.groupBy("unit").agg(
        F.max("tf").alias("max_tf"), F.avg("tf").alias("mean_tf"), F.avg(F.col("tf") * F.col("tf")).alias("squares")
    )
    per_unit = per_unit.join(sentences.groupBy("unit").agg(F.max("n_sentences").alias("n_sentences")), "unit")
    joined = sums.join(middle, ["unit", "term"]).join(near, ["unit", "term"], "left").join(per_unit, "unit")
    joined = joined.withColumns(
        {
            "left": neighbour_share(F.coalesce("lefts", F.lit(0)), F.col("n_left")),
            "right": neighbour_share(F.coalesce("rights", F.lit(0)), F.col("n_right")),
            "std_tf": F.sqrt(F.greatest(F.col("squares") - F.col("mean_tf") * F.col("mean_tf"), F.lit(0.0))),
        }
    )
    return joined.select("unit", "term", "tf", "cased", "in_sentences", "middle", term_score().alias("score"))


def phrase_parts(parts: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """One row per part and run of one to three words: its count and first place in that part, and its words' scores.

    ``scores`` is ``(unit, part, scores)``, the score in the whole unit of each topic word of a part, so that phrases
    need not be cut into words again to look these up; without it the scores are those in the part.
    """

    def count(units: pa.Array, words: Words, known: pa.Array | None = None) -> list:
        def score_of(terms: Terms) -> np.ndarray:
            row, _ = owner(list_sizes(known, 1))
            entries = known.flatten()
            term = pc.index_in(entries.field("term"), value_set=words.terms).to_numpy(zero_copy_only=False)
            keys = words.number[row] * words.n_terms + term
            keys, first = np.unique(keys, return_index=True)
            values = entries.field("score").to_numpy(zero_copy_only=False)[first]
            return values[np.searchsorted(keys, terms.unit * words.n_terms + terms.term)]

        p = phrase_counts(words, None if known is None else score_of)
        found = [joined(words, p["ids"]), *(pa.array(p[c]) for c in ("size", "tf", "at", "prod", "total"))]
        return [unit_rows(units, words, p["unit"]), *found]

    fields = "phrase string, size int, tf long, at long, prod double, total double"
    if scores is None:
        counted = over_units(_rows(parts), count, fields)
    else:
        known = parts.select("unit", "part", "text").join(scores, ["unit", "part"])
        counted = over_units(known.select(F.struct("unit", "part").alias("unit"), "text", "scores"), count, fields, "scores")
    return counted.select("unit.unit", "unit.part", *counted.columns[1:])


def candidates(parts: DataFrame) -> DataFrame:
    """``unit, phrase, tf, score, part, at, size``: all phrases of each unit, and where the first one is."""
    return _candidates(parts)[0]


def _candidates(parts: DataFrame) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """The candidates, and the staged tables that they are made from."""
    counted = stage(term_parts(parts), "term-parts")
    scores = stage(term_statistics(parts, counted).select("unit", "term", "score"), "term-scores")
    of_part = counted.select("unit", "part", "term").join(scores, ["unit", "term"])
    of_part = stage(of_part.groupBy("unit", "part").agg(F.collect_list(F.struct("term", "score")).alias("scores")), "part-scores")
    unstage(counted, scores)
    merged = phrase_parts(parts, of_part).groupBy("unit", "phrase", "size").agg(
        F.sum("tf").alias("tf"),
        F.min("part").alias("part"),
        F.min_by("at", "part").alias("at"),
        F.max("prod").alias("prod"),
        F.max("total").alias("total"),
    )
    score = F.round(F.col("prod") / (F.col("tf") * (1 + F.col("total"))), SCORE_DIGITS)
    return merged.select("unit", "phrase", "tf", score.alias("score"), "part", "at", "size"), (of_part,)


def best_phrases(phrases: DataFrame, top: int = TOP, head: int = HEAD, used: tuple[DataFrame, ...] = ()) -> DataFrame:
    """``unit, kept``: the first ``top`` phrases of each unit in score order, near copies of better ones left out.

    ``used`` are staged tables that only the phrases are made from; they go.
    """
    entry = F.struct("score", "phrase", "part", "at", "size")
    step, state, done = head * top, None, None
    phrases = stage(phrases, "ranked-phrases")
    unstage(*used)
    while True:
        rest = phrases
        if state is not None:
            rest = phrases.join(state.select("unit", "last"), "unit").where(F.struct("score", "phrase") > F.col("last")).drop("last")
        first = top_k(rest, ["unit"], ["score", "phrase"], step)
        listed = first.groupBy("unit").agg(F.array_sort(F.collect_list(entry)).alias("ranked"))
        none = F.slice("ranked", 1, 0)
        if state is not None:
            listed = state.select("unit", F.col("kept").alias("held")).join(listed, "unit", "left")
            listed = listed.withColumn("ranked", F.coalesce("ranked", F.slice("held", 1, 0)))
            none = F.col("held")
        last = F.element_at("ranked", F.size("ranked"))
        more = (F.size("ranked") == step) & (F.size("kept") < top)
        after = F.when(F.size("ranked") > 0, F.struct(last["score"].alias("score"), last["phrase"].alias("phrase")))
        walked = listed.withColumn("kept", walk(F.col("ranked"), none, top)).withColumn("more", more)
        walked = stage(walked.select("unit", "kept", "more", F.when(F.size("ranked") == step, after).alias("last")), "kept-phrases")
        ended = walked.where(~F.col("more")).select("unit", "kept")
        done = ended if done is None else done.unionByName(ended)
        state = walked.where("more")
        if state.isEmpty():
            return done


def keywords(parts: DataFrame, top: int = TOP, head: int = HEAD) -> DataFrame:
    """``(unit, yake_tags)`` of ``(unit, part, text)``, as sorted text, each shown as written at its first place."""
    phrases, used = _candidates(parts)
    kept = best_phrases(phrases, top, head, used).select("unit", F.explode("kept").alias("k"))
    bodies = parts.select("unit", "part", X.sentences(F.col("text")).alias("body"))
    joined = kept.withColumn("part", F.col("k.part")).join(bodies, ["unit", "part"])
    shown = joined.select("unit", as_written(F.col("k"), F.shiftright(F.col("k.at"), 2 * BITS).cast("int")).alias("shown"))
    tags = shown.groupBy("unit").agg(F.array_sort(F.collect_set("shown")).alias("yake_tags"))
    every = parts.select("unit").distinct().join(tags, "unit", "left")
    return every.select("unit", F.coalesce("yake_tags", F.array().cast("array<string>")).alias("yake_tags"))

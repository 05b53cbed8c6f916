"""Named entities: capitalised spans tagged from a gazetteer, and the record name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitemill import constants as C
from sitemill.functions import text as X
from sitemill.operators.tokens import by_unit, part_rows, sentence_rows
from sitemill.schemas import TAGS

OTHER_TAG = "MISC"
SPANS_PER_SENTENCE = 1_000_000
SPANS_PER_PART = 1 << 42


def entity_spans(texts: DataFrame) -> DataFrame:
    """``(unit, named_entity, pos)`` for every capitalised span, in text order; ``texts`` may have a ``part``."""
    rows = part_rows(texts) if "part" in texts.columns else by_unit(texts)
    spans = sentence_rows(rows).select(
        "unit", "sentence", F.posexplode(X.proper_spans(F.col("body"))).alias("nth", "named_entity")
    )
    pos = F.col("sentence").cast("bigint") * SPANS_PER_SENTENCE + F.col("nth")
    if "part" in texts.columns:
        return spans.select("unit.unit", "named_entity", (F.col("unit.part") * SPANS_PER_PART + pos).alias("pos"))
    return spans.select("unit", "named_entity", pos.alias("pos"))


def distinct_entities(spans: DataFrame) -> DataFrame:
    """``(unit, ner_tags)``: each entity once, at its first place, with the tag of its last mention."""
    last = F.max_by("tag", "pos").alias("tag")
    each = spans.groupBy("unit", "named_entity").agg(F.min("pos").alias("pos"), last)
    in_order = F.array_sort(F.collect_list(F.struct("pos", "named_entity", "tag")))
    tags = F.transform(in_order, lambda e: F.struct(e["named_entity"].alias("named_entity"), e["tag"].alias("tag")))
    return each.groupBy("unit").agg(tags.alias("ner_tags"))


def entity_tags(texts: DataFrame, gazetteer: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Distinct entities per text, tagged by the ``(name, tag)`` table; unknown names are MISC.

    Mentions are folded per text before the look-up, so a name that is everywhere costs one row per
    text, and the gazetteer is joined by whatever strategy its size allows.  A gazetteer with a ``cue``
    column tags each mention: a row with a cue holds in sentences that contain it, and goes before a row
    without; an entity then has the tag of its last mention.  ``texts`` without cues may come in parts
    ``(unit, part, text)`` of the ``units``.
    """
    if "cue" in gazetteer.columns:
        return _listed(texts, _cued(texts, gazetteer))
    known = gazetteer.groupBy(F.col("name").alias("named_entity")).agg(F.max("tag").alias("known"))
    each = entity_spans(texts).groupBy("unit", "named_entity").agg(F.min("pos").alias("pos"))
    tagged = each.join(known, "named_entity", "left").withColumn("tag", F.coalesce("known", F.lit(OTHER_TAG)))
    return _listed(texts if units is None else units, tagged.select("unit", "named_entity", "pos", "tag"))


def _cued(texts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``(unit, named_entity, pos, tag)``: first place of each name, and the tag of its last mention by the best row that holds there.

    Mentions are folded before the look-up, and the sentence of the last one is fetched from its text after it, so a
    name that is everywhere brings one short row per text to its look-up.  Of texts with the same unit, those count
    that have the name at its last place.
    """
    rows = gazetteer.select(F.col("name").alias("named_entity"), F.col("tag").alias("known"), "cue")
    each = entity_spans(texts).groupBy("unit", "named_entity").agg(F.min("pos").alias("pos"), F.max("pos").alias("last"))
    joined = each.join(rows, "named_entity", "left")
    bodies = by_unit(texts).select("unit", X.sentences(F.col("text")).alias("bodies"))
    body = F.get("bodies", F.expr(f"int(last div {SPANS_PER_SENTENCE})"))
    fetched = joined.join(bodies, "unit").withColumn("body", body).drop("bodies")
    there = F.get(X.proper_spans(F.col("body")), F.expr(f"int(last % {SPANS_PER_SENTENCE})")) == F.col("named_entity")
    holds = there & F.col("known").isNotNull() & (F.col("cue").isNull() | F.contains(F.col("body"), F.col("cue")))
    best = F.max(F.when(holds, F.struct(F.col("cue").isNotNull().alias("cued"), F.col("known").alias("tag"))))
    tagged = fetched.groupBy("unit", "named_entity", "pos").agg(best.alias("best"))
    return tagged.select("unit", "named_entity", "pos", F.coalesce("best.tag", F.lit(OTHER_TAG)).alias("tag"))


def _listed(texts: DataFrame, mentions: DataFrame) -> DataFrame:
    listed = texts.select("unit").join(distinct_entities(mentions).hint("merge"), "unit", "left")
    return listed.withColumn("ner_tags", F.coalesce("ner_tags", F.array().cast(TAGS)))


def location_tags(ner_tags: Column) -> Column:
    return F.transform(F.filter(ner_tags, lambda e: e["tag"] == C.LOCATION_TAG), lambda e: e["named_entity"])


def entity_names(ner_tags: Column) -> Column:
    return F.transform(F.filter(ner_tags, lambda e: e.isNotNull()), lambda e: e["named_entity"])


def record_name(descriptions: DataFrame) -> DataFrame:
    """``(unit, name)``: the most frequent capitalised span, the earliest among equals; null if none."""
    counted = entity_spans(descriptions).groupBy("unit", "named_entity").agg(
        F.count("*").alias("n"), F.min("pos").alias("pos")
    )
    best = Window.partitionBy("unit").orderBy(F.desc("n"), "pos")
    first = counted.withColumn("rn", F.row_number().over(best)).where("rn = 1")
    named = first.select("unit", F.col("named_entity").alias("name"))
    return descriptions.select("unit").join(named.hint("merge"), "unit", "left")

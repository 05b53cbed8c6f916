"""Assembly of asset records from texts.

All facts of a record are computed for all texts at once and joined on the unit key.  Results that
feed several others (descriptions, keywords, vocabulary terms) are staged once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemill import constants as C
from sitemill.functions import text as X
from sitemill.functions import urls
from sitemill.models import Models, apply_model, text_vectors, with_key_vectors
from sitemill.operators import site_keywords
from sitemill.operators.classify import anchor_vectors, classify
from sitemill.operators.embedding import embed_lists
from sitemill.operators.entities import entity_names, entity_tags, location_tags, record_name
from sitemill.operators.facts import complete_addresses
from sitemill.operators.keywords import keywords
from sitemill.operators.long_texts import LongTexts, from_blocks
from sitemill.operators.names import named_entities
from sitemill.operators.summaries import descriptions
from sitemill.operators.vocabulary import reached_terms
from sitemill.schemas import TAGS
from sitemill.sources.inputs import PageStore
from sitemill.workspace import spread, stage

#: Links of a list whose texts may be one row.
LINKS_PER_PART = 200

NO_TEXT = "no_text"
SHORT_TEXT = "short_text"


@dataclass(frozen=True)
class References:
    """Tables that records are resolved against: entity tags by name, and known places.

    With ``full_names`` the gazetteer's names are sought word by word, whatever their length and place in a
    sentence; else only capitalised spans within sentences are looked up.
    """

    gazetteer: DataFrame
    places: DataFrame
    models: Models = field(default_factory=Models)
    full_names: bool = False


def text_failure(text: Column) -> Column:
    """Why a text gives no record, or null."""
    return F.when(text.isNull(), NO_TEXT).when(~X.has_context(text), SHORT_TEXT)


def parameter_failure(ecosystem: Column, paradigm: Column) -> Column:
    return F.when(ecosystem.isNull() | paradigm.isNull(), C.NO_PARAMETERS)


def failure_rows(items: DataFrame) -> DataFrame:
    """Failures among ``(mainURL, failure_reason)`` items."""
    failed = items.where(F.col("failure_reason").isNotNull())
    return failed.select("mainURL", F.lit(True).alias("failure"), "failure_reason")


def success_rows(records: DataFrame) -> DataFrame:
    return records.where(~F.col("failure"))


def texts_from_links(lists: DataFrame, store: PageStore, links_per_part: int | None = None) -> DataFrame | LongTexts:
    """``(unit, text)`` for ``(unit, links ARRAY)``: texts of the valid links, joined in link order.

    With ``links_per_part`` no row holds the texts of more links than that, and some: lists of more links come in parts.
    """
    asked = lists.select("unit", F.posexplode("links").alias("position", "link"))
    keyed = asked.where(urls.is_good(F.col("link"))).withColumn("url", urls.page_key(F.col("link")))
    found = keyed.join(store.texts(keyed.select("url").distinct()), "url").where(F.col("text").isNotNull())
    in_order = F.array_sort(F.collect_list(F.struct("position", "text"))).alias("found")
    if links_per_part is not None:
        block = F.floor(F.col("position") / links_per_part).alias("block")
        blocks = found.groupBy("unit", block).agg(in_order).select("unit", "block", F.array_join("found.text", " ").alias("text"))
        return from_blocks(lists, blocks)
    joined = found.groupBy("unit").agg(in_order)
    whole = lists.select("unit").join(joined, "unit", "left")
    return whole.select("unit", F.coalesce(F.array_join("found.text", " "), F.lit("")).alias("text"))


def _or_model(texts: DataFrame, models: Models, slot: str, name: str, built_in) -> tuple[DataFrame, DataFrame | None]:
    """The field of each unit, and ``(unit, error)`` where a model made it."""
    if getattr(models, slot) is None:
        return built_in(), None
    done = apply_model(texts, models, slot)
    return done.select("unit", F.col("value").alias(name)), done.select("unit", "error")


def _descriptions(texts: DataFrame, models: Models) -> DataFrame:
    """Descriptions; a summariser that fails gives the fixed note, which is no failure of the record."""
    if models.short_description is None and models.long_description is None:
        return descriptions(texts)
    capped = texts.select("unit", X.summary_input(F.col("text")).alias("text"))
    both = descriptions(texts)
    for slot in ("short_description", "long_description"):
        if getattr(models, slot) is not None:
            done = apply_model(capped, models, slot).select("unit", "value")
            both = both.drop(slot).join(done, "unit").withColumn(
                slot, F.coalesce("value", F.lit(C.EMPTY_SUMMARY))
            ).drop("value")
    return both


def _reached(pairs: DataFrame, vocabulary: DataFrame, threshold: float, models: Models) -> tuple[DataFrame, DataFrame | None]:
    """``(unit, terms)`` of the vocabulary reached from ``(unit, keyword)`` rows, if any, and ``(unit, error)``.

    A term of the vocabulary that cannot be embedded fails the job, a keyword fails its units.

    Each distinct keyword is embedded and scored once.  A keyword of very many units makes a skewed
    join key; that join feeds a grouping on another key, so adaptive execution can split it.
    """
    terms = with_key_vectors(vocabulary.select("term").distinct(), "term", models)
    each = with_key_vectors(spread(pairs.select("keyword").distinct(), "keyword"), "keyword", models)
    errors = None
    if models.key_vector is not None:
        failed = terms.where("vector IS NULL").select("error").first()
        if failed:
            raise ValueError(f"the vocabulary cannot be embedded: {failed['error']}")
        errors = pairs.join(each.where("error IS NOT NULL").select("keyword", "error"), "keyword").select("unit", "error")
    return reached_terms(pairs, each.select("keyword", "vector"), terms, threshold), errors


def _key_texts(lists: DataFrame, models: Models) -> tuple[DataFrame, DataFrame | None]:
    """``(unit, vector)`` of the ``(unit, texts ARRAY)`` of keywords, and ``(unit, error)`` where a model made it."""
    if models.key_vector is None and models.vectors is None:
        return embed_lists(lists, models.dim), None
    texts = lists.select("unit", F.array_join("texts", ",").alias("text"))
    if models.key_vector is None:
        return text_vectors(texts, models), None
    done = apply_model(texts, models, "key_vector")
    return done.select("unit", F.col("value").alias("vector")), done.select("unit", "error")


def _with_errors(records: DataFrame, *found: DataFrame | None) -> DataFrame:
    """``records`` with ``failure_reason`` set to the first error of each unit, if it has none yet."""
    tables = [t for t in found if t is not None]
    if not tables:
        return records
    errors = reduce(DataFrame.unionByName, tables).where("error IS NOT NULL").groupBy("unit").agg(F.min("error").alias("_error"))
    joined = _beside(records, errors)
    return joined.withColumn("failure_reason", F.coalesce("failure_reason", "_error")).drop("_error")


def _beside(records: DataFrame, part: DataFrame) -> DataFrame:
    """``records`` with the fields of ``part`` by unit.

    Both grow with the input and pack well on disk, so neither is sent through the driver, whatever its files' size.
    """
    return records.join(part.hint("merge"), "unit", "left")


def _reads_parts(refs: References) -> bool:
    """Whether all that is sought in texts can be sought in their parts; models and cues look at whole texts."""
    models = refs.models
    plugged = (models.entities, models.embedding, models.keywords, models.short_description, models.long_description, models.vectors)
    return all(m is None for m in plugged) and not refs.full_names and "cue" not in refs.gazetteer.columns


def _usable(texts: DataFrame | LongTexts, refs: References) -> DataFrame | LongTexts:
    """The staged texts that give a record, long ones in parts if these will do."""
    if isinstance(texts, LongTexts) and not _reads_parts(refs):
        texts = texts.whole()
    if not isinstance(texts, LongTexts):
        return stage(texts.where(X.has_context(F.col("text"))), "texts")
    heads = stage(usable(texts.heads), "heads")
    return LongTexts(stage(usable(texts.short), "texts"), heads, texts.parts, texts.blocks)


def _contacts(texts: DataFrame | LongTexts) -> DataFrame:
    """``(unit, contactEmail, phoneNumber, address)`` as found; of parts, the values are folded as rows."""
    kinds = {"contactEmail": X.emails, "phoneNumber": X.phones, "address": X.addresses}
    if not isinstance(texts, LongTexts):
        return texts.select("unit", *[find(F.col("text")).alias(kind) for kind, find in kinds.items()])

    def tagged(kind, values):
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    hits = F.concat(*[tagged(kind, find(F.col("text"))) for kind, find in kinds.items()])
    once = texts.parts.select("unit", F.explode(hits).alias("hit")).select("unit", "hit.kind", "hit.value").distinct()
    values = [F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value")))).alias(kind) for kind in kinds]
    found = _beside(texts.heads.select("unit"), once.groupBy("unit").agg(*values))
    none = F.array().cast("array<string>")
    return _contacts(texts.short).unionByName(found.select("unit", *[F.coalesce(kind, none).alias(kind) for kind in kinds]))


def _keywords(source: DataFrame | LongTexts) -> DataFrame:
    if not isinstance(source, LongTexts):
        return keywords(source)
    return keywords(source.short).unionByName(site_keywords.keywords(source.parts.select("unit", "part", "text")))


def _common(texts: DataFrame | LongTexts, refs: References, keyword_texts) -> DataFrame:
    """Fields that do not depend on a vocabulary, one staged row per unit."""
    models, given = refs.models, texts
    none = F.array().cast("array<string>")
    starts, texts, units = (given, given, None) if isinstance(given, DataFrame) else (given.starts(), given.rows(), given.starts().select("unit"))
    described = stage(_descriptions(starts, models), "descriptions")
    named_from = described.select("unit", F.concat("short_description", "long_description").alias("text"))
    name, no_name = _or_model(named_from, models, "name", "name", lambda: record_name(named_from))
    own_tags = lambda: named_entities(texts, refs.gazetteer) if refs.full_names else entity_tags(texts, refs.gazetteer, units)
    tags, no_tags = _or_model(texts, models, "entities", "ner_tags", own_tags)
    own_vectors = lambda: text_vectors(texts, models).withColumnRenamed("vector", "embedding")
    vector, no_vector = _or_model(texts, models, "embedding", "embedding", own_vectors)
    found = _contacts(given)
    address = complete_addresses(found.select("unit", "address").where(F.size("address") > 0), refs.places)
    source = keyword_texts(given, described)
    words, no_words = _or_model(source, models, "keywords", "yake_tags", lambda: _keywords(source))
    facts = found.select("unit", "contactEmail", "phoneNumber", F.lit(None).cast("string").alias("failure_reason"))
    joined = _with_errors(facts, no_name, no_tags, no_vector, no_words)
    for part in (described, name, tags, vector, address, words):
        joined = _beside(joined, part)
    tags_or_none = F.coalesce("ner_tags", F.array().cast(TAGS))
    return stage(
        joined.select(
            "unit",
            "name",
            F.coalesce("address", none).alias("address"),
            "contactEmail",
            "phoneNumber",
            F.col("short_description").alias("shortDescription"),
            F.col("long_description").alias("longDescription"),
            F.col("embedding").cast("array<float>").alias("embedding"),
            tags_or_none.alias("ner_tags"),
            location_tags(tags_or_none).alias("location_tags"),
            F.coalesce("yake_tags", none).alias("yake_tags"),
            "failure_reason",
        ),
        "common",
    )


def _with_terms(records: DataFrame, found: DataFrame, name: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return _beside(records, found.withColumnRenamed("terms", name)).withColumn(name, F.coalesce(name, none))


def _classified(records: DataFrame, vocabulary_terms: str, models: Models) -> DataFrame:
    lists = records.select("unit", F.concat("yake_tags", vocabulary_terms).alias("texts"))
    vectors, errors = _key_texts(lists, models)
    anchors = anchor_vectors(records.sparkSession, models)
    return _beside(_with_errors(records, errors), classify(vectors, anchors))


def _made(records: DataFrame, keep_failed: bool, fields: tuple) -> DataFrame:
    """The record fields; units with a failed model only on request, with their ``failure_reason``."""
    if keep_failed:
        return records.select(*fields, "failure_reason")
    return records.where("failure_reason IS NULL").select(*fields)


def usable(texts: DataFrame) -> DataFrame:
    return texts.where(X.has_context(F.col("text"))).select("unit", "text")


def records(
    texts: DataFrame | LongTexts,
    vocabularies: Sequence[tuple[Column, DataFrame]],
    ecosystem: str,
    refs: References,
    keep_failed: bool = False,
) -> DataFrame:
    """Records with one vocabulary each, from ``(unit, text)``; short texts give none.

    ``vocabularies`` pairs a condition on ``unit`` rows with the vocabulary those rows use, so two
    kinds of texts share all other extraction.  ``texts`` may carry further columns for the conditions, if none is long.
    """
    plain = _usable(texts, refs)
    if isinstance(plain, LongTexts):
        common, plain = _common(plain, refs, lambda t, _: t), plain.starts()
    else:
        common = _common(plain.select("unit", "text"), refs, lambda t, _: t)
    keyword_rows = common.select("unit", F.explode("yake_tags").alias("keyword"))
    parts, errors = [], []
    for condition, vocabulary in vocabularies:
        mine = keyword_rows.join(plain.where(condition).select("unit").hint("merge"), "unit", "left_semi")
        found, failed = _reached(mine, vocabulary, C.HOUSE_THRESHOLD, refs.models)
        parts.append(found)
        errors.append(failed)
    reached = reduce(DataFrame.unionByName, parts)
    done = stage(_with_errors(_with_terms(common, reached, "all_keywords"), *errors), "keyworded")
    fields = (
        "name",
        F.col("unit").alias("mainURL"),
        "address",
        "contactEmail",
        "phoneNumber",
        "shortDescription",
        "longDescription",
        "embedding",
        "all_keywords",
        "ner_tags",
        "location_tags",
        "yake_tags",
        "type",
        "subtype",
        F.lit(ecosystem).alias("forEcosystem"),
    )
    return _made(_classified(done, "all_keywords", refs.models), keep_failed, fields)


def dual_records(
    texts: DataFrame | LongTexts,
    house: DataFrame,
    paradigm: DataFrame,
    ecosystem: str,
    refs: References,
    keep_failed: bool = False,
) -> DataFrame:
    """Records with a house and a paradigm vocabulary.

    Keywords come from the text and its long description; the paradigm is reached from keywords,
    house terms and entity names together.
    """
    plain = _usable(texts if isinstance(texts, LongTexts) else texts.select("unit", "text"), refs)

    def with_long(t, described):
        if isinstance(t, LongTexts):
            rest = t.parts.where("NOT last").select("unit", "part", "text")
            parts = stage(rest.unionByName(with_long(t.parts.where("last"), described)), "long-parts")
            return replace(t, short=with_long(t.short, described), parts=parts)
        return t.join(described.select("unit", "long_description").hint("merge"), "unit").select(
            "unit", *(["part"] if "part" in t.columns else []), F.concat_ws(" ", "text", "long_description").alias("text")
        )

    common = _common(plain, refs, with_long)
    keyword_rows = common.select("unit", F.explode("yake_tags").alias("keyword"))
    in_house, failed = _reached(keyword_rows, house, C.DUAL_HOUSE_THRESHOLD, refs.models)
    done = stage(_with_errors(_with_terms(common, in_house, "vocabulary_keywords"), failed), "keyworded")
    pool = F.concat("yake_tags", "vocabulary_keywords", entity_names(F.col("ner_tags")))
    pairs = done.select("unit", F.explode(F.array_distinct(pool)).alias("keyword"))
    in_paradigm, failed = _reached(pairs, paradigm, C.DUAL_PARADIGM_THRESHOLD, refs.models)
    both = _with_terms(_classified(done, "vocabulary_keywords", refs.models), in_paradigm, "paradigm_keywords")
    fields = (
        "name",
        F.col("unit").alias("mainURL"),
        "address",
        "contactEmail",
        "phoneNumber",
        "shortDescription",
        "longDescription",
        "embedding",
        "vocabulary_keywords",
        "paradigm_keywords",
        "yake_tags",
        "ner_tags",
        "location_tags",
        "type",
        "subtype",
        F.lit(ecosystem).alias("forEcosystem"),
        F.lit(False).alias("failure"),
    )
    return _made(_with_errors(both, failed), keep_failed, fields)

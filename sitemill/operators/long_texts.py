"""Texts of any length as tables of parts, cut where nothing that is sought in a text reaches across.

A text that comes in blocks, such as the pages of a link list, is never made one row.  Each block is cut at its last
safe place, and what is left goes before the next block: a part is some pages of text, as long as a block has one
sentence end.  A cut is behind the end of a sentence, where no phone, e-mail or address can go on, so that facts,
words and sentences of the parts are those of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitemill import constants as C
from sitemill.workspace import stage

#: An address may go on behind the point of these words.
_ABBREVIATIONS = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl|Suite|Ste|Apt|Unit"
#: A text up to its last safe cut.  A line end cuts where no phone reaches across and no blank follows.
CUT = rf"(?s)^.*(?:(?:(?<! (?:{_ABBREVIATIONS}))\.|[!?])[ \t\r\f]+|[^\d)\s]\n(?=\S))"
LEADING = r"^[ \t\r\f]+"


@dataclass(frozen=True)
class LongTexts:
    """Texts of which some are too long for a row.

    ``short`` is ``(unit, text)``.  Of the other units, ``heads`` is ``(unit, text)`` with as much of the beginning as
    descriptions read, ``parts`` is ``(unit, part, last, text)``, and ``blocks`` ``(unit, block, text)`` as given.
    """

    short: DataFrame
    heads: DataFrame
    parts: DataFrame
    blocks: DataFrame

    def starts(self) -> DataFrame:
        """``(unit, text)`` of all units, long texts by their beginning."""
        return self.short.select("unit", "text").unionByName(self.heads)

    def rows(self) -> DataFrame:
        """``(unit, part, text)`` of all units."""
        return self.short.select("unit", F.lit(0).cast("bigint").alias("part"), "text").unionByName(self.parts.drop("last"))

    def whole(self) -> DataFrame:
        """``(unit, text)`` of all units, one row each, for models that read whole texts."""
        return self.short.select("unit", "text").unionByName(joined_blocks(self.blocks))


def joined_blocks(blocks: DataFrame) -> DataFrame:
    found = blocks.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("found"))
    return found.select("unit", F.array_join("found.text", " ").alias("text"))


def from_blocks(units: DataFrame, blocks: DataFrame) -> DataFrame | LongTexts:
    """Texts of the ``units``, from ``(unit, block, text)`` whose texts are joined by blanks; units without are empty.

    Only units of several blocks are cut; where there is none, the result is a plain ``(unit, text)`` table.
    """
    spaced = F.concat("text", F.lit(" "))
    given = blocks.where("unit IS NOT NULL").withColumn("n_blocks", F.count("*").over(Window.partitionBy("unit")))
    given = stage(given, "text-blocks")
    single, several = given.where("n_blocks = 1"), given.where("n_blocks > 1").drop("n_blocks")
    if several.isEmpty():
        return _plain(units, single)
    cut = stage(several.withColumn("at", F.length(F.regexp_extract(spaced, CUT, 0))), "cut-blocks")
    along = Window.partitionBy("unit").orderBy("block")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    has = F.col("at") > 0
    places = cut.select("unit", "block", "at", F.length("text").alias("size")).select(
        "unit",
        "block",
        F.coalesce(F.count_if(has).over(earlier), F.lit(0)).alias("part"),
        F.count_if(has).over(Window.partitionBy("unit")).alias("n_cuts"),
        F.coalesce(F.sum(F.col("size") + 1).over(earlier), F.lit(0)).alias("before"),
    )
    places = stage(places, "block-places")
    short = _plain(units, single).join(several.select("unit").distinct(), "unit", "left_anti")
    return LongTexts(short, _heads(several, places), stage(_parts(cut, places), "text-parts"), several)


def _plain(units: DataFrame, single: DataFrame) -> DataFrame:
    texts = units.select("unit").join(single.select("unit", "text"), "unit", "left")
    return texts.select("unit", F.coalesce("text", F.lit("")).alias("text"))


def _heads(blocks: DataFrame, places: DataFrame) -> DataFrame:
    """One character more than is kept of a long text, so that it is still seen to be one."""
    most = C.SUMMARY_LONG + 1
    first = blocks.join(places.where(F.col("before") < most).select("unit", "block"), ["unit", "block"])
    joined = joined_blocks(first.select("unit", "block", F.substring("text", 1, most).alias("text")))
    return joined.select("unit", F.substring("text", 1, most).alias("text"))


def _parts(cut: DataFrame, places: DataFrame) -> DataFrame:
    spaced = F.concat("text", F.lit(" "))
    rows = cut.withColumn("text", spaced).join(places.select("unit", "block", "part", "n_cuts"), ["unit", "block"])
    head = F.struct("part", F.expr("substring(text, 1, at)").alias("text"))
    tail = F.struct((F.col("part") + F.when(F.col("at") > 0, 1).otherwise(0)).alias("part"), F.expr("substring(text, at + 1)").alias("text"))
    pieces = F.when(F.col("at") > 0, F.array(head, tail)).otherwise(F.array(tail))
    each = rows.select("unit", "block", "n_cuts", F.explode(pieces).alias("p"))
    grouped = each.groupBy("unit", F.col("p.part").alias("part"), "n_cuts").agg(
        F.array_sort(F.collect_list(F.struct("block", F.col("p.text").alias("text")))).alias("found")
    )
    joined = F.array_join("found.text", "")
    text = F.when(F.col("part") == 0, joined).otherwise(F.regexp_replace(joined, LEADING, ""))
    return grouped.select("unit", "part", (F.col("part") == F.col("n_cuts")).alias("last"), text.alias("text"))

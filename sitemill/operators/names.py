"""Names of a gazetteer in texts, of any length and at any place, by an automaton over words.

A name is its sequence of words; signs and blanks between words do not matter, letters' case does.  Texts are read
once, where they are: a Bloom filter over the beginnings of names tells where a name may start, and only the few
words that may be a name go on from there, to the one block that has the names of their first word, however many
blocks there are.  The words of a block are dealt to tiles by their number; a block and a tile meet in one group, where
an automaton over the block's names (a trie of word numbers, one table of steps per depth) is started at every start
of the tile, all at once; a start is dropped at its first word that no name goes on with.  All matches are
found, then those of a sentence are taken longest first, the earlier of two equally long; a match that overlaps
one taken before is dropped.  Names that differ in signs only are one name, shown as the smallest of them, with
the largest tag.  Names without any word are never found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitemill.functions import text as X
from sitemill.operators.entities import OTHER_TAG, SPANS_PER_SENTENCE, entity_spans
from sitemill.operators.word_counts import list_sizes, list_starts, owner
from sitemill.schemas import TAGS
from sitemill.workspace import freed, stage

WORD = r"[\p{L}\p{N}]+"
#: Names of a block, and characters of a tile.
BLOCK_NAMES, TILE_CHARS = 100_000, 16_000_000
#: Bits of the filter at most: with more names it lets more words pass, which are then no names.
MOST_BITS, _CHUNK = 1 << 28, 1 << 16
#: Texts whose words are tried at once.
SLICE_ROWS = 1000
_ODD, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def name_words(gazetteer: DataFrame) -> DataFrame:
    """``name, tag, words``: one row per distinct sequence of words."""
    rows = gazetteer.where("name IS NOT NULL").select("name", "tag", F.regexp_extract_all("name", F.lit(WORD), 0).alias("words"))
    return rows.where(F.size("words") > 0).groupBy("words").agg(F.min("name").alias("name"), F.max("tag").alias("tag"))


class Automaton:
    """A trie over the words of names; words are numbers, and the states of a depth are those of their beginnings."""

    def __init__(self, names: pa.ListArray):
        sizes = list_sizes(names, 1)
        coded = names.flatten().dictionary_encode()
        self.vocabulary = coded.dictionary
        code, first = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), list_starts(sizes)
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        open_names, state = np.arange(len(sizes)), np.zeros(len(sizes), np.int64)
        while len(open_names):
            depth = len(self.steps)
            keys, state = np.unique(state * len(self.vocabulary) + code[first[open_names] + depth], return_inverse=True)
            whole = np.full(len(keys), -1, np.int64)
            ended = sizes[open_names] == depth + 1
            whole[state[ended]] = open_names[ended]
            self.steps.append((keys, whole))
            open_names, state = open_names[~ended], state[~ended]

    def matches(self, words: pa.Array, left: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
        """First word, size and number of every name found; ``left`` words remain in the sentence at each word.

        ``starts`` are the words to start at, if not all.
        """
        code = pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at, state, found = np.flatnonzero(code >= 0) if starts is None else starts[code[starts] >= 0], 0, []
        for depth, (keys, whole) in enumerate(self.steps):
            if depth:
                going = left[at] > depth
                at, state = at[going], state[going]
                going = code[at + depth] >= 0
                at, state = at[going], state[going]
            key = state * len(self.vocabulary) + code[at + depth]
            state = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            going = keys[state] == key
            at, state = at[going], state[going]
            name = whole[state]
            ended = name >= 0
            found.append(np.stack([at[ended], np.full(int(ended.sum()), depth + 1), name[ended]]))
        return np.concatenate(found, axis=1)


def _word_codes(words: pa.Array) -> np.ndarray:
    """A number for each word that depends on its letters only; different words may share one."""
    coded = words.dictionary_encode()
    each = coded.dictionary.cast(pa.large_binary())
    ends = np.frombuffer(each.buffers()[1], np.int64, len(each) + 1, each.offset * 8) if len(each) else np.zeros(1, np.int64)
    sizes = np.diff(ends)
    letters = np.frombuffer(each.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1) if ends[-1] else np.zeros(0, np.uint64)
    powers = np.multiply.accumulate(np.full(int(sizes.max(initial=0)) + 1, _ODD, np.uint64))
    sums = np.append(np.uint64(0), np.cumsum(letters * powers[owner(sizes)[1]]))
    starts = ends - ends[0]
    codes = _mixed(sums[starts[1:]] - sums[starts[:-1]])
    return codes[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)


def _mixed(keys: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        keys = (keys ^ keys >> np.uint64(shift)) * np.uint64(factor)
    return keys


def _further(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Numbers of sequences of words with one more word."""
    return _mixed(keys * _ODD + codes)


class Beginnings:
    """A Bloom filter of what names begin with, word by word, and of whole names: it may say yes too often, never no."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, np.uint8)
        self.size = len(self.bits) * 8

    @staticmethod
    def places(keys: np.ndarray, size: int) -> np.ndarray:
        return np.concatenate([keys & np.uint64(size - 1), keys >> np.uint64(32) & np.uint64(size - 1)])

    def has(self, keys: np.ndarray) -> np.ndarray:
        one, other = self.places(keys, self.size).astype(np.int64).reshape(2, -1)
        return ((self.bits[one >> 3] >> (one & 7)) & (self.bits[other >> 3] >> (other & 7)) & 1).astype(bool)

    def starts(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a name may start, and how many words the longest name that may start there has."""
        longest = np.zeros(len(codes), np.int64)
        at, key, depth = np.arange(len(codes)), np.zeros(len(codes), np.uint64), 0
        while len(at):
            key = _further(key, codes[at + depth])
            going = self.has(key)
            at, key, depth = at[going], key[going], depth + 1
            longest[at[self.has(_mixed(key ^ _END))]] = depth
            going = left[at] > depth
            at, key = at[going], key[going]
        found = np.flatnonzero(longest)
        return found, longest[found]


def beginnings(names: DataFrame) -> bytes:
    """The bits of ``Beginnings`` of ``(words)``, at most ``MOST_BITS``; only these reach the driver."""
    entries = names.agg(F.coalesce(F.sum(F.size("words") + 1), F.lit(0)).alias("n")).first()["n"]
    size = min(MOST_BITS, max(_CHUNK, 1 << (8 * entries).bit_length()))

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = list_sizes(batch.column("words"), 1)
            codes, first = _word_codes(batch.column("words").flatten()), list_starts(sizes)
            at, key, keys = np.arange(len(sizes)), np.zeros(len(sizes), np.uint64), []
            while len(at):
                depth = len(keys) // 2
                key = _further(key, codes[first[at] + depth])
                ended = sizes[at] == depth + 1
                keys += [key, _mixed(key[ended] ^ _END)]
                at, key = at[~ended], key[~ended]
            found = np.unique(Beginnings.places(np.concatenate([*keys, np.zeros(0, np.uint64)]), size)).astype(np.int64)
            chunks, start = np.unique(found // _CHUNK, return_index=True)
            parts = [(x % _CHUNK).astype("<i4").tobytes() for x in np.split(found, start[1:])] if len(found) else []
            yield pa.RecordBatch.from_arrays([pa.array(chunks.astype(np.int32)), pa.array(parts, pa.binary())], ["chunk", "at"])

    def folded(rows: pa.Table) -> pa.Table:
        bits = np.zeros(_CHUNK, np.uint8)
        for at in rows.column("at").to_pylist():
            bits[np.frombuffer(at, "<i4")] = 1
        return pa.table([rows.column("chunk")[:1], pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])

    bits = bytearray(size // 8)
    with freed(names.sparkSession):
        for r in names.select("words").mapInArrow(spots, "chunk int, at binary").groupBy("chunk").applyInArrow(folded, "chunk int, bits binary").collect():
            bits[r["chunk"] * _CHUNK // 8 : (r["chunk"] + 1) * _CHUNK // 8] = r["bits"]
    return bytes(bits)


def name_starts(texts: DataFrame, names: DataFrame) -> DataFrame:
    """The columns of ``texts`` but its text, and ``sentence, place, words``: where names may start, and the words of the longest."""
    sentences = F.transform(X.sentences(F.col("text")), lambda s: F.regexp_extract_all(s, F.lit(WORD), 0))
    held = [c for c in texts.columns if c != "text"]
    given = texts.where("text IS NOT NULL").select(*held, sentences.alias("sentences"))
    added = StructType.fromDDL("sentence int, place int, words array<string>")
    bits = texts.sparkSession.sparkContext.broadcast(beginnings(names))

    def found(rows: pa.RecordBatch, known: Beginnings) -> pa.RecordBatch:
        sentences = rows.column("sentences")
        listed = sentences.flatten()
        words = listed.flatten()
        row, sentence = owner(list_sizes(sentences, 1))
        spot, place = owner(list_sizes(listed, 1))
        left = list_sizes(listed, 1)[spot] - place
        at, size = known.starts(_word_codes(words), left)
        which, ahead = owner(size)
        ends = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
        windows = pa.ListArray.from_arrays(ends, words.take(pa.array(at[which] + ahead)))
        numbers = [pa.array(x.astype(np.int32)) for x in (sentence[spot[at]], place[at])]
        return pa.RecordBatch.from_arrays([*(rows.column(c).take(pa.array(row[spot[at]])) for c in held), *numbers, windows], [*held, *added.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Beginnings(bits.value)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                yield found(batch.slice(i, SLICE_ROWS), known)

    return given.mapInArrow(run, StructType([*(given.schema[c] for c in held), *added.fields]))


def all_matches(texts: DataFrame, gazetteer: DataFrame, block_names: int = BLOCK_NAMES, tile_chars: int = TILE_CHARS) -> DataFrame:
    """``sentence, place, size, name, tag`` and the other columns for every occurrence, overlapping ones too; ``texts`` has ``_u, text``."""
    names = stage(name_words(gazetteer), "names")
    blocks = max(1, -(-names.count() // block_names))
    block = F.pmod(F.xxhash64(F.get("words", F.lit(0))), F.lit(blocks)).cast("int").alias("block")
    starts = stage(name_starts(texts, names).select("*", block), "name-starts")
    # As many tiles as the words of a block need; one row per block.
    least = -(-int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks)
    chars = F.sum(F.length(F.array_join("words", " ")) + 1)
    tiles = starts.groupBy("block").agg(F.greatest(F.ceil(chars / tile_chars), F.lit(least)).cast("int").alias("tiles"))
    held = [c for c in texts.columns if c != "text"]
    left = starts.join(F.broadcast(tiles), "block").withColumn("tile", F.pmod(F.xxhash64("_u", "sentence", "place"), F.col("tiles")).cast("int")).drop("tiles")
    right = names.select("*", block).join(F.broadcast(tiles), "block")
    right = right.select("block", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "words", "name", "tag")
    added = StructType.fromDDL("sentence int, place int, size int, name string, tag string")
    fields = StructType([*(left.schema[c] for c in held), *added.fields])

    def find(given: pa.Table, known: pa.Table) -> pa.Table:
        at, size, name = out = np.zeros((3, 0), np.int64)
        if given.num_rows and known.num_rows:
            windows = given.column("words").combine_chunks()
            sizes = list_sizes(windows, 1)
            window, place = owner(sizes)
            out = Automaton(known.column("words").combine_chunks()).matches(windows.flatten(), sizes[window] - place, list_starts(sizes))
            at, size, name = window[out[0]], out[1], out[2]
        kept = [given.column(c).take(pa.array(at)) for c in (*held, "sentence", "place")]
        shown = [known.column(c).take(pa.array(name)) for c in ("name", "tag")]
        return pa.table([*kept, pa.array(size.astype(np.int32)), *shown], fields.names)

    return left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile")).applyInArrow(find, fields)


def longest_first(matches: DataFrame) -> DataFrame:
    """The matches of each sentence that overlap none taken before them."""
    n = int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = matches.repartition(n, "_u", "sentence").sortWithinPartitions("_u", "sentence", F.desc("size"), "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, taken = None, set()
        for batch in batches:
            kept = []
            for unit, sentence, place, size in zip(*(batch.column(c).to_pylist() for c in ("_u", "sentence", "place", "size")), strict=True):
                if held != (unit, sentence):
                    held, taken = (unit, sentence), set()
                own = range(place, place + size)
                free = taken.isdisjoint(own)
                if free:
                    taken.update(own)
                kept.append(free)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return ordered.mapInArrow(run, matches.schema)


def name_mentions(texts: DataFrame, gazetteer: DataFrame, block_names: int = BLOCK_NAMES, tile_chars: int = TILE_CHARS) -> DataFrame:
    """``unit, sentence, place, size, named_entity, tag``: the names in ``(unit, text)``, by sentence and word."""
    # The number of a text is made up, but used from the staged starts only.
    numbered = texts.select(F.monotonically_increasing_id().alias("_u"), "unit", "text")
    found = longest_first(all_matches(numbered, gazetteer, block_names, tile_chars))
    return found.select("unit", "sentence", "place", "size", F.col("name").alias("named_entity"), "tag")


def named_entities(texts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``unit, ner_tags``: each name once, at its first place, and capitalised spans that are part of no name.

    In a sentence the names of the gazetteer come before other spans, which are tagged as unknown.
    """
    mentions = stage(name_mentions(texts, gazetteer), "name-mentions")
    at = F.col("sentence").cast("bigint") * (2 * SPANS_PER_SENTENCE) + F.col("place")
    names = mentions.groupBy("unit", "named_entity").agg(F.min(at).alias("pos"), F.max("tag").alias("tag"))
    spans = entity_spans(texts).groupBy("unit", "named_entity").agg(F.min("pos").alias("pos"))
    later = F.expr(f"pos div {SPANS_PER_SENTENCE}") * (2 * SPANS_PER_SENTENCE) + SPANS_PER_SENTENCE + F.col("pos") % SPANS_PER_SENTENCE

    def spaced(column: str):
        return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(column, F.lit(WORD), 0), " "), F.lit(" "))

    known = names.groupBy("unit").agg(F.collect_list(spaced("named_entity")).alias("known"))
    joined = spans.join(known, "unit", "left").withColumn("span", spaced("named_entity"))
    free = joined.where(F.col("known").isNull() | ~F.exists("known", lambda k: F.contains(k, F.col("span"))))
    others = free.select("unit", "named_entity", later.alias("pos"), F.lit(OTHER_TAG).alias("tag"))
    entry = F.struct("pos", "named_entity", "tag")
    listed = names.unionByName(others).groupBy("unit").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    tags = F.transform("e", lambda e: F.struct(e["named_entity"].alias("named_entity"), e["tag"].alias("tag")))
    every = texts.select("unit").join(listed, "unit", "left")
    return every.select("unit", F.coalesce(tags, F.array().cast(TAGS)).alias("ner_tags"))

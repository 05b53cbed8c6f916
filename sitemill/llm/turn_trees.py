"""The prefix trie of rebuilt conversations, from ternary search trees over range shards of sorted turn ids.

Turns become ids of a dictionary of distinct (role, text); the texts themselves are never shuffled.  A
conversation is then its list of ids, and equal lists are one row with a count.  These rows are range-sorted,
and every stretch of about ``SHARD_TURNS`` turns is a shard of its own: its lists go into a ternary search
tree, the median first and then the medians of both halves, so each level's search tree is balanced.  One
iterative traversal of the tree folds members, leaves and savings into the parents.  As rows are sorted, a
trie node can only reach into another shard if it lies on the path of a shard's first or last list; such
boundary nodes keep what closed nodes below gave them, and are merged by their key afterwards.

A conversation of more than ``SEGMENT`` turns is several rows: each is keyed by a hash of all earlier turns
and belongs to a trie of its own, whose totals hang below the turn at which it was cut.  Tries are worked on
from the deepest segment up; nearly always there is one segment only.

The ids of the conversations that end at a node are hashed as a stream: stretches of sorted ids become text in
many tasks, and the text of a node, however many conversations end there, passes one hash state.

Defined results: rows without conv_id take no part.  Null roles and texts are empty.  Turns of one number, null
numbers first, are ordered by the SHA-256 of role and text; repeated rows are turns of their own.  An empty
table has no conversation, hence no node, not even the root.  ``%`` is that of SQL for negative ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitemill.llm.components import sorted_tiles
from sitemill.operators.ranking import rank_within
from sitemill.workspace import stage

#: Turns in one row of a conversation, and turns that one search tree is built from.
SEGMENT, SHARD_TURNS = 1024, 200_000
#: Conversations of one base share turns: ids are taken together by this many, and heads have fewer turns than that.
FAMILY, HEADS = 5, 9
#: Characters of conversation ids in one piece of a node's list.
PIECE = 1 << 20

_RAW = (
    "open boolean, key string, parent_key string, parent_conv long, alias string, path array<string>, conv long, "
    "depth long, n long, children long, leaves long, saved long, size long, ends string"
)


def encoded_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, position, id, size``: turns in order, as ids of the dictionary of distinct turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    print_of = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", print_of.alias("fingerprint"), F.octet_length(text).cast("long").alias("size")
    )
    rows = stage(rows, "turns")
    entries = rows.select("fingerprint").distinct().withColumn("id", F.monotonically_increasing_id())
    entries = stage(entries, "turn-ids")
    return rank_within(rows.join(entries, "fingerprint"), ["conv_id"], ["turn", "fingerprint"]).select("conv_id", "position", "id", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, position, id, size`` of rebuilt conversations, and ``conv_id, total`` of all of them.

    A conversation has the first ``head`` turns of its family's base and its own turns after as many.
    """
    head = F.crc32(F.col("conv_id").cast("string")) % HEADS
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    sizes = stage(sizes.select("conv_id", "n", head.alias("head"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")), "conversations")
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("in_base"))
    convs = sizes.join(bases, "base", "left").withColumn("taken", F.least("head", F.coalesce("in_base", F.lit(0))))
    convs = convs.select("conv_id", "base", "head", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("total"))
    heads = turns.where(F.col("position") < HEADS).withColumnRenamed("conv_id", "base")
    heads = convs.select("conv_id", "base", "head").join(heads, "base").where("position <= head")
    rest = turns.join(convs.select("conv_id", "head", "taken"), "conv_id").where("position > head")
    rest = rest.withColumn("position", F.col("position") - F.col("head") + F.col("taken"))
    names = ["conv_id", "position", "id", "size"]
    return heads.select(names).unionByName(rest.select(names)), convs.select("conv_id", "total")


def _hashed(*columns: Column | str) -> Column:
    return F.concat(F.hex(F.xxhash64(F.lit(1), *columns)), F.lit("-"), F.hex(F.xxhash64(F.lit(2), *columns)))


def segments(turns: DataFrame, totals: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``conv_id, seg, k, ids, sizes, last, following``: a conversation's rows, one for each ``segment`` turns.

    ``k`` stands for all turns before the row and ``following`` for all turns up to its end, if more follow.
    """
    numbered = turns.withColumn("seg", F.floor((F.col("position") - 1) / segment).cast("int"))
    listed = numbered.groupBy("conv_id", "seg").agg(F.array_sort(F.collect_list(F.struct("position", "id", "size"))).alias("t"))
    listed = listed.select("conv_id", "seg", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))
    silent = totals.where("total = 0").select("conv_id", F.lit(0).alias("seg"), F.array().cast("array<bigint>").alias("ids"))
    rows = listed.unionByName(silent.withColumn("sizes", F.col("ids")))
    none = F.lit(None).cast("string")
    if totals.where(F.col("total") > segment).isEmpty():
        return rows.select("*", F.lit("").alias("k"), F.lit(True).alias("last"), none.alias("following"))
    along = Window.partitionBy("conv_id").orderBy("seg")
    part = [F.xxhash64(F.lit(seed), "seg", "ids") for seed in (1, 2)]

    def name(window):
        return F.concat_ws("-", *[F.hex(F.bit_xor(p).over(window)) for p in part])

    up_to = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    chained = rows.withColumn("k", F.when(F.col("seg") == 0, "").otherwise(name(before))).withColumn("following", name(up_to))
    chained = chained.withColumn("last", F.lead("seg").over(along).isNull())
    return chained.withColumn("following", F.when(~F.col("last"), F.col("following")))


class Tree:
    """A ternary search tree; node 0 stands for the turns before the first."""

    def __init__(self):
        self.turn, self.low, self.equal, self.high, self.up, self.depth, self.size = [-1], [-1], [-1], [-1], [-1], [0], [0]

    def _new(self, turn: int, up: int, size: int) -> int:
        self.turn.append(turn)
        self.low.append(-1)
        self.equal.append(-1)
        self.high.append(-1)
        self.up.append(up)
        self.depth.append(self.depth[up] + 1)
        self.size.append(size)
        return len(self.turn) - 1

    def insert(self, ids: list[int], sizes: list[int]) -> int:
        """The node of the whole list."""
        turn, low, high, equal = self.turn, self.low, self.high, self.equal
        up = 0
        for key, size in zip(ids, sizes, strict=True):
            side, at, node = equal, up, equal[up]
            while node >= 0 and turn[node] != key:
                side, at = (low, node) if key < turn[node] else (high, node)
                node = side[at]
            if node < 0:
                node = side[at] = self._new(key, up, size)
            up = node
        return up

    def insert_all(self, lists: list[list[int]], sizes: list[list[int]]) -> list[int]:
        """Sorted lists, the median before both halves; the node of each."""
        nodes, waiting = [0] * len(lists), [(0, len(lists))]
        while waiting:
            a, b = waiting.pop()
            if a < b:
                middle = (a + b) // 2
                nodes[middle] = self.insert(lists[middle], sizes[middle])
                waiting += [(a, middle), (middle + 1, b)]
        return nodes

    def walk(self) -> list[int]:
        """All nodes, each after its parent in the trie."""
        found, waiting = [], [0]
        while waiting:
            node = waiting.pop()
            found.append(node)
            waiting += [x for x in (self.low[node], self.equal[node], self.high[node]) if x >= 0]
        return found

    def path(self, node: int) -> list[int]:
        found = [node]
        while node:
            node = self.up[node]
            found.append(node)
        return found[::-1]


def _child_key(key: str, turn: int) -> str:
    return hashlib.blake2b(f"{key}/{turn}".encode(), digest_size=16).hexdigest()


def _trie_rows(rows: list[dict], k: str, seg: int, before: int, first: bool, last: bool) -> Iterator[tuple]:
    """Nodes of one trie of a shard; ``first`` and ``last``: it may go on in the shard before or after."""
    tree = Tree()
    stops = tree.insert_all([r["ids"] for r in rows], [r["sizes"] for r in rows])
    count = len(tree.turn)
    n, children, leaves, saved = ([0] * count for _ in range(4))
    conv: list[int | None] = [None] * count
    ends: list[str | None] = [None] * count
    alias: list[str | None] = [None] * count
    for node, r in zip(stops, rows, strict=True):
        n[node], conv[node], ends[node], alias[node] = r["n"], r["conv"], r["ends"], r["following"]
        children[node], leaves[node], saved[node] = r["h_children"], r["h_leaves"], r["h_saved"]
    keys, paths = {0: f"root{k}"}, {0: []}
    for node in ([stops[0]] if first else []) + ([stops[-1]] if last else []):
        for up, down in zip((path := tree.path(node)), path[1:], strict=False):
            keys[down], paths[down] = _child_key(keys[up], tree.turn[down]), [*paths[up], keys[up]]
    order = tree.walk()
    for node in reversed(order):
        up = tree.up[node]
        if node not in keys:
            leaves[node] += children[node] == 0
            saved[node] += (n[node] - 1) * tree.size[node]
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
        if up >= 0:
            n[up] += n[node]
            conv[up] = conv[node] if conv[up] is None else min(conv[up], conv[node])
    for node in order:
        up = tree.up[node]
        known = up >= 0 and up not in keys
        yield (
            node in keys, keys.get(node), keys.get(up), conv[up] if known else None, f"root{alias[node]}" if alias[node] else None,
            paths.get(node), conv[node], before + tree.depth[node], n[node], children[node], leaves[node], saved[node], tree.size[node], ends[node],
        )


def _shard_rows(rows: list[dict], seg: int, before: int) -> pa.RecordBatch:
    out: list[tuple] = []
    i = 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j]["k"] == rows[i]["k"]:
            j += 1
        out += _trie_rows(rows[i:j], rows[i]["k"], seg, before, i == 0, j == len(rows))
        i = j
    names = [f.split()[0] for f in _RAW.split(", ")]
    kinds = {"boolean": pa.bool_(), "string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
    types = [kinds[f.split()[1]] for f in _RAW.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def shard_nodes(lists: DataFrame, seg: int, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Closed nodes and parts of boundary nodes of the tries of one segment number."""
    ordered = lists.repartitionByRange("k", "ids").sortWithinPartitions("k", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        turns = 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                turns += len(row["ids"]) + 1
                if turns >= shard_turns:
                    yield _shard_rows(held, seg, seg * segment)
                    held, turns = [], 0
        if held:
            yield _shard_rows(held, seg, seg * segment)

    return ordered.mapInArrow(run, _RAW)


def merged(parts: DataFrame) -> DataFrame:
    """Boundary nodes, each once: parts are added, and every node's own share goes to itself and all above it."""
    once = parts.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.max("alias").alias("alias"), F.first("path").alias("path"), F.min("conv").alias("conv"),
        F.max("depth").alias("depth"), F.sum("n").alias("n"), F.sum("children").alias("closed"), F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"), F.max("size").alias("size"), F.max("ends").alias("ends"),
    )
    once = stage(once, "boundary-nodes")
    below = once.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("opened"))
    nodes = once.join(below, "key", "left").withColumn("children", F.col("closed") + F.coalesce("opened", F.lit(0)))
    nodes = nodes.withColumn("leaves", F.col("leaves") + (F.col("children") == 0).cast("long"))
    nodes = nodes.withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("size"))
    share = nodes.select(F.explode(F.concat("path", F.array("key"))).alias("key"), "leaves", "saved")
    totals = share.groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return nodes.drop("leaves", "saved", "path", "closed", "opened").join(totals, "key")


def end_hashes(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """``ends, ends_sha256`` of ``ends, conv_id``: the hash of each group's ids in ascending order."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys, ids = batch.column("ends"), batch.column("conv_id").to_numpy()
            code = keys.dictionary_encode().indices.to_numpy()
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            first = np.unique(np.concatenate([first, np.arange(0, len(ids), max(1, piece // 20))]))
            texts = [",".join(map(str, x.tolist())) for x in np.split(ids, first[1:])]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(first)), pa.array(ids[first]), pa.array(texts)], ["ends", "least", "ids"])

    ordered = rows.select("ends", "conv_id").repartitionByRange("ends", "conv_id").sortWithinPartitions("ends", "conv_id")
    cut = ordered.mapInArrow(pieces, "ends string, least long, ids string")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            done: list[tuple[str, str]] = []
            for key, ids in zip(batch.column("ends").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key == held:
                    state.update(b"," + ids.encode())
                    continue
                if held is not None:
                    done.append((held, state.hexdigest()))
                held, state = key, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["ends", "ends_sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([state.hexdigest()])], ["ends", "ends_sha256"])

    return sorted_tiles(cut, "ends", then=("least",)).mapInArrow(hashes, "ends string, ends_sha256 string")


def prefix_nodes(conversations: DataFrame, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations."""
    turns, totals = rebuilt(encoded_turns(conversations))
    rows = stage(segments(turns, totals, segment).withColumn("ends", _hashed("seg", "k", "ids")), "turn-lists")
    levels = rows.agg(F.max("seg").alias("most")).first()["most"]
    closed, opened, below = [], [], None
    for seg in range(levels or 0, -1, -1):
        lists = rows.where(F.col("seg") == seg).groupBy("k", "ids", "sizes").agg(
            F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.max(F.when(F.col("last"), F.col("ends"))).alias("ends"), F.max("following").alias("following")
        )
        if below is not None:
            lists = lists.join(below, "following", "left")
        hung = [F.coalesce(F.col(c) if below is not None else F.lit(None), F.lit(0)).cast("long").alias(c) for c in ("h_children", "h_leaves", "h_saved")]
        parts = stage(shard_nodes(lists.select("k", "ids", "sizes", "n", "conv", "ends", "following", *hung), seg, segment, shard_turns), "trie-nodes")
        whole = stage(merged(parts.where("open")), "boundary-nodes")
        tops = whole.where("parent_key IS NULL")
        below = tops.select(
            F.substring("key", 5, 1 << 30).alias("following"), F.col("children").alias("h_children"), F.col("leaves").alias("h_leaves"), F.col("saved").alias("h_saved")
        )
        names = ["key", "parent_key", "parent_conv", "alias", "conv", "depth", "n", "children", "leaves", "saved", "ends"]
        own = whole if seg == 0 else whole.where("parent_key IS NOT NULL")
        closed.append(parts.where("NOT open").select(names))
        opened.append(own.withColumn("parent_conv", F.lit(None).cast("long")).select(names))
    every = closed + opened
    nodes, named = every[0], opened[0].select("key", "conv")
    for more in every[1:]:
        nodes = nodes.unionByName(more)
    for more in opened[1:]:
        named = named.unionByName(more.select("key", "conv"))
    named = named.unionByName(nodes.where("alias IS NOT NULL").select(F.col("alias").alias("key"), "conv"))
    parents = named.select(F.col("key").alias("parent_key"), F.col("conv").alias("found"))
    # Rows without a key to look up stay out of the joins, where they would all meet in one task.
    below_open = nodes.where("parent_key IS NOT NULL").join(parents, "parent_key").withColumn("parent_conv", F.col("found")).drop("found")
    nodes = nodes.where("parent_key IS NULL").unionByName(below_open)
    hashes = end_hashes(rows.where("last"))
    ended = nodes.where("ends IS NOT NULL").join(hashes, "ends")
    passed = nodes.where("ends IS NULL").withColumn("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return ended.unionByName(passed).select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent_conv").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        "ends_sha256",
    )

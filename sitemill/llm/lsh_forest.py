"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Documents are sets of word shingles.  Equal word sequences are one class, and classes are compared:

1. Every class gets ``TREES * LEVELS`` min-hashes; each run of ``LEVELS`` of them is its path in one prefix
   trie.  ``depth`` is the shortest prefix worth searching: at it, pairs at the similarity threshold meet in
   some tree with the target recall.  Prefixes that at most ``NODE_BLOCK`` classes share are searched there.
   Where more share it, every class starts from its whole path in that tree and shortens its matched
   prefixes one level at a time, the one that adds fewest classes first, until the target recall is reached
   (``shortened``); classes that share the prefix it stops at are compared with it.
2. Within a node, rows sorted along the trie are compared by their whole signatures; pairs whose estimate
   lies clearly below the threshold are dropped, the others are only used to connect classes.
3. Connected classes form clusters, and within a cluster the true similarity of every pair is computed from
   the shingle sets.  A pair missed by the forest is still found if a chain of others connects it.

Large nodes and clusters are cut into tiles of bounded size; in a large node only tiles with a class that
stopped there are made.  No pair is written out: tiles give link counts per class and spanning edges.

Defined results: a text of fewer words than ``WIDTH`` but some is one shingle of all its words; a text
without words (null, empty, signs only) links with nothing and is a class of its own.  Rows with equal
words link with each other.  Classes are named by the smallest doc_id, null only if all are null.
``representatives`` also takes equal texts without words as copies, since an earlier stage may empty them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitemill.llm import words as W
from sitemill.llm.components import components, sorted_tiles, spanning, spread_pairs, whole_groups
from sitemill.llm.frames import cut
from sitemill.workspace import stage

WIDTH = 5
#: Similarity as a fraction, so that it is compared in whole numbers.
NUMERATOR, DENOMINATOR = 4, 5
TREES, LEVELS, TARGET_RECALL = 16, 8, 0.999
#: Standard errors below the threshold at which an estimate still counts as a candidate.
SLACK = 4.0
NODE_BLOCK, CLUSTER_BLOCK = 512, 256
#: Shingles of one block of a cluster, about.
BLOCK_SHINGLES = 1 << 20

_rng = np.random.default_rng(20240617)
_FACTORS = _rng.integers(1, 1 << 63, TREES * LEVELS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(0, 1 << 63, TREES * LEVELS, dtype=np.uint64)


def depth(threshold: float, trees: int = TREES, levels: int = LEVELS, recall: float = TARGET_RECALL) -> int:
    """The longest prefix at which pairs of the threshold meet in some tree with the target recall."""
    d = levels
    while d > 1 and 1 - (1 - threshold**d) ** trees < recall:
        d -= 1
    return d


def shortened(sizes: np.ndarray, shortest: int, block: int, threshold: float, recall: float = TARGET_RECALL) -> np.ndarray:
    """The depth per class and tree at which the class is searched.

    ``sizes[c, t, k]`` classes share the first ``shortest + k`` levels of class c in tree t.  Two chances to
    miss a partner must fall to ``1 - recall``: that of a partner anywhere, and that of one which lies in
    the large nodes themselves, and so shares ``shortest`` levels there already and meets nowhere else.  The
    second keeps the order by size from favouring trees in which such a partner is not met at all.
    """
    levels = np.arange(shortest, sizes.shape[2] + shortest)
    large = sizes[:, :, 0] > block
    at = np.where(large, len(levels) - 1, 0)
    anywhere = np.log1p(-(threshold**levels))
    with np.errstate(divide="ignore"):
        within = np.log1p(-(threshold ** (levels - shortest)))
    left = 1 - recall
    never = (1 - threshold**shortest) ** sizes.shape[1]
    goals = np.log(left), np.log(left - never) if left > never else -np.inf
    while True:
        short = anywhere[at].sum(axis=1) > goals[0]
        short |= large.any(axis=1) & (np.where(large, within[at], 0).sum(axis=1) > goals[1])
        rows = np.flatnonzero(short & (at > 0).any(axis=1))
        if len(rows) == 0:
            return at + shortest
        now = np.take_along_axis(sizes[rows], at[rows][:, :, None], axis=2)[:, :, 0]
        then = np.take_along_axis(sizes[rows], np.maximum(at[rows] - 1, 0)[:, :, None], axis=2)[:, :, 0]
        added = np.where(at[rows] > 0, then - now, np.iinfo(np.int64).max)
        at[rows, added.argmin(axis=1)] -= 1


def shingle_sets(texts: pa.Array) -> tuple[W.Words, np.ndarray, np.ndarray]:
    """Words of a batch, the shingle hashes of all texts, and where each text's shingles begin."""
    words = W.words_of(texts)
    keys, at = W.windows(words.hashes, words.first, WIDTH)
    begin = np.searchsorted(at, words.first)
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < WIDTH))
    if len(short):
        own = np.empty(len(short), np.uint64)
        for k, d in enumerate(short.tolist()):
            part = words.hashes[words.first[d] : words.first[d + 1]]
            own[k] = W.windows(part, np.array([0, len(part)]), len(part))[0][0]
        keys = np.insert(keys, begin[short], own)
        begin = begin + np.concatenate([[0], np.cumsum((counts > 0) & (counts < WIDTH))])
    return words, keys, begin


def signature(keys: np.ndarray) -> np.ndarray:
    """The top 16 bits of each min-hash of one shingle set."""
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(keys), 4096):
        part = keys[i : i + 4096]
        for k in range(0, len(_FACTORS), 16):
            hashed = _FACTORS[k : k + 16, None] * part + _OFFSETS[k : k + 16, None]
            np.minimum(low[k : k + 16], hashed.min(axis=1), out=low[k : k + 16])
    return (W.mix(low) >> np.uint64(48)).astype("<u2")


def sequence_hash(hashes: np.ndarray) -> int:
    """A hash of a whole word sequence."""
    place = W.mix(np.arange(len(hashes), dtype=np.uint64) + np.uint64(len(hashes) << 32))
    return int(W.mix(np.array([(W.mix(hashes ^ place)).sum(dtype=np.uint64)]))[0].astype(np.int64))


def signatures(docs: DataFrame) -> DataFrame:
    """``rk, doc_id, node, shingles, sig, blank``: a key of the row, its class, and the class's min-hashes.

    Rows without words have a null node, and ``blank`` is the hash of their text, null for a null text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in cut(batch.column(2)):
                words, keys, begin = shingle_sets(batch.column(2).slice(i, j - i))
                nodes, sizes, sigs = [], [], []
                for d in range(j - i):
                    if begin[d] == begin[d + 1]:
                        nodes.append(None), sizes.append(0), sigs.append(None)
                        continue
                    nodes.append(sequence_hash(words.hashes[words.first[d] : words.first[d + 1]]))
                    sizes.append(int(begin[d + 1] - begin[d]))
                    sigs.append(signature(keys[begin[d] : begin[d + 1]]).tobytes())
                kept = batch.slice(i, j - i)
                blank = pc.if_else(pa.array([x is None for x in nodes]), kept.column(3), None)
                yield pa.RecordBatch.from_arrays(
                    [kept.column(0), kept.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary()), blank],
                    ["rk", "doc_id", "node", "shingles", "sig", "blank"],
                )

    whole = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("rk"), F.col("doc_id").cast("long").alias("doc_id"), "text", whole.alias("whole"))
    return keyed.mapInArrow(run, "rk long, doc_id long, node long, shingles int, sig binary, blank long")


def _signed(batch: pa.Table) -> np.ndarray:
    column = batch.column("sig").combine_chunks()
    places = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], "<u2")
    return data[places[0] // 2 : places[-1] // 2].reshape(len(column), TREES * LEVELS)


def _connect(nodes: np.ndarray, sigs: np.ndarray, starts: np.ndarray, least: int):
    """Pairs of nodes that connect all candidates of each tile."""
    sizes = np.diff(starts)
    group = np.repeat(np.arange(len(sizes)), sizes)
    small = sizes[group] <= 24
    for shift in range(1, 24):
        at = np.flatnonzero(small[:-shift] & (group[shift:] == group[:-shift])) if len(group) > shift else ()
        if len(at) == 0:
            break
        close = (sigs[at] == sigs[at + shift]).sum(axis=1) >= least
        yield nodes[at[close]], nodes[at[close] + shift]
    for g in np.flatnonzero(sizes > 24):
        rows = np.arange(starts[g], starts[g + 1])
        unseen = np.ones(len(rows), bool)
        for seed in np.argsort(nodes[rows]).tolist():  # the same seeds in every tree, so that edges coincide
            if not unseen[seed]:
                continue
            unseen[seed] = False
            front = [seed]
            while front:
                i = front.pop()
                rest = np.flatnonzero(unseen)
                if len(rest) == 0:
                    break
                near = rest[(sigs[rows[rest]] == sigs[rows[i]]).sum(axis=1) >= least]
                unseen[near] = False
                front.extend(near.tolist())
                yield np.full(len(near), nodes[rows[i]]), nodes[rows[near]]


def prefix_keys(sigs: np.ndarray, shortest: int) -> np.ndarray:
    """``keys[row, tree, k]``: a hash of the tree and of its first ``shortest + k`` levels."""
    paths = sigs.reshape(-1, TREES, LEVELS).astype(np.uint64)
    chain = np.zeros(paths.shape[:2], np.uint64)
    keys = np.empty((*paths.shape[:2], LEVELS - shortest + 1), np.int64)
    for k in range(LEVELS):
        chain = W.mix(chain ^ (paths[:, :, k] + np.uint64(k << 20)))
        if k + 1 >= shortest:
            keys[:, :, k + 1 - shortest] = W.mix(chain + np.arange(TREES, dtype=np.uint64)).astype(np.int64)
    return keys


def searched(large: DataFrame, threshold: float, block: int) -> DataFrame:
    """``key, node, n, asks, asked`` for classes in large nodes: the prefixes they are searched at, or found at.

    ``large`` has ``node, tree, sig``.  A class is found at every prefix up to the one it stops at
    (``asks``); beyond that it meets its partners at its own prefix already.
    """
    d = depth(threshold)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if rows.num_rows == 0:
                continue
            trees = rows.column("tree").to_numpy()
            keys = prefix_keys(_signed(rows), d)[np.arange(len(trees)), trees]
            steps = keys.shape[1]
            columns = [rows.column("node").to_numpy().repeat(steps), trees.repeat(steps), np.tile(np.arange(steps, dtype=np.int32), len(trees)), keys.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "tree", "step", "key"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefixes")
            row = pc.list_parent_indices(lists).to_numpy()
            tree, step, key, n = (x.to_numpy() for x in lists.flatten().flatten())
            sizes = np.ones((batch.num_rows, TREES, LEVELS - d + 1), np.int64)
            sizes[row, tree, step] = n
            stop = shortened(sizes, d, block, threshold)[row, tree] - d
            kept = (n > 1) & (step <= stop)
            columns = [key[kept], batch.column("node").to_numpy()[row[kept]], (step == stop)[kept]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "asks"])

    paths = stage(large.mapInArrow(prefixes, "node long, tree int, step int, key long"), "trie-prefixes")
    sized = paths.join(paths.groupBy("key").agg(F.count("*").alias("n")), "key")
    per_class = sized.groupBy("node").agg(F.collect_list(F.struct("tree", "step", "key", "n")).alias("prefixes"))
    placed = stage(per_class.mapInArrow(choose, "key long, node long, asks boolean"), "forest-places")
    nodes = placed.groupBy("key").agg(F.count("*").alias("n"), F.count_if("asks").alias("asked"))
    return placed.join(nodes.where("n > 1 AND asked > 0"), "key").select("key", "node", "n", "asks", "asked")


def asked_tiles(rows: DataFrame, block: int) -> DataFrame:
    """Add ``ti, tj``: tiles in which every class that asks meets all classes of its node.

    A node of up to ``block`` classes is one tile.  Else the classes that ask and the others are hashed into
    blocks of their own, and two blocks make a tile if one of them asks.
    """
    one = F.col("n") <= block
    asking = F.when(one, 1).otherwise(F.ceil(F.col("asked") / block)).cast("int")
    others = F.when(one, 0).otherwise(F.ceil((F.col("n") - F.col("asked")) / block)).cast("int")
    spot = F.xxhash64("node")
    own = F.when(one, 0).when(F.col("asks"), F.pmod(spot, F.col("_a"))).otherwise(F.col("_a") + F.pmod(spot, F.greatest("_o", F.lit(1))))
    last = F.when(one | F.col("asks"), F.col("_a") + F.col("_o")).otherwise(F.col("_a")) - 1
    placed = rows.withColumns({"_a": asking, "_o": others}).withColumn("_i", own.cast("int"))
    exploded = placed.withColumn("_j", F.explode(F.sequence(F.lit(0), last)))
    return exploded.select(*rows.columns, F.least("_i", "_j").alias("ti"), F.greatest("_i", "_j").alias("tj"))


def candidate_edges(classes: DataFrame, threshold: float = NUMERATOR / DENOMINATOR) -> DataFrame:
    """``a, b``: edges that connect all classes which meet in a tree and look similar enough."""
    d, block = depth(threshold), NODE_BLOCK
    hashes = TREES * LEVELS
    least = int(np.floor(hashes * (threshold - SLACK * np.sqrt(threshold * (1 - threshold) / hashes))))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if rows.num_rows == 0:
                continue
            keys = prefix_keys(_signed(rows), d)[:, :, 0]
            nodes = np.repeat(rows.column("node").to_numpy(), TREES)
            trees = np.tile(np.arange(TREES, dtype=np.int32), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes), pa.array(trees)], ["key", "node", "tree"])

    sigs = classes.select("node", "sig")
    places = stage(sigs.mapInArrow(paths, "key long, node long, tree int"), "trie-nodes")
    shared = places.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = places.join(shared, "key")
    small = met.where(F.col("n") <= block).select("key", "node", "n", F.lit(True).alias("asks"), F.col("n").alias("asked"))
    large = met.where(F.col("n") > block).select("node", "tree").join(sigs, "node")
    found = small.unionByName(searched(large, threshold, block)).join(sigs, "node")
    placed = asked_tiles(found, block).select("key", "ti", "tj", "node", "sig")
    tiles = sorted_tiles(placed, "key", "ti", "tj", then=("sig",))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["key", "ti", "tj"]):
            found = list(_connect(rows.column("node").to_numpy(), _signed(rows), starts, least))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return tiles.mapInArrow(link, "a long, b long")


def exact_links(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets are similar enough, as a symmetric matrix without its diagonal."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    shared = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    row, column = row[keep], shared[column[keep]]
    common = np.zeros((n, n), np.float32)
    width = int(shared[-1]) + 1
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, width, 4096):
        i, j = np.searchsorted(column, [low, low + 4096])
        part = np.zeros((n, min(4096, width - low)), np.float32)
        part[row[i:j], column[i:j] - low] = 1
        common += part @ part.T
    common = np.rint(common).astype(np.int64)
    linked = common * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (size[:, None] + size[None, :])
    np.fill_diagonal(linked, False)
    return linked


def verified(members: DataFrame) -> DataFrame:
    """``node, links, toward`` per class and tile: copies it links with, and a class it is connected to.

    ``members`` has ``cluster, blocks, node, copies, text`` with one row per class.
    """
    placed = spread_pairs(members.withColumn("_n", F.col("blocks") * CLUSTER_BLOCK), "_n", CLUSTER_BLOCK, "node")
    tiles = sorted_tiles(placed.select("cluster", "ti", "tj", "side", "node", "copies", "text"), "cluster", "ti", "tj")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["cluster", "ti", "tj"]):
            nodes, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
            sides = rows.column("side").to_numpy()
            same = rows.column("ti").to_numpy() == rows.column("tj").to_numpy()
            texts = rows.column("text").combine_chunks()
            out: list[tuple] = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                sets = []
                for i, j in cut(texts.slice(a, b - a)):
                    _, keys, begin = shingle_sets(texts.slice(a + i, j - i))
                    sets += [W.distinct(keys[begin[d] : begin[d + 1]]) for d in range(j - i)]
                linked = exact_links(sets)
                if not same[a]:
                    linked &= sides[a:b, None] != sides[None, a:b]
                root = spanning(b - a, linked)
                counts = linked @ copies[a:b]
                some = np.flatnonzero(counts)
                out.append((nodes[a:b][some], counts[some], nodes[a:b][root[some]]))
            if out:
                columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["node", "links", "toward"])

    return tiles.mapInArrow(run, "node long, links long, toward long")


def join(docs: DataFrame) -> DataFrame:
    """``rk, doc_id, class_id, n_links, stays, alone, blank`` per row; ``rk`` is ``xxhash64(doc_id, text)`` of the row.

    ``stays`` is true for the row that its group of connected classes is represented by, and for rows
    without words.
    """
    rows = stage(signatures(docs), "signatures")
    named = rows.where("node IS NOT NULL")
    classes = named.groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rk")).alias("first"),
        F.count("*").alias("copies"),
        F.max("shingles").alias("shingles"),
        F.min("sig").alias("sig"),
    )
    classes = stage(classes, "classes")
    clusters = components(candidate_edges(classes))
    sized = classes.select("node", "first.rk", "copies", "shingles").join(clusters, "node")
    need = F.greatest(F.ceil(F.count("*") / F.lit(CLUSTER_BLOCK)), F.ceil(F.sum("shingles") / F.lit(BLOCK_SHINGLES))).cast("int")
    blocks = sized.groupBy("component").agg(need.alias("blocks"))
    chosen = sized.join(blocks, "component").select("rk", F.col("component").alias("cluster"), "blocks", "node", "copies")
    texts = docs.select(F.xxhash64("doc_id", "text").alias("rk"), "text")
    members = texts.join(chosen, "rk").dropDuplicates(["node"])
    found = stage(verified(members), "links")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("toward").alias("b")))
    known = classes.select("node", "first", "copies").join(groups, "node", "left").join(linked, "node", "left")
    known = known.withColumn("group", F.coalesce("component", "node"))
    leader = known.groupBy("group").agg(F.min("first").alias("leader"))
    per_class = known.join(leader, "group").select(
        "node",
        F.col("leader.doc_id").alias("class_id"),
        F.col("leader.rk").alias("leader_rk"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    alone = F.col("node").isNull()
    return (
        rows.select("rk", "doc_id", "node", "blank")
        .join(per_class, "node", "left")
        .select(
            "rk",
            "doc_id",
            F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            (alone | (F.col("rk") == F.col("leader_rk"))).alias("stays"),
            alone.alias("alone"),
            "blank",
        )
    )


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, with all its columns: the one with the smallest doc_id.

    Equal texts without words are such a group too, so the empty texts that line deduplication leaves of
    copies become one.  Null texts are unknown and all stay; of rows that repeat both doc_id and text one stays.
    """
    own = F.when(F.col("blank").isNull(), F.col("rk"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rk"))
    unknown = F.bool_or(F.col("alone") & F.col("blank").isNull())
    staying = join(docs).where("stays").groupBy("blank", own.alias("own")).agg(first.alias("first"), unknown.alias("unknown"))
    staying = staying.select("first.rk", "unknown")
    packed = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("rk"))
    kept = packed.join(staying.hint("merge"), "rk")
    nth = F.row_number().over(Window.partitionBy("rk").orderBy("rk"))
    return kept.withColumn("_nth", nth).where("unknown OR _nth = 1").select("row.*")


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_links`` per document."""
    return join(docs.select("doc_id", "text")).select("doc_id", "class_id", "n_links")

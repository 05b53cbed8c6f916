"""Best-fit packing by a configuration linear program over the histogram of piece lengths.

A configuration is a multiset of lengths that fits into one sequence.  The program asks for the fewest
sequences that cover each length as often as it occurs.  It is solved by multiplicative weights on classes
of lengths (at most about a hundred, each counted at its largest length on a grid of ``UNITS``): every round
prices the classes by how little of them is covered, finds the best configuration for these prices by
dynamic programming over the capacity (a knapsack), and adds it.  Rounds go on until all classes are covered
with at most ``1 + TOLERANCE`` times the sequences of the best lower bound met, which the prices prove.
Fractional amounts are rounded along their running sum, so that amounts below one are not lost.  A planned
sequence takes the largest pieces of its classes.  The room of its last piece is filled best-fit, since
classes are counted a little too large, and so are places of classes that have run out by that; what no
planned sequence takes is packed best-fit, largest first.
Only the histogram, at most ``capacity`` numbers, is on the driver: its plan says for the i-th piece of each
length which sequence and offset it gets, so rows are numbered per length by a distributed ranking and
nothing is gathered.

Defined results: a null or empty text is one piece of the end id alone; documents longer than the capacity
are cut into full pieces and one last shorter one; an empty table gives an empty result.  Repeated rows and
null identifiers are pieces of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill.llm.frames import cut
from sitemill.llm.tokens import END_ID, VOCABULARY, encoder, with_end
from sitemill.operators.ranking import rank_within
from sitemill.workspace import stage

CAPACITY = 4096
#: Proven distance of the fractional answer from the optimum of the program over classes.
TOLERANCE = 0.05
#: Strength of the price change of a fully covered class.
LEARNING = 0.1
#: Grid of the capacity on which classes are priced, and how far sizes of large classes lie apart.
UNITS, SPACING = 512, 1.06


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and the ids themselves as little-endian binary)."""
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in cut(batch.column(1)):
                flat, begin = with_end(*encoder(vocabulary).encode(batch.column(1).slice(i, j - i)), end_id)
                size = np.diff(begin)
                each = -(-size // capacity)
                doc = np.repeat(np.arange(j - i), each)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
                start = piece * capacity
                length = np.minimum(capacity, size[doc] - start)
                raw, at = memoryview(flat.tobytes()), begin[doc] + start
                bounds = list(zip((4 * at).tolist(), (4 * (at + length)).tolist(), strict=True))
                columns = [
                    batch.column(0).take(pa.array(doc + i)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array([zlib.crc32(raw[a:b]) for a, b in bounds], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([bytes(raw[a:b]) for a, b in bounds], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_configuration(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> dict[int, int]:
    """Index of length -> copies with the largest total price that fits (lengths ascend)."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    usable = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        k = usable[room]
        value[room] = value[room - 1]
        if k:
            worth = value[room - lengths[:k]] + prices[:k]
            i = int(worth.argmax())
            if worth[i] > value[room]:
                value[room], choice[room] = worth[i], i
    found: dict[int, int] = {}
    room = capacity
    while room > 0:
        i = int(choice[room])
        if i < 0:
            room -= 1
        else:
            found[i] = found.get(i, 0) + 1
            room -= int(lengths[i])
    return found


def length_classes(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sizes of the classes in units (ascending), the class of each length, and the units of the capacity."""
    units = min(UNITS, capacity)
    grid, size = [], 1
    while size < units:
        grid.append(size)
        size = max(size + 1, int(size * SPACING))
    grid = np.array([*grid, units])
    return *np.unique(grid[np.searchsorted(grid, -(-lengths * units // capacity))], return_inverse=True), units


def fractional(
    sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int | None = None
) -> tuple[list[tuple[float, dict[int, int]]], float]:
    """Configurations with fractional amounts that cover every count, and a lower bound of any such total.

    Without ``rounds`` the total is at most ``1 + TOLERANCE`` times the bound, or as many rounds were made as
    the method needs for that in theory.
    """
    if rounds is None:
        rounds = int(np.ceil(len(sizes) * np.log(len(sizes) + 2) / TOLERANCE**2))
    weights = np.log(sizes * counts)  # the first prices are the sizes
    amounts: dict[tuple, float] = {}
    covered = np.zeros(len(sizes))
    total = bound = 0.0
    for _ in range(rounds):
        weight = np.exp(weights - weights.max())
        config = best_configuration(sizes, weight / counts, capacity)
        index = np.fromiter(config, int, len(config))
        copies = np.fromiter(config.values(), float, len(config))
        bound = max(bound, float(weight.sum() / (weight[index] / counts[index] @ copies)))
        step = float((counts[index] / copies).min())
        covered[index] += step * copies / counts[index]
        weights[index] -= LEARNING * step * copies / counts[index]
        key = tuple(sorted(config.items()))
        amounts[key] = amounts.get(key, 0.0) + step
        total += step
        if total <= (1 + TOLERANCE) * bound * covered.min():
            break
    scale = float(covered.min()) or float(covered.max())
    return [(amount / scale, dict(key)) for key, amount in amounts.items()], bound


def rounded(found: list[tuple[float, dict[int, int]]]) -> list[tuple[int, dict[int, int]]]:
    """Whole amounts with the same total but for less than one; those of the largest lengths come first."""
    out, before = [], 0.0
    for amount, config in sorted(found, key=lambda x: sorted(x[1].items(), reverse=True), reverse=True):
        times = int(before + amount) - int(before)
        before += amount
        if times:
            out.append((times, config))
    return out


def filled(
    lengths: np.ndarray, rest: np.ndarray, first: np.ndarray, capacity: int, config: dict[int, int]
) -> dict[int, int] | None:
    """The pieces of one sequence with the classes of ``config``, none if its largest class has too few in ``rest``.

    The place of the last piece, and those of smaller classes that have run out, are filled best-fit.
    Class c has the lengths from ``first[c]`` to before ``first[c + 1]``.
    """
    taken: dict[int, int] = {}
    room = capacity
    classes = sorted(config, reverse=True)
    if rest[first[classes[0]] : first[classes[0] + 1]].sum() < config[classes[0]]:
        return None
    for c in classes:
        need = config[c] - (c == classes[-1])
        for i in first[c] + np.flatnonzero(rest[first[c] : first[c + 1]])[::-1]:
            if need == 0:
                break
            n = int(min(need, rest[i]))
            taken[int(i)] = n
            need -= n
            room -= n * int(lengths[i])
    below = len(lengths)
    while room > 0:
        below = min(below, int(np.searchsorted(lengths, room, side="right")))
        while below > 0 and rest[below - 1] <= taken.get(below - 1, 0):
            below -= 1
        if below == 0:
            break
        i = below - 1
        n = int(min(rest[i] - taken.get(i, 0), room // lengths[i]))
        taken[i] = taken.get(i, 0) + n
        room -= n * int(lengths[i])
    return taken


def programmed(
    lengths: np.ndarray, rest: np.ndarray, capacity: int, rounds: int | None = None
) -> list[tuple[int, dict[int, int]]]:
    """Whole configurations by the program; the pieces they hold are taken from ``rest``."""
    sizes, of, units = length_classes(lengths, capacity)
    found, _ = fractional(sizes, np.bincount(of, rest), units, rounds)
    first = np.searchsorted(of, np.arange(len(sizes) + 1))
    out = []
    for times, config in rounded(found):
        while times > 0 and (taken := filled(lengths, rest, first, capacity, config)):
            same = int(min(times, *(rest[i] // n for i, n in taken.items())))
            for i, n in taken.items():
                rest[i] -= same * n
            out.append((same, taken))
            times -= same
    return out


def best_fit(lengths: np.ndarray, rest: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Whole configurations for the counts in ``rest``: largest length first, then the largest that fits."""
    out = []
    while rest.any():
        config: dict[int, int] = {}
        room, below = capacity, len(lengths)
        while room > 0 and below > 0:
            below = min(below, int(np.searchsorted(lengths, room, side="right")))
            there = np.flatnonzero(rest[:below])
            if len(there) == 0:
                break
            i = int(there[-1])
            config[i] = int(min(rest[i], room // lengths[i]))
            room -= config[i] * int(lengths[i])
            below = i
        times = int(min(rest[i] // n for i, n in config.items()))
        for i, n in config.items():
            rest[i] -= times * n
        out.append((times, config))
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int | None = None) -> list[tuple[int, dict[int, int]]]:
    """``(times, {length: copies})`` that hold every piece exactly once; ``rounds`` bounds those of the program."""
    if not histogram:
        return []
    lengths = np.array(sorted(histogram), np.int64)
    if lengths[0] < 1 or lengths[-1] > capacity:
        raise ValueError(f"piece lengths must be from 1 to {capacity}")
    rest = np.array([histogram[int(x)] for x in lengths], np.int64)
    below = int(np.searchsorted(lengths, capacity))
    out = programmed(lengths[:below], rest[:below], capacity, rounds) if below else []
    out += best_fit(lengths, rest, capacity)
    return [(times, {int(lengths[i]): n for i, n in config.items()}) for times, config in out]


def layout(planned: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, sequences from, copies, offset), sorted: who gets which place."""
    rows, used, sequence = [], {}, 0
    for times, config in planned:
        offset = 0
        for length, copies in sorted(config.items(), reverse=True):
            rows.append((length, used.get(length, 0), sequence, copies, offset))
            used[length] = used.get(length, 0) + times * copies
            offset += length * copies
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(found: DataFrame, capacity: int = CAPACITY, rounds: int | None = None) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; ``found`` has a ``length`` column and is read twice."""
    counted = found.groupBy("length").count().collect()  # at most ``capacity`` rows
    table = layout(plan({int(r["length"]): int(r["count"]) for r in counted}, capacity, rounds))
    order = [c for c in found.columns if c in ("doc_id", "piece", "start", "ids_crc32")]
    ranked = rank_within(found, ["length"], order, "_rank")
    held = found.sparkSession.sparkContext.broadcast(table)
    names = [*found.columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = held.value
        keys = (rows[:, 0] << 48) | rows[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy() - 1
            at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            _, first, sequence, copies, offset = rows[at].T
            columns = [batch.column(c) for c in names[:-2]]
            columns += [pa.array(sequence + (rank - first) // copies), pa.array(offset + (rank - first) % copies * length)]
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    return ranked.select(*found.columns, "_rank").mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, rounds: int | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places."""
    return pack(stage(pieces(docs, capacity, with_ids=with_ids), "pieces"), capacity, rounds)


def sequences(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id, n_tokens, ids``: the packed sequences themselves."""
    placed = pack_documents(docs, capacity, with_ids=True)
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` pieces
    grouped = placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), ordered.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return grouped.select("sequence_id", "n_tokens", joined.alias("ids"))

"""Quality scores by Bradley-Terry pairwise ranking.

Each text has a few measures of form (capitals, signs, repeated words, lengths).  A measure is a one-hot
place among the quantiles of the labelled rows, so its effect may take any shape.  Preference pairs are
one document of label 1 and one of label 0; the score is learned by the logistic loss on the difference of
their features, so that the score difference is the log odds of the preference.  The decision threshold is
the quantile of the labelled scores that leaves the labelled share of bad documents below it; scores are
shifted so that this quantile becomes ``THRESHOLD`` and squeezed into 0 to 1.

All labelled rows outside the held-out quarter are learned from.  Quantiles are read from counts of the values,
which are rounded to about a thousandth.  The rows are dealt to shards, in each of which the loss, which is convex,
is brought down; the weights are the mean of those of the shards.  A label with few rows has them in several shards.

Defined results: a null text is an empty one, which is scored like any other by its (zero) measures; equal
texts get equal scores; without labels of both kinds all scores are 1.  Repeated rows repeat their result.
Other columns pass through untouched under any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill.llm import words as W
from sitemill.llm.frames import annotate, cut
from sitemill.llm.labelled import held_out, training_labels
from sitemill.workspace import stage

THRESHOLD = 0.7
BINS, PAIRS, BATCH, STEPS, RATE, DECAY, SEED = 24, 200_000, 2048, 600, 0.05, 1e-4, 20240623
#: Labelled rows of a shard, and those of each label that it has about at least, if need be together with others.
SHARD_ROWS, LEAST = 16_000, 64
#: Bits of a measure that its counts leave out, and steps of a score that are counted apart.
LEFT_OUT, SCORE_STEPS = 42, 4096

_codes = np.arange(256)


def _bytes(text: str) -> np.ndarray:
    return np.isin(_codes, list(text.encode()))


#: Classes of bytes that are counted per text.
CLASSES = {
    "capitals": (_codes >= 65) & (_codes <= 90),
    "small": (_codes >= 97) & (_codes <= 122),
    "digits": (_codes >= 48) & (_codes <= 57),
    "beyond": _codes >= 128,
    "spaces": _bytes(" \t\r"),
    "lines": _bytes("\n"),
    "stops": _bytes(".,;:"),
    "cries": _bytes("!?"),
    "bars": _bytes("|"),
    "signs": _bytes("#$%&*@^~<>=+_/\\"),
    "quotes": _bytes("\"'()[]{}-`"),
}
MEASURES = 5 + len(CLASSES)


def measures(texts: pa.Array) -> np.ndarray:
    """One row of measures per text."""
    words = W.words_of(texts)
    data, places = W.buffers(texts)
    size, count = np.diff(places).astype(float), words.counts.astype(float)
    per_word = np.maximum(count, 1)
    counted = {}
    for name, member in CLASSES.items():
        at = np.flatnonzero(member[data])
        counted[name] = np.diff(np.searchsorted(at, places)).astype(float)
    again = np.zeros(len(words.hashes) + 1, np.int64)
    if len(words.hashes) > 1:
        np.cumsum(words.hashes[1:] == words.hashes[:-1], out=again[2:])
    low, high = words.first[:-1], words.first[1:]
    repeats = (again[high] - again[np.minimum(low + 1, high)]) / per_word
    letters = np.maximum(counted["capitals"] + counted["small"], 1)
    in_words = np.zeros(len(words.hashes) + 1, np.int64)
    np.cumsum(words.ends - words.starts, out=in_words[1:])
    mean = (in_words[high] - in_words[low]) / per_word
    columns = [np.log1p(size), np.log1p(count), mean, repeats, counted["capitals"] / letters]
    columns += [counted[name] / (per_word if name not in ("beyond", "small") else np.maximum(size, 1)) for name in CLASSES]
    return np.stack(columns, axis=1)


@dataclass
class Ranking:
    edges: np.ndarray  # (MEASURES, BINS - 1)
    weights: np.ndarray  # (MEASURES, BINS)
    cut: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return sum(self.weights[k][np.searchsorted(self.edges[k], rows[:, k])] for k in range(MEASURES))

    def score(self, rows: np.ndarray) -> np.ndarray:
        shift = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(self.raw(rows) - self.cut + shift, -40, 40)))


def order_statistics(codes: np.ndarray, counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Quantiles of the values that ``codes``, which ascend, stand for, each as often as counted."""
    values, upto = (codes << LEFT_OUT).view(np.float64), np.cumsum(counts)
    place = shares * (upto[-1] - 1)
    low = np.floor(place)
    a, b = (values[np.searchsorted(upto, x, side="right")] for x in (low, np.ceil(place)))
    return a + (b - a) * (place - low)


def value_counts(sample: DataFrame) -> DataFrame:
    """``k, y, code, n``: how often each rounded value of a measure occurs with each label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, y = _matrix(batch.column("rows")), batch.column("y").to_numpy()
            found = []
            for label in np.unique(y):
                codes = np.ascontiguousarray(rows[y == label]).view(np.int64) >> LEFT_OUT
                for k in range(MEASURES):
                    code, n = np.unique(codes[:, k], return_counts=True)
                    found.append(np.stack([np.full(len(code), k), np.full(len(code), label), code, n]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in np.concatenate(found, axis=1)], ["k", "y", "code", "n"])

    partial = sample.mapInArrow(run, "k long, y long, code long, n long")
    return partial.groupBy("k", "y", "code").agg(F.sum("n").alias("n"))


def _matrix(rows: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(rows.to_pylist()), np.float64).reshape(-1, MEASURES)


def find_edges(counts) -> np.ndarray:
    """Bounds of the bins from the counts of the values ``k, y, code, n``."""
    edges = np.zeros((MEASURES, BINS - 1))
    for k, of_measure in counts.groupby("k"):

        def at(rows, shares):
            rows = rows.groupby("code")["n"].sum().sort_index()
            return order_statistics(rows.index.to_numpy(np.int64), rows.to_numpy(np.int64), np.asarray(shares))

        edges[k] = at(of_measure, np.linspace(0, 1, BINS + 1)[1:-1])
        # ends of the range are split once more at the middle of each label, where rare extremes lie
        edges[k, -1] = max(edges[k, -1], *(at(of_measure[of_measure["y"] == label], [0.5])[0] for label in (0, 1)))
        edges[k].sort()
    return edges


def fit(rows: np.ndarray, y: np.ndarray, edges: np.ndarray) -> np.ndarray | None:
    """Weights from preference pairs of one shard; None without labels of both kinds."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if len(good) == 0 or len(bad) == 0:
        return None
    place = np.stack([np.searchsorted(edges[k], rows[:, k]) + k * BINS for k in range(MEASURES)], axis=1)
    rng = np.random.default_rng(SEED)
    theta, first, second = np.zeros((3, MEASURES * BINS))
    pairs = np.stack([rng.choice(good, PAIRS), rng.choice(bad, PAIRS)])
    for step in range(1, STEPS + 1):
        i, j = pairs[:, rng.integers(0, PAIRS, BATCH)]
        a, b = place[i], place[j]
        margin = theta[a].sum(axis=1) - theta[b].sum(axis=1)
        pull = -1 / (1 + np.exp(np.clip(margin, -40, 40))) / BATCH
        weight = np.repeat(pull, MEASURES)
        gradient = np.bincount(a.ravel(), weight, len(theta)) - np.bincount(b.ravel(), weight, len(theta)) + DECAY * theta
        first += 0.1 * (gradient - first)
        second += 0.001 * (gradient**2 - second)
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta.reshape(MEASURES, BINS)


def training_measures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``tk, y, rows``: key, label and measures of every labelled text that is not held out; copies count once.

    The measures are made before the join, so that no text is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in cut(batch.column("text")):
                kept = batch.slice(i, j - i)
                found = pa.array([r.tobytes() for r in measures(kept.column("text"))], pa.binary())
                yield pa.RecordBatch.from_arrays([kept.column("doc_id"), kept.column("tk"), found], ["doc_id", "tk", "rows"])

    known = docs.where(F.col("doc_id").isNotNull() & ~held_out())
    keyed = known.select("doc_id", F.xxhash64("text").alias("tk"), F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = keyed.mapInArrow(run, f"doc_id {kind}, tk long, rows binary")
    return measured.join(training_labels(labels, "quality"), "doc_id").select("tk", "y", "rows").distinct()


def in_shards(sample: DataFrame, total: dict[int, int], size: int) -> DataFrame:
    """The rows with their ``shard``; rows of a label with few of them are in several."""
    shards = max(1, -(-sum(total.values()) // size))
    times = {y: min(shards, -(-shards * LEAST // n)) if shards > 1 else 1 for y, n in total.items()}
    each = reduce(lambda c, y: c.when(F.col("y") == y, times[y]), list(times)[1:], F.when(F.col("y") == next(iter(times)), times[next(iter(times))]))
    first = F.pmod(F.xxhash64(F.lit(17), "tk", "y"), F.lit(shards))
    return sample.withColumn("shard", F.explode(F.transform(F.sequence(F.lit(0), each - 1), lambda i: F.pmod(first + i, F.lit(shards)))))


def learn(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS) -> Ranking | None:
    """Fit on all labelled rows outside the held-out quarter; None without labels of both kinds."""
    sample = stage(training_measures(docs, labels), "quality-rows")
    counts = value_counts(sample).toPandas()  # rounded values: as many as they have bits left, for any number of rows
    total = {int(y): int(n) for y, n in counts[counts["k"] == 0].groupby("y")["n"].sum().items()}
    if not total.get(0) or not total.get(1):
        return None
    edges = find_edges(counts)

    def fit_shard(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("tk", "ascending"), ("y", "ascending")])
        theta = fit(_matrix(rows.column("rows")), rows.column("y").to_numpy(), edges)
        found = [] if theta is None else [theta.tobytes()]
        return pa.table([pa.array([rows.column("shard")[0].as_py()] * len(found), pa.int64()), pa.array(found, pa.binary())], ["shard", "theta"])

    fitted = in_shards(sample, total, shard_rows).groupBy("shard").applyInArrow(fit_shard, "shard long, theta binary").toPandas()
    thetas = [np.frombuffer(t, np.float64).reshape(MEASURES, BINS) for t in fitted.sort_values("shard")["theta"]]
    ranking = Ranking(edges, np.mean(thetas, axis=0), 0.0)  # a few thousand bytes a shard

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = np.unique(np.floor(ranking.raw(_matrix(batch.column("rows"))) * SCORE_STEPS).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["at", "n"])

    steps = sample.mapInArrow(scored, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas().sort_values("at")
    upto, every = np.cumsum(steps["n"].to_numpy()), sum(total.values())
    k = min(every - 1, max(1, total[0]))
    low, high = (steps["at"].to_numpy()[np.searchsorted(upto, i, side="right")] for i in (k - 1, k))
    ranking.cut = float(low + high + 1) / 2 / SCORE_STEPS
    return ranking


def score(docs: DataFrame, model: Ranking | None) -> DataFrame:
    """``row, quality`` for every document; whole texts, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # MEASURES * BINS numbers

    def compute(texts: pa.Array) -> list:
        return [np.ones(len(texts)) if held.value is None else held.value.score(measures(texts))]

    return annotate(docs, compute, "quality double")


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents at or above the threshold, with all their columns."""
    return score(docs, learn(docs, labels)).where(F.col("quality") >= threshold).select("row.*")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document."""
    found = score(docs.select("doc_id", "text"), learn(docs, labels))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        held_out("row.doc_id").alias("held_out"),
        F.col("quality").alias("score"),
        (F.col("quality") >= THRESHOLD).cast("int").alias("predicted"),
    )

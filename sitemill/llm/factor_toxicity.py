"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum of term weights + sum over term pairs of <v_i, v_j>), terms being the distinct
words of a text and their beginnings of a few bytes, which cover inflected forms.  The pair part lets two
terms together weigh more than their sum, an insult with the mention of a group for instance, which no additive
model can.  Every term that is in ``LEAST`` documents of the labelled sample takes part, also one that says
nothing alone: those that the sample ties to the label most have parameters of their own, all others share
``SLOTS`` hashed ones.  So the number of parameters is fixed and no frequent term is left out.

Defined results: a null or empty text, or one of unknown terms only, gets the bias alone; equal texts get
equal scores; without labels of both kinds the score is 0 everywhere.  Repeated rows repeat their result.
Other columns pass through untouched under any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill.llm import words as W
from sitemill.llm.frames import annotate, cut
from sitemill.llm.labelled import SAMPLE_ROWS, held_out, training_texts
from sitemill.workspace import stage

TERM_BITS = 40
THRESHOLD = 0.3
#: Beginnings of words that are terms besides the words, in bytes.
STEMS = (4, 5, 6)
#: Documents of the sample a term is in, at least; hashed parameters that terms share.
LEAST, SLOTS = 20, 1 << 11
#: Log likelihood by which a term's tie to the label must exceed chance (that of about 10^7 terms is 16) for
#: parameters of its own; so many of the strongest get them.
MIN_GAIN, OWN_TERMS = 18.0, 1 << 13
FACTORS, STEPS, BATCH, RATE, DECAY, SEED = 8, 800, 256, 0.03, 2e-4, 20240613


@dataclass
class Machine:
    """``terms`` ascend; ``index`` says which parameters each of them has."""

    terms: np.ndarray
    index: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of ``n`` documents from their distinct (document, term index) entries."""
        return 1 / (1 + np.exp(-np.clip(self.margin(doc, term, n), -40, 40)))

    def margin(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(doc, self.weights[term], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[term, f]
            out += (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n)) / 2
        return out

    def entries(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, index of parameters) pairs of a batch."""
        if len(self.terms) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        words = W.words_of(texts)
        pairs = []
        for slots in slot_rows(words):
            at = np.minimum(np.searchsorted(self.terms, slots), len(self.terms) - 1)
            known = np.flatnonzero(self.terms[at] == slots)
            doc = np.searchsorted(words.first, known, side="right") - 1
            pairs.append(doc << 32 | self.index[at[known]])
        pair = W.distinct(np.concatenate(pairs))
        return pair >> 32, pair & 0xFFFFFFFF


def slot_rows(words: W.Words) -> Iterator[np.ndarray]:
    """For each word the slot of the word, then those of its beginnings (a shorter word is its own)."""
    shift = np.uint64(64 - TERM_BITS)
    yield words.hashes >> shift
    for k in STEMS:
        stems = W.hash_runs(words.data, words.starts, np.minimum(words.starts + k, words.ends))
        yield W.mix(stems + np.uint64(k)) >> shift


def term_counts(sample: DataFrame) -> DataFrame:
    """``slot, n, toxic``: documents of the sample with each term, and the toxic ones among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_numpy()
            for i, j in cut(batch.column("text")):
                words = W.words_of(batch.column("text").slice(i, j - i))
                slots = np.stack(list(slot_rows(words)))
                per_doc = [W.distinct(slots[:, words.first[d] : words.first[d + 1]].ravel()) for d in range(j - i)]
                weight = np.repeat(y[i:j], [len(x) for x in per_doc])
                slot, which = np.unique(np.concatenate(per_doc), return_inverse=True)
                columns = [slot.astype(np.int64), np.bincount(which), np.bincount(which, weight).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["slot", "n", "toxic"])

    partial = sample.select("text", "y").mapInArrow(run, "slot long, n long, toxic long")
    return partial.groupBy("slot").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def known_terms(sample: DataFrame, share: float) -> tuple[np.ndarray, np.ndarray, int]:
    """The frequent terms of the sample in ascending order, the parameters each has, and how many there are."""

    def part(seen: F.Column, chance: float) -> F.Column:
        return F.when(seen > 0, seen * F.log(seen / (F.col("n") * chance))).otherwise(0.0)

    gain = part(F.col("toxic"), share) + part(F.col("n") - F.col("toxic"), 1 - share)
    rows = term_counts(sample).where(F.col("n") >= LEAST).select("slot", gain.alias("gain")).toPandas()  # bounded as the sample is
    rows = rows.sort_values(["gain", "slot"], ascending=[False, True], kind="stable")
    own = min(OWN_TERMS, int((rows["gain"] > MIN_GAIN).sum()))
    terms = rows["slot"].to_numpy(np.uint64)
    index = (W.mix(terms) % np.uint64(SLOTS)).astype(np.int64) + own
    index[:own] = np.arange(own)
    order = np.argsort(terms)
    return terms[order], index[order], own + SLOTS


def fit(doc: np.ndarray, at: np.ndarray, y: np.ndarray, n_terms: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Adam on the logistic loss, in small batches; entries (document, index), documents ascending."""
    rng = np.random.default_rng(SEED)
    theta = np.concatenate([[np.log(y.mean() / (1 - y.mean()))], np.zeros(n_terms), rng.normal(0, 0.02, n_terms * FACTORS)])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    places = np.searchsorted(doc, np.arange(len(y) + 1))
    step = 0
    while step < STEPS:
        order = rng.permutation(len(y))
        for lot in np.array_split(order, max(1, len(order) // BATCH)):
            step += 1
            n = len(lot)
            size = places[lot + 1] - places[lot]
            row = np.repeat(np.arange(n), size)
            total = int(size.sum())
            source = np.repeat(places[lot] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)
            term = at[source]
            v = theta[1 + n_terms :].reshape(n_terms, FACTORS)
            model = Machine(at, at, theta[0], theta[1 : 1 + n_terms], v)
            error = (model.score(row, term, n) - y[lot]) / n
            gradient = np.zeros_like(theta)
            gradient[0] = error.sum()
            gradient[1 : 1 + n_terms] = np.bincount(term, error[row], n_terms)
            pull = gradient[1 + n_terms :].reshape(n_terms, FACTORS)
            for f in range(FACTORS):
                mine = v[term, f]
                sums = np.bincount(row, mine, n)
                pull[:, f] = np.bincount(term, error[row] * (sums[row] - mine), n_terms)
            gradient[1:] += DECAY * theta[1:]
            first += 0.1 * (gradient - first)
            second += 0.001 * (gradient**2 - second)
            theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return float(theta[0]), theta[1 : 1 + n_terms].copy(), theta[1 + n_terms :].reshape(n_terms, FACTORS).copy()


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> Machine:
    """Fit on a bounded sample of labelled rows outside the held-out quarter."""
    sample = stage(training_texts(docs, labels, "toxic", bound), "toxic-sample")
    total = sample.agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).first()
    blank = Machine(np.zeros(0, np.uint64), np.zeros(0, np.int64), -40.0, np.zeros(0), np.zeros((0, FACTORS)))
    if not total["n"] or total["toxic"] in (0, total["n"]):
        return blank
    blank.terms, blank.index, size = known_terms(sample, total["toxic"] / total["n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in cut(batch.column("text")):
                doc, term = blank.entries(batch.column("text").slice(i, j - i))
                places = np.searchsorted(doc, np.arange(j - i + 1))
                packed = [term[a:b].astype("<i4").tobytes() for a, b in zip(places[:-1], places[1:], strict=True)]
                kept = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([kept.column("tk"), kept.column("y"), pa.array(packed, pa.binary())], ["tk", "y", "terms"])

    keyed = sample.select(F.xxhash64("text").alias("tk"), "y", "text")
    found = keyed.mapInArrow(run, "tk long, y int, terms binary").toPandas().sort_values(["tk", "y"], kind="stable")
    lists = [np.frombuffer(b, "<i4") for b in found["terms"]]
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    fitted = fit(doc, np.concatenate(lists).astype(np.int64), found["y"].to_numpy(np.float64), size)
    return Machine(blank.terms, blank.index, *fitted)


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """``row, toxicity`` for every document; whole texts, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of parameters, and the frequent terms of a bounded sample

    def compute(texts: pa.Array) -> list:
        doc, term = held.value.entries(texts)
        return [held.value.score(doc, term, len(texts))]

    return annotate(docs, compute, "toxicity double")


def clean_documents(docs: DataFrame, labelled: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, with all their columns."""
    return score(docs, learn(labelled, labels)).where(F.col("toxicity") < threshold).select("row.*")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document."""
    found = score(docs.select("doc_id", "text"), learn(docs, labels))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        held_out("row.doc_id").alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"),
    )

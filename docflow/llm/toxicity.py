"""Toxicity: logistic regression on the words of a text with counterfactual regularisation.

Every labelled text with an identity term is rewritten with the term swapped for another one of the same
group; half the squared difference of the two margins, times ``fairness``, is added to the loss. A word that names
a group therefore can't carry the score, though it may co-occur with the label. A text's inputs are its
distinct words (letters only, A-Z lower-cased), so one insult counts the same in a long text as in a short one.

Defined results
    null or empty text   scores the intercept
    very long text       is read whole, in segments of bounded size
    null label           is not learned from; several labels of one id count as their mean, 0.5 and up is 1
    no labels            every score is 0.5
    null doc_id          is scored, never learned from, not held out
    repeated rows        each gets the same score
    other columns        are never inputs
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.arrays import NON_LETTERS, byte_rows, word_hashes
from docflow.llm.quality import is_held_out, training_rows
from docflow.runtime import materialize

#: Labelled documents that the model is fitted on at most, taken by the hash of their id.
MAX_TRAIN = 20_000
THRESHOLD = 0.5
#: A word is an input if this many training texts hold it.
LEAST_TEXTS = 4

#: Words that name a group, by the kind of group; a swap stays within a kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "queer"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "juifs"), ("musulman", "juif"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"),
)


def text_words(data: np.ndarray) -> np.ndarray:
    """Sorted distinct word hashes of a text."""
    return np.unique(word_hashes(data, lower=True, separators=NON_LETTERS))


def _hash(word: str) -> np.uint64:
    return text_words(np.frombuffer(word.encode(), dtype=np.uint8))[0]


def swaps(terms=IDENTITY_TERMS) -> dict[int, tuple[int, ...]]:
    """Hash of each identity term -> hashes of the terms that may stand in its place."""
    return {int(_hash(t)): tuple(int(_hash(o)) for o in kind if o != t) for kind in terms for t in kind}


@dataclass
class WordModel:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    intercept: float

    def score(self, words: np.ndarray) -> float:
        if not len(self.words):
            return float(1 / (1 + np.exp(-self.intercept)))
        at = np.searchsorted(self.words, words)
        at[at == len(self.words)] = 0
        margin = self.intercept + self.weights[at[self.words[at] == words]].sum()
        return float(1 / (1 + np.exp(-margin)))


class _Sparse:
    """Rows of word positions as two flat arrays."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
        self.col = np.concatenate(rows).astype(np.int32) if rows else np.empty(0, dtype=np.int32)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n)

    def transposed_times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=v[self.row], minlength=self.width)


def train(
    texts: list[np.ndarray], y: np.ndarray, fairness: float = 5.0, lasso: float = 2e-4, steps: int = 300,
    terms=IDENTITY_TERMS, least: int = LEAST_TEXTS,
) -> WordModel:
    """Fit to word-hash sets and 0/1 labels; empty or one-class labels give their prior alone."""
    prior = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    start = float(np.log(prior / (1 - prior)))
    if not len(y) or y.min() == y.max():
        return WordModel(np.empty(0, dtype=np.uint64), np.empty(0), start)
    found, often = np.unique(np.concatenate(texts), return_counts=True)
    pairs = swaps(terms)
    named = np.array(sorted(pairs), dtype=np.uint64)
    words = np.union1d(found[often >= least], named)

    def places(some: np.ndarray) -> np.ndarray:
        at = np.searchsorted(words, some)
        at[at == len(words)] = 0
        return at[words[at] == some]

    x = _Sparse([places(t) for t in texts], len(words))
    before, after = [], []
    for t in texts:
        for term in np.intersect1d(t, named):
            for other in pairs[int(term)]:
                swapped = np.union1d(np.setdiff1d(t, [term]), np.array([other], dtype=np.uint64))
                before.append(places(np.setdiff1d(t, swapped)))
                after.append(places(np.setdiff1d(swapped, t)))
    old, new = _Sparse(before, len(words)), _Sparse(after, len(words))
    m = max(len(before), 1)
    weights, intercept = np.zeros(len(words)), start
    # Classes weigh alike up to a square root, as insults are rare. Rare words get the longer steps
    # (diagonal bound of the curvature), and the absolute penalty drops words that only chance favours.
    weight = np.where(y > 0, np.sqrt((1 - prior) / prior), 1.0)
    weight /= weight.sum()
    share = x.transposed_times(weight) * 0.25
    curvature = share * np.sqrt(1 / np.maximum(share, 1e-6)) * 2 + 1e-3
    curvature += 4 * fairness / m * (old.transposed_times(np.ones(old.n)) + new.transposed_times(np.ones(new.n)))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x.times(weights) + intercept)))
        error = weight * (p - y)
        gradient = x.transposed_times(error)
        if before:
            gap = old.times(weights) - new.times(weights)
            gradient += fairness / m * (old.transposed_times(gap) - new.transposed_times(gap))
        moved = weights - gradient / curvature
        weights = np.sign(moved) * np.maximum(np.abs(moved) - lasso / curvature, 0)
        intercept -= error.sum()
    return WordModel(words, weights, float(intercept))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = MAX_TRAIN, **how) -> WordModel:
    """Train on at most ``limit`` documents; only words that several of them share reach the driver."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_words(t).view(np.int64) for t in byte_rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(rows, type=pa.list_(pa.int64()))], names=["doc_id", "y", "words"]
            )

    rows = training_rows(docs, labels, label, limit).mapInArrow(sets, "doc_id bigint, y double, words array<bigint>")
    rows = materialize(rows, "training-words")
    flat = rows.select("doc_id", "y", F.explode_outer("words").alias("word"))
    shared = flat.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= how.get("least", LEAST_TEXTS))
    terms = [int(np.uint64(w).view(np.int64)) for w in swaps(how.get("terms", IDENTITY_TERMS))]
    flat = flat.join(shared.select("word", F.lit(True).alias("shared")), "word", "left")
    kept = F.when(F.col("shared") | F.col("word").isin(terms), F.col("word"))
    rows = flat.groupBy("doc_id", "y").agg(F.array_sort(F.collect_set(kept)).alias("words")).orderBy("doc_id", "y").toArrow()
    texts = []
    for column in rows.column("words").chunks:  # flat buffers: the sample never becomes Python objects
        values, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
        texts += [np.sort(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return train(texts, rows.column("y").to_numpy(), **how)


def score(docs: DataFrame, model: WordModel) -> DataFrame:
    """``doc_id, score`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([model.score(text_words(t)) for t in byte_rows(batch.column(1))], type=pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    scored = score(docs, fit(docs, labels, "toxic", limit))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

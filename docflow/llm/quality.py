"""Quality classifier: histogram gradient-boosted trees over statistics of the whole text.

Statistics are computed in Arrow batches with numpy. Trees are grown on a bounded sample of labelled
documents from histograms of at most ``BINS`` bins per statistic, all nodes of a level at once, and are
stored as complete trees in flat arrays, so scoring walks all rows of a batch down all trees together.

Defined results
    null or empty text   has statistics of zero and gets a score like any other text
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

from docflow.llm.arrays import PrefixHash, _is, byte_rows, segments, shingle_hashes, token_bounds, word_hashes

#: Labelled documents that the model is fitted on at most, taken by the hash of their id.
MAX_TRAIN = 20_000
THRESHOLD = 0.3
BINS = 64

_NEWLINE = _is(10)
_CLASSES = np.zeros(256, dtype=np.int64)  # upper, lower, digit, white space, other scripts, stops, symbols
_CLASSES[33:48], _CLASSES[58:65], _CLASSES[91:97], _CLASSES[123:127] = 7, 7, 7, 7
_CLASSES[65:91], _CLASSES[97:123], _CLASSES[48:58], _CLASSES[128:] = 1, 2, 3, 5
_CLASSES[[9, 10, 11, 12, 13, 32]] = 4
_CLASSES[[ord(c) for c in ".,;:?'\"()-"]] = 6

FEATURES = (
    "bytes", "words", "upper", "lower", "digits", "spaces", "other_scripts", "stops", "symbols", "entropy",
    "word_length", "word_length_sd", "short_words", "symbol_words", "distinct_words", "top_word", "same_as_before",
    "distinct_pairs", "distinct_shingles", "lines", "distinct_lines", "line_length",
)


def statistics(data: np.ndarray) -> list[float]:
    """The statistics of one text."""
    n = len(data)
    counts = np.bincount(data, minlength=256)
    kinds = np.bincount(_CLASSES, weights=counts, minlength=8) / max(n, 1)
    p = counts[counts > 0] / max(n, 1)
    entropy = float(-(p * np.log2(p)).sum())
    lengths, symbols, lines, line_bytes = [], 0, [], 0
    for a, b in segments(data):
        part = data[a:b]
        starts, ends = token_bounds(part)
        lengths.append(ends - starts)
        symbols += int(np.count_nonzero(_CLASSES[part[ends - 1]] == 7)) if len(ends) else 0
    for a, b in segments(data, _NEWLINE):
        part = data[a:b]
        starts, ends = token_bounds(part, _NEWLINE)
        lines.append(PrefixHash(part).slices(starts, ends))
        line_bytes += int((ends - starts).sum())
    lengths, lines, words = np.concatenate(lengths), np.concatenate(lines), word_hashes(data)
    m = len(words)
    if not m:
        return [n, 0.0, *kinds[1:8], entropy, *[0.0] * 9, len(lines), 1.0, 0.0]
    _, often = np.unique(words, return_counts=True)
    pairs = words[1:] * np.uint64(3) + words[:-1]
    shingles = shingle_hashes(words)
    return [
        n, m, *kinds[1:8], entropy,
        lengths.mean(), lengths.std(), np.mean(lengths <= 2), symbols / m, len(often) / m, often.max() / m,
        np.mean(words[1:] == words[:-1]) if m > 1 else 0.0,
        len(np.unique(pairs)) / max(len(pairs), 1), len(np.unique(shingles)) / len(shingles),
        len(lines), len(np.unique(lines)) / max(len(lines), 1), line_bytes / max(len(lines), 1),
    ]


def feature_matrix(column: pa.Array) -> np.ndarray:
    return np.array([statistics(t) for t in byte_rows(column)], dtype=np.float64).reshape(-1, len(FEATURES))


@dataclass
class Forest:
    """Complete trees of one depth: split statistic and value of each inner node, value of each leaf."""

    base: float
    feature: np.ndarray  # trees x (2**depth - 1)
    value: np.ndarray  # rows with a statistic above it go right
    leaf: np.ndarray  # trees x 2**depth

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        depth = self.leaf.shape[1].bit_length() - 1
        rows = np.arange(len(x))
        for feature, value, leaf in zip(self.feature, self.value, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > value[at])
            margin += leaf[at - (2**depth - 1)]
        return 1 / (1 + np.exp(-margin))


def grow(x: np.ndarray, y: np.ndarray, trees=80, depth=4, rate=0.12, ridge=5.0, least=20) -> Forest:
    """Boosted trees for the logistic loss; empty or one-class labels give their prior alone."""
    prior = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    base = float(np.log(prior / (1 - prior)))
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y) or y.min() == y.max():
        trees = 0
    feature = np.zeros((trees, inner), dtype=np.int64)
    value = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    if not trees:
        return Forest(base, feature, value, leaf)
    k = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curvature = p - y, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            local = at - first
            best = np.full(nodes, 1e-6)
            for j in range(k):
                cell = local * BINS + bins[:, j]
                g, h, n = (
                    np.bincount(cell, weights=w, minlength=nodes * BINS).reshape(nodes, BINS)
                    for w in (gradient, curvature, None)
                )
                gl, hl, nl = g.cumsum(1), h.cumsum(1), n.cumsum(1)
                gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(nl < least) | (nt - nl < least)] = 0
                gain[:, len(cuts[j]) :] = 0
                top = gain.argmax(1)
                won = np.flatnonzero(gain[np.arange(nodes), top] > best)
                best[won] = gain[won, top[won]]
                feature[t, first + won] = j
                value[t, first + won] = cuts[j][top[won]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[t, at]] > value[t, at])
        at -= inner
        g = np.bincount(at, weights=gradient, minlength=leaves)
        h = np.bincount(at, weights=curvature, minlength=leaves)
        leaf[t] = -rate * g / (h + ridge)
        margin += leaf[t, at]
    return Forest(base, feature, value, leaf)


def is_held_out(id_col: str = "doc_id", folds: int = 5):
    """Documents whose CRC-32 of the id's digits is a multiple of ``folds``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """``doc_id, text, y`` of at most ``limit`` labelled documents outside the held-out fold."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out())
    rows = rows.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # at most `limit` rows: fit to broadcast
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_TRAIN) -> Forest:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_matrix(batch.column(1))
            columns = [batch.column(0), batch.column(2), *(pa.array(x[:, j]) for j in range(x.shape[1]))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "y", *FEATURES])

    schema = "doc_id bigint, y double, " + ", ".join(f"{f} double" for f in FEATURES)
    table = training_rows(docs, labels, label, limit).mapInArrow(measure, schema).toPandas()
    # An id that several rows share may bring more rows than ids; the same bound holds for them.
    table = table.sort_values(["doc_id", *FEATURES], kind="stable").head(limit)
    return grow(table[list(FEATURES)].to_numpy(), table["y"].to_numpy())


def score(docs: DataFrame, model: Forest) -> DataFrame:
    """``doc_id, score`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(feature_matrix(batch.column(1))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    scored = score(docs, fit(docs, labels, "quality", limit))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns and no shuffle."""
    model = fit(docs, labels, "quality", limit)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(feature_matrix(batch.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)

"""Whitening of embeddings with covariances found by polarisation.

Entries become integers ``x = floor(1024 * c) + 100000``, so all sums are exact. One pass sums every dimension;
a second one sums, over all rows, the square of ``n*x - S`` for every dimension and for the sum of every two
dimensions. A pair's covariance is half of what the variance of its sum exceeds the two variances by; the
differences are taken in whole numbers and rounded once, when the matrix is assembled for ``eigh``. What reaches
the driver is one row per pair of dimensions, however many vectors there are.

Defined results
    null vector     a row whose vector is null or empty, or holds a null, NaN or infinite entry, is left out
    null vec_id     is an id like any other
    lengths         vectors of another length than the most frequent one (of equally frequent ones the longest)
                    can't be compared with the rest and are left out
    huge entries    x stops at +-2**62; a ``deviation`` of more than 38 digits is null
    repeated rows   count and are returned once each
    ties            equal variances have any orthonormal basis of their space, the same for all rows
    no variance     a component whose variance is below rounding has a null ``whitened``; ``explained`` is null
                    where all vectors are equal; ``identity_error`` covers the other components, null without any
    empty table     no rows
    other columns   are not read
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.runtime import materialize

SCALE, SHIFT = 1024, 100_000
#: Components returned.
COMPONENTS = 8
#: Rows whose squares are summed in 64 bits at a time, and the bits of the lower half of a split number.
ROWS, LOW = 1024, 20
LIMIT = 1 << 62
_EXACT, _MOST = pa.decimal128(38, 0), 10**38
#: Sums leave a task as digits in this base, so that no size of entries or tables overflows their totals.
BASE = 1 << 40


def _vectors(column: pa.Array, width: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the usable rows of each length (or of ``width`` alone) and their x, a row each."""
    if pa.types.is_null(column.type):
        return
    at = column.offsets.to_numpy()
    lengths = np.where(np.asarray(column.is_valid()), np.diff(at), 0)
    entries = column.values
    values = entries.to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry becomes NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    usable = (lengths > 0) & (bad[at[1:]] == bad[at[:-1]])
    for d in np.unique(lengths[usable]) if width is None else [width]:
        rows = np.flatnonzero(usable & (lengths == d))
        for k in range(0, len(rows), ROWS):
            some = rows[k : k + ROWS]
            with np.errstate(over="ignore"):
                c = np.floor(SCALE * values[at[some][:, None] + np.arange(d)])
            x = np.clip(c, -float(LIMIT), float(LIMIT)).astype(np.int64) + SHIFT
            yield some, np.clip(x, -LIMIT, LIMIT)


def _digits(keys: dict[str, np.ndarray], numbers: list[int]) -> pa.RecordBatch:
    """Whole numbers as rows of the keys, ``place`` and ``digit``; negative numbers have negative digits."""
    rows, places, digits = [], [], []
    for k, number in enumerate(numbers):
        rest, sign, place = abs(number), -1 if number < 0 else 1, 0
        while rest or not place:
            rest, digit = divmod(rest, BASE)
            rows.append(k)
            places.append(place)
            digits.append(sign * digit)
            place += 1
    arrays = [pa.array(v[rows], pa.int32()) for v in keys.values()]
    return pa.record_batch([*arrays, pa.array(places, pa.int32()), pa.array(digits, pa.int64())], names=[*keys, "place", "digit"])


def _added(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "place").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("digit"))


def _numbers(rows: list, *keys: str) -> dict[tuple, int]:
    out: dict[tuple, int] = {}
    for r in rows:
        key = tuple(r[k] for k in keys)
        out[key] = out.get(key, 0) + int(r.digit) * BASE**r.place
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of a task by ``width, dim``; dimension -1 has the number of vectors."""
    counts: dict[int, int] = {}
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, x in _vectors(batch.column(0)):
            d = x.shape[1]
            exact = x if np.abs(x).max() < LIMIT // ROWS else x.astype(object)
            counts[d] = counts.get(d, 0) + len(x)
            totals[d] = totals.get(d, 0) + exact.sum(0).astype(object)
    for d, total in totals.items():
        keys = {"width": np.full(d + 1, d), "dim": np.arange(-1, d)}
        yield _digits(keys, [counts[d], *map(int, total)])


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n*x - S, exact: as 64-bit numbers where sums of two and their halves' products fit, else as Python's."""
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, total))
    if most < LIMIT:
        c = n * x - np.array(total, dtype=np.int64)
        if np.abs(c).max() < 1 << 44:
            return c
    return n * x.astype(object) - np.array(total, dtype=object)


def _squares(c: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of squares as (a, b, c) for a * 2**40 + b * 2**21 + c; each fits 64 bits over ``ROWS`` numbers."""
    high = c >> LOW
    low = c - (high << LOW)
    return (high * high).sum(axis), (high * low).sum(axis), (low * low).sum(axis)


def _joined(parts: tuple) -> np.ndarray:
    a, b, c = (p.astype(object) for p in parts)
    return a * (1 << 2 * LOW) + b * (1 << LOW + 1) + c


def _pair_squares(n: int, total: list[int]):
    """A task's sums of squared centred values: ``i, j, squares``, where i = j is a dimension alone."""
    d = len(total)
    firsts, seconds = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(firsts), dtype=object)
        for batch in batches:
            for _, x in _vectors(batch.column(0), d):
                c = _centred(x, n, total)
                at = 0
                for i in range(d):
                    both = c[:, i:] + c[:, i : i + 1]
                    both[:, 0] = c[:, i]
                    sums[at : at + d - i] += _joined(_squares(both, 0))
                    at += d - i
        yield _digits({"i": firsts, "j": seconds}, [int(s) for s in sums])

    return run


@dataclass
class Whitening:
    """Fitted on ``n`` vectors: sums by dimension, covariance matrix, eigenvalues (falling) and their vectors."""

    n: int
    total: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def usable(self) -> np.ndarray:
        """Components whose variance is more than rounding."""
        return self.values > len(self.total) * np.finfo(float).eps * max(self.values.max(initial=0), 0)


def covariance(squares: dict[tuple[int, int], int], d: int, n: int) -> np.ndarray:
    """Cross-covariances from the squares of dimensions and of sums of two; n times x was summed, hence n**3."""
    out = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            twice = 2 * squares[i, i] if i == j else squares[i, j] - squares[i, i] - squares[j, j]
            out[i, j] = out[j, i] = twice / (2 * n**3)  # a quotient of whole numbers is rounded once
    return out


def fit(vectors: DataFrame, vector_col: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors; None without any."""
    column = vectors.select(F.col(vector_col).alias("v"))
    sums = materialize(_added(column.mapInArrow(_sums, "width int, dim int, place int, digit bigint"), "width", "dim"), "sums")
    count = F.sum(F.col("digit").cast("double") * F.pow(F.lit(float(BASE)), "place"))
    best = sums.where("dim = -1").groupBy("width").agg(count.alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if best is None:
        return None
    d = best.width
    found = _numbers(sums.where(F.col("width") == d).collect(), "dim")
    n, total = found[-1,], [found[i,] for i in range(d)]
    rows = _added(column.mapInArrow(_pair_squares(n, total), "i int, j int, place int, digit bigint"), "i", "j")
    v = covariance(_numbers(rows.collect(), "i", "j"), d, n)  # d * (d + 1) / 2 numbers
    values, axes = np.linalg.eigh(v)
    return Whitening(n, total, v, values[::-1].copy(), axes[:, ::-1].copy())


def _projected(model: Whitening, k: int):
    """``vec_id``, the three parts of ``deviation`` and the first k whitened coordinates (null without variance)."""
    n, total, d = model.n, model.total, len(model.total)
    usable = model.usable[:k]
    scaled = model.vectors[:, :k] / np.sqrt(np.where(usable, model.values[:k], np.nan))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _vectors(batch.column(1), d):
                c = _centred(x, n, total)
                exact = [int(s) for s in _joined(_squares(c, 1))] if d <= ROWS else [int(s) for s in (c.astype(object) ** 2).sum(1)]
                flat = ((c / n).astype(np.float64) @ scaled).ravel()
                offsets = pa.array(np.arange(0, len(flat) + 1, k), pa.int32())
                coords = pa.ListArray.from_arrays(offsets, pa.array(flat, mask=np.isnan(flat)))
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(rows)), pa.array([Decimal(e) if e < _MOST else None for e in exact], _EXACT), coords],
                    names=["vec_id", "deviation", "w"],
                )

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error`` of each usable vector."""
    source = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    id_type = source.schema["vec_id"].dataType.simpleString()
    model = fit(vectors, vector_col)
    if model is None:
        return source.sparkSession.createDataFrame(
            [],
            f"vec_id {id_type}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double",
        )
    k = min(components, len(model.total))
    wide = source.mapInArrow(_projected(model, k), f"vec_id {id_type}, deviation decimal(38,0), w array<double>")
    wide = materialize(wide, "whitened")
    known = [i for i in range(k) if model.usable[i]]
    pairs = [(i, j) for i in known for j in known if i <= j]
    error = None
    if pairs:
        apart = wide.select(*(F.col("w")[i].alias(f"c{i}") for i in known))
        found = apart.agg(*(F.covar_pop(f"c{i}", f"c{j}") for i, j in pairs)).first()
        error = max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True))
    trace = float(np.trace(model.covariance))
    shares = F.array(*(F.lit(float(e) / trace if trace else None).cast("double") for e in model.values[:k]))
    rows = wide.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )

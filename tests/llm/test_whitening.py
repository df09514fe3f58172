"""Whitening against numpy over whole numbers, and its odd cases."""

import math
from fractions import Fraction

import numpy as np
import pytest
from docflow.llm import whitening
from docflow.llm.queries import QUERIES
from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, embedding array<float>"


def usable(vector):
    return bool(vector) and all(c is not None and math.isfinite(c) for c in vector)


def plain(rows):
    """x of the usable rows, their covariance as exact fractions, and n."""
    kept = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in rows if usable(v)]
    n, d = len(kept), len(kept[0][1])
    sums = [sum(x[k] for _, x in kept) for k in range(d)]
    cov = np.array(
        [[float(Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for _, x in kept), n**3)) for j in range(d)] for i in range(d)]
    )
    deviation = [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for i, x in kept]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)] for _, x in kept])
    return n, cov, deviation, centred


def vectors_of(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * 0.2
    out = [(i, [float(c) for c in v]) for i, v in enumerate(mixed.astype(np.float32))]
    out += [(400, None), (401, [None] * 12), (402, [float("nan")] * 12), (403, [float("inf")] + [0.0] * 11), (404, [])]
    out += [(None, out[3][1]), (7, out[7][1]), (405, [0.5] * 5)]  # null id, repeated row, another length
    return out


def test_equals_exact_covariance(spark, rows):
    same = [(i, v) for i, v in rows if i != 405]
    n, cov, deviation, centred = plain(same)
    values, axes = np.linalg.eigh(cov)
    model = whitening.fit(vectors_of(spark, rows))
    assert model.n == n and np.array_equal(model.covariance, cov)
    got = whitening.whiten(vectors_of(spark, rows)).collect()
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    firsts = [r for r in got if r.component == 1]
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.vec_id, int(r.deviation)) for r in firsts), key=key) == sorted(deviation, key=key)
    for k in range(8):
        e, v = values[-1 - k], axes[:, -1 - k]
        want = sorted(centred @ v / math.sqrt(e))
        mine = sorted(r.whitened for r in got if r.component == k + 1)
        turned = sorted(-x for x in mine)
        assert np.allclose(mine, want, atol=1e-9) or np.allclose(turned, want, atol=1e-9)
        shares = {r.explained for r in got if r.component == k + 1}
        assert len(shares) == 1 and shares.pop() == pytest.approx(e / np.trace(cov), rel=1e-9)
    assert {r.identity_error for r in got}.pop() < 1e-9


def test_polarisation_alone_finds_the_matrix():
    rng = np.random.default_rng(1)
    x = rng.integers(-5000, 5000, (50, 6))
    n, sums = len(x), x.sum(0).tolist()
    c = whitening._centred(x, n, sums)
    squares = {(i, j): int(((c[:, i] + c[:, j] if i != j else c[:, i]) ** 2).sum()) for i in range(6) for j in range(i, 6)}
    assert np.allclose(whitening.covariance(squares, 6, n), np.cov(x.T, bias=True), rtol=1e-12)


@pytest.mark.parametrize("size", [1, 2**10, 2**30, 2**50])
def test_squares_are_exact_at_any_size(size):
    rng = np.random.default_rng(2)
    x = rng.integers(-size, size + 1, (1000, 3))
    sums = [sum(map(int, x[:, k])) for k in range(3)]
    c = whitening._centred(x, 1000, sums)
    want = [sum((1000 * int(v) - sums[k]) ** 2 for v in x[:, k]) for k in range(3)]
    assert [int(s) for s in whitening._joined(whitening._squares(c, 0))] == want


def test_no_variance_and_few_dimensions(spark):
    got = whitening.whiten(vectors_of(spark, [(i, [0.25, -1.0]) for i in range(4)])).collect()
    assert len(got) == 8 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in got)
    got = whitening.whiten(vectors_of(spark, [(i, [float(i), 1.0]) for i in range(4)])).collect()
    by = {k: [r for r in got if r.component == k] for k in (1, 2)}
    assert all(r.whitened is not None and r.explained == pytest.approx(1) and r.identity_error < 1e-9 for r in by[1])
    assert all(r.whitened is None and abs(r.explained) < 1e-9 for r in by[2])


def test_odd_tables(spark):
    empty = vectors_of(spark, [])
    assert whitening.whiten(empty).collect() == [] and whitening.whiten(vectors_of(spark, [(1, None), (2, [])])).collect() == []
    huge = whitening.whiten(vectors_of(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 0.5])])).collect()
    assert len(huge) == 6 and all(r.whitened is not None or r.component == 2 for r in huge)
    clash = vectors_of(spark, [(i, [float(i), float(i * i % 5)]) for i in range(9)])
    for c in ("w", "v", "n", "component", "deviation", "dim", "place"):
        clash = clash.withColumn(c, F.lit("x"))
    assert len(whitening.whiten(clash).collect()) == 18
    doubles = vectors_of(spark, [(i, [float(i), 1e307 * (i % 2)]) for i in range(4)], "vec_id bigint, embedding array<double>")
    assert whitening.whiten(doubles).count() == 8


def test_query_keeps_every_row(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op11_whitening"](spark, sf).collect()
    n, cov, deviation, _ = plain([tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()])
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 8) == sorted(deviation)
    assert max(r.identity_error for r in got) < 1e-4 and sorted({r.component for r in got}) == list(range(1, 9))
    shares = sorted({r.explained for r in got}, reverse=True)
    assert np.allclose(shares, np.linalg.eigvalsh(cov)[::-1][:8] / np.trace(cov), rtol=1e-6)

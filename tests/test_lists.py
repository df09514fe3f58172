"""Inverted lists against brute force, and how little of clustered vectors a query reads."""

import numpy as np
import pytest

from docflow.operators import lists

CORPUS, QUERIES = "chunk_id bigint, source_type string, vector array<float>", "query_id bigint, vector array<float>"


def tables(spark, n, m, spread, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8)) * 10
    c = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 8)) * spread
    q = centres[rng.integers(0, 12, m)] + rng.normal(size=(m, 8)) * spread
    c[5] = c[6] = c[7]  # ties
    corpus = [(i, "web" if i % 3 else "docx", [float(x) for x in v]) for i, v in enumerate(c)]
    queries = [(i, [float(x) for x in v]) for i, v in enumerate(q)]
    return corpus, queries, spark.createDataFrame(corpus, CORPUS), spark.createDataFrame(queries, QUERIES)


def nearest(corpus, queries, ks):
    out = set()
    for qid, q in queries:
        for kind, k in ks.items():
            d = [(float(((np.float32(q).astype(float) - np.float32(v).astype(float)) ** 2).sum()), i) for i, s, v in corpus if s == kind]
            out |= {(qid, kind, r + 1, i) for r, (_, i) in enumerate(sorted((round(x, 6), i) for x, i in d)[:k])}
    return out


@pytest.mark.parametrize("spread,part,slice_", [(0.3, 4096, 4096), (30.0, 20, 3)])
def test_equals_brute_force(spark, monkeypatch, spread, part, slice_):
    """Clustered and unclustered vectors; small parts and slices cut every list."""
    monkeypatch.setattr(lists, "PART", part)
    monkeypatch.setattr(lists, "SLICE", slice_)
    corpus, queries, c, q = tables(spark, 400, 25, spread)
    ks = {"web": 5, "docx": 3}
    got = lists.search_lists(lists.build_index(c, 12), q, ks).collect()
    assert {(r.query_id, r.source_type, r["rank"], r.chunk_id) for r in got} == nearest(corpus, queries, ks)


def test_clusters_are_left_out(spark):
    _, _, c, q = tables(spark, 600, 30, 0.2)
    index = lists.build_index(c, 12)
    ks = {"web": 3}
    d = lists._distances(np.array([r.vector for r in q.collect()], dtype=float), index.centroids)
    further = [lists._reached(index.lists, ks, row, {"web": 2.0}) for row in d]
    read = [len(lists._reached(index.lists, ks, row, None)) + len(f) for row, f in zip(d, further, strict=True)]
    held = len(index.lists[index.lists["source_type"] == "web"])
    assert np.mean(read) < held / 2


def test_small_and_empty_tables(spark):
    corpus, queries, c, q = tables(spark, 9, 4, 1.0)
    ks = {"web": 50, "docx": 0, "none": 2}
    got = lists.search_lists(lists.build_index(c), q, ks).collect()
    assert {(r.query_id, r.source_type, r["rank"], r.chunk_id) for r in got} == nearest(corpus, queries, {"web": 50})
    assert lists.search_lists(lists.build_index(c.limit(0)), q, ks).collect() == []
    assert lists.search_lists(lists.build_index(c), q.limit(0), ks).collect() == []

"""The Jaccard join against brute force, its tree and its prefix rule."""

import random

import numpy as np
import pytest
from docflow import runtime
from docflow.llm import jaccard_join
from docflow.llm.components import components
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F


def brute(texts):
    import re

    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            c = len(a & sets[j])
            if c and 100 * c >= 80 * (len(a) + len(sets[j]) - c):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def near_copies(seed, n=60):
    """Chains and stars of near copies around the threshold, exact copies, shared passages."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    texts, passage = [], [rng.choice(words) for _ in range(30)]
    for i in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 9, 60, 150]))]
        if i % 3 == 0:
            base[2:2] = passage
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 6])):
            copy = (rng.choice(texts[-3:]) if rng.random() < 0.5 else texts[-1]).split(" ")
            for _ in range(rng.choice([0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("shard", [2048, 5, 2])
def test_components_equal_brute_force(docs_of, odd_texts, monkeypatch, shard):
    monkeypatch.setattr(jaccard_join, "SHARD", shard)
    texts = odd_texts + near_copies(shard)
    rows = jaccard_join.jaccard_components(docs_of(texts).repartition(3)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == dict(enumerate(brute(texts)))


def test_drop_keeps_one_of_each_component(docs_of, odd_texts):
    texts = odd_texts + near_copies(9, 30)
    docs = docs_of(texts).withColumn("node", F.lit(1)).withColumn("copies", F.lit("x"))
    left = jaccard_join.drop_near_copies(docs)
    assert left.columns == docs.columns
    want = brute(texts)
    kept = {i for i, (n, c) in enumerate(want) if c == i or n == 0}
    assert sorted(r.doc_id for r in left.collect()) == sorted(kept)


def test_null_and_repeated_ids(docs_of):
    text = " ".join(f"w{i}" for i in range(40))
    docs = docs_of([text, text, text + " x", "alone here now", "alone here now", None, None], [5, 5, 3, None, None, None, None])
    rows = jaccard_join.jaccard_components(docs).collect()
    assert sorted(((r.n_shingles, r.component_id) for r in rows), key=str) == sorted([(36, 3), (36, 3), (37, 3), (1, None), (1, None), (0, None), (0, None)], key=str)
    left = jaccard_join.drop_near_copies(docs).collect()
    assert sorted(str(r.text)[:5] for r in left) == ["None", "None", "alone", "w0 w1"]
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_tree_search_equals_all_bounds():
    rng = np.random.default_rng(1)
    base = rng.poisson(0.6, (20, jaccard_join.GROUPS))
    points = np.concatenate([np.maximum(base + rng.integers(-1, 2, base.shape) * (rng.random(base.shape) < 0.05), 0) for _ in range(15)]).astype(np.uint8)
    sizes, over = points.sum(1).astype(np.int64), np.zeros(len(points), dtype=np.int64)
    component = rng.integers(0, 40, len(points))
    tree = jaccard_join.CountTree(points, over, sizes, component)
    got = {(a, b) for who, at, _ in tree.search(points, over, sizes, component) for a, b in zip(who.tolist(), at.tolist(), strict=True)}
    want = {
        (a, b) for a in range(len(points)) for b in range(len(points))
        if component[a] != component[b] and np.minimum(points[a], points[b]).sum() >= jaccard_join.needed(sizes[a], sizes[b])
    }
    assert got == want and len(want) > 1000


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.integers(0, 20), st.integers(0, 20), st.integers(0, 2**32))
def test_bound_and_prefix_lose_no_pair(common, only_a, only_b, seed):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 1 << 64, common + only_a + only_b, dtype=np.uint64))
    rng.shuffle(pool)
    a, b = np.sort(pool[: common + only_a]), np.sort(np.r_[pool[:common], pool[common + only_a :]])
    c = len(np.intersect1d(a, b))
    linked = 100 * c >= 80 * (len(a) + len(b) - c)
    assert linked == (c >= jaccard_join.needed(len(a), len(b)))
    va, vb = jaccard_join.count_vector(a), jaccard_join.count_vector(b)
    assert np.minimum(va[: jaccard_join.GROUPS], vb[: jaccard_join.GROUPS]).sum() >= c
    level = rng.integers(0, 3, jaccard_join.CELLS).astype(np.uint8)
    if linked:
        assert len(np.intersect1d(jaccard_join.prefix(a, level), jaccard_join.prefix(b, level)))


def test_overfull_groups_stay_a_bound():
    same = np.full(1000, 7, dtype=np.uint64) + np.arange(1000, dtype=np.uint64) * np.uint64(jaccard_join.GROUPS)
    v = jaccard_join.count_vector(same)
    assert v[: jaccard_join.GROUPS].sum() == 255 and v[jaccard_join.GROUPS :].copy().view(np.uint32)[0] == 745


def test_components_of_long_paths(spark):
    rng = random.Random(2)
    nodes = rng.sample(range(10_000), 600)
    links = [(nodes[i], nodes[i + 1]) for i in range(299)] + [(nodes[300], nodes[i]) for i in range(301, 600)]
    rows = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    want = {n: min(nodes[:300]) for n in nodes[:300]} | {n: min(nodes[300:]) for n in nodes[300:]}
    assert len(rows) == 600 and {r.id: r.component for r in rows} == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_intermediates_go_when_they_are_read(docs_of, monkeypatch, tmp_path):
    monkeypatch.setattr(runtime, "shared_dir", lambda spark: str(tmp_path))
    texts = near_copies(4, 30)
    rows = jaccard_join.jaccard_components(docs_of(texts)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == dict(enumerate(brute(texts)))
    left = [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()]
    assert sorted(set(left)) == ["labelled", "small-star"], "measured points, shards, sets and pairs are gone"


def test_shuffles_go_with_a_written_result(spark, docs_of, monkeypatch):
    asked, write = [], DataFrameWriter.parquet

    def parquet(self, path, **options):
        names = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")
        asked.append((path.rsplit("/", 1)[1].rsplit("-", 1)[0], *(spark.conf.get(n) for n in names)))
        return write(self, path, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    jaccard_join.drop_near_copies(docs_of(near_copies(6, 10))).count()
    assert {clean for _, clean, _ in asked} == {"true"}
    assert {int(n) for label, _, n in asked if label.startswith("links-")} == {jaccard_join.SET_ROWS}, "whole sets go to Python in few rows"


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 300), st.integers(0, 300), st.integers(0, 80), st.integers(0, 2**32))
def test_parities_lose_no_pair(common, only_a, only_b, seed):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 1 << 64, common + only_a + only_b + 1, dtype=np.uint64))
    rng.shuffle(pool)
    a, b = np.sort(pool[: common + only_a + 1]), np.sort(np.r_[pool[:common], pool[common + only_a + 1 :]])
    apart = jaccard_join.least_apart(jaccard_join.parities(a), jaccard_join.parities(b))
    assert apart <= len(np.setxor1d(a, b)) and apart % 2 == len(np.setxor1d(a, b)) % 2
    assert apart == jaccard_join.least_apart(jaccard_join.parities(b), jaccard_join.parities(a))


def test_sets_of_unrelated_long_texts_do_not_move(spark, docs_of, monkeypatch):
    """Group counts leave such pairs; before, their whole sets were joined for verification."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(2500))
    texts = [passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(2500)) for _ in range(12)]
    texts += [t + " and more" for t in texts[:2]]
    asked, verified, not_apart = [], jaccard_join._verified, jaccard_join._not_apart
    monkeypatch.setattr(jaccard_join, "_levels", lambda counts: np.zeros(len(counts), dtype=np.uint8))  # the passage names shards
    monkeypatch.setattr(jaccard_join, "_not_apart", lambda pairs, sets: (asked.append(["left by groups", pairs.count()]), not_apart(pairs, sets))[1])
    monkeypatch.setattr(jaccard_join, "_verified", lambda pairs, sets: (asked.append(["verified", pairs.count(), sets.count()]), verified(pairs, sets))[1])
    rows = jaccard_join.jaccard_components(docs_of(texts)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == dict(enumerate(brute(texts)))
    assert sum(n for what, n, *_ in asked if what == "left by groups") > 10
    assert sum(n for what, n, *_ in asked if what == "verified") <= 4
    assert all(s[0] <= 2 * n for what, n, *s in asked if what == "verified")

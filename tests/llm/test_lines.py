"""Line dedup against brute force."""

import random
import re

import duckdb
import numpy as np
import pytest
from docflow import runtime
from docflow.llm import line_dedup
from docflow.llm.jaccard_join import needed
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def brute(texts):
    seen, out = [], []
    for t in texts:
        lines = (t or "").split("\n")
        kept, gone = [], 0
        for line in lines:
            fold = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
            s = frozenset(re.findall(r"[^\x20\x09-\x0D]+", fold))
            hit = False
            if s:
                hit = any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in seen)
                seen.append(s)
            gone += hit
            if not hit:
                kept.append(line)
        out.append((len(lines), gone, "\n".join(kept)))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.4)) % 700}" for _ in range(4000)]
    pool = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 5, 8, 20, 40]))) for _ in range(40)]
    texts = []
    for _ in range(n):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = rng.choice(pool[:1] if rng.random() < 0.3 else pool).split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(rng.choice([" ", "\t"]).join(line).title() if rng.random() < 0.2 else " ".join(line))
        texts.append("\n".join(lines))
    return texts


@pytest.mark.parametrize("shard", [4096, 4])
def test_lines_equal_brute_force(docs_of, odd_texts, monkeypatch, shard):
    monkeypatch.setattr(line_dedup, "SHARD", shard)
    texts = corpus(shard) + odd_texts[:7] + ["a b c d e\n\n\nA B C D E\n"]
    docs = docs_of(texts).withColumn("line", F.lit(1)).withColumn("key", F.lit("k")).repartition(5)
    rows = line_dedup.remove_matching_lines(docs).collect()
    want = brute(texts)
    assert {r.doc_id: tuple(r)[1:] for r in rows} == dict(enumerate(want))
    assert sum(w[1] for w in want) > 30


def test_null_and_repeated_ids(docs_of):
    line = "one two three four five six"
    rows = line_dedup.remove_matching_lines(docs_of([line, line, "x\n" + line + " seven", None], [4, 4, None, None])).collect()
    assert sorted((r.n_lines, r.n_removed) for r in rows) in ([(1, 0), (1, 0), (1, 0), (2, 1)], [(1, 0), (1, 1), (1, 1), (2, 0)])
    assert line_dedup.remove_matching_lines(docs_of([])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(5, 60), st.integers(0, 14), st.integers(0, 14), st.integers(0, 2**32))
def test_filters_lose_no_match(common, only_a, only_b, seed):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 1 << 64, common + only_a + only_b, dtype=np.uint64))
    rng.shuffle(pool)
    a, b = np.sort(pool[: common + only_a]), np.sort(np.r_[pool[:common], pool[common + only_a :]])
    apart = int(line_dedup.differing_bits(line_dedup.bitmap(a), line_dedup.bitmap(b)).sum())
    shared = len(np.intersect1d(a, b))
    assert apart <= len(a) + len(b) - 2 * shared
    if shared >= needed(len(a), len(b)):
        counts = rng.integers(1, 4, line_dedup.CELLS)
        p, q = line_dedup.prefix(a, counts), line_dedup.prefix(b, counts)
        both = np.intersect1d(p, q)
        assert len(both)
        x, y = np.flatnonzero(np.isin(p, both))[0], np.flatnonzero(np.isin(q, both))[0]
        assert min(x, y) + min(len(a) - x, len(b) - y) >= needed(len(a), len(b))


def test_query_equals_sql_on_a_larger_table(spark):
    from check import differences, make_duck
    from docflow.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.01"
    assert differences(QUERIES["op3_line_dedup"](spark, sf).toPandas(), make_duck(sf).sql(ORACLES["op3_line_dedup"]).df()) is None


@pytest.mark.parametrize("order", ["descending", "random", "null ids"])
def test_rows_of_a_batch_come_in_any_order(docs_of, order):
    """Copies of a line in one batch, the later one read first, and a near-equal line between the two."""
    from check import differences
    from docflow.llm.queries import ORACLES

    line = "one two three four five six seven eight nine"
    texts = ["x", "x", "x", line, "x", line + " ten", "x", "x", "x", line, *corpus(7)]
    ids = list(range(len(texts)))
    by = random.Random(3).sample(ids, len(ids)) if order == "random" else ids[::-1]
    docs = docs_of([texts[i] for i in by], [None] * len(ids) if order == "null ids" else by).coalesce(1)
    rows = line_dedup.remove_matching_lines(docs)
    if order == "null ids":  # these lie in the order of their texts' hashes
        placed = [r.text for r in docs.select(*line_dedup.identity(), "text").distinct().orderBy("uid", "tag").collect()]
        want = dict(zip(placed, brute(placed), strict=True))
        assert sorted(tuple(r)[1:] for r in rows.collect()) == sorted(want[t] for t in texts)
        return
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    got = rows.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256")).toPandas()
    assert differences(got, con.sql(ORACLES["op3_line_dedup"]).df()) is None
    assert {r.doc_id: tuple(r)[1:] for r in rows.collect()} == dict(enumerate(brute(texts)))


def test_short_lines_are_judged_on_request(docs_of, odd_texts):
    texts = ["Share this page\na b\nx", "share THIS page\nb c\n\n", "A b\nx x", "one two three four", *corpus(11), *odd_texts[:6], "one two three four five"]
    seen, want = [], []
    for t in texts:
        gone = 0
        for line in (t or "").split("\n"):
            s = set(re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in line)))
            gone += any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in seen) if s else 0
            seen += [s] if s else []
        want.append(gone)
    rows = line_dedup.remove_matching_lines(docs_of(texts).repartition(3), least_words=1).collect()
    assert {r.doc_id: r.n_removed for r in rows} == dict(enumerate(want)) and want[:4] == [0, 1, 2, 0]
    with pytest.raises(ValueError):
        line_dedup.remove_matching_lines(docs_of(texts), least_words=0)


def test_members_of_shards_are_not_written(docs_of, monkeypatch, tmp_path):
    monkeypatch.setattr(runtime, "shared_dir", lambda spark: str(tmp_path))
    made, path_of = [], runtime.scratch_path
    monkeypatch.setattr(runtime, "scratch_path", lambda spark, label: (made.append(label), path_of(spark, label))[1])
    texts = corpus(8, 30)
    rows = line_dedup.remove_matching_lines(docs_of(texts)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == dict(enumerate(brute(texts)))
    assert "line-nodes" in made and "line-shards" not in made
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["removed-lines"]


def test_many_lines_are_measured_as_each_by_itself(odd_texts):
    texts = [*corpus(5, 40), *odd_texts, "\n\nb a b\n", "x\n" * 1000, "a b c " * 200]
    data = [np.frombuffer((t or "").encode(), dtype=np.uint8) for t in texts]
    levels = np.random.default_rng(3).integers(1, 5, line_dedup.CELLS).astype(np.uint8)
    want = {(row, number): s for row, d in enumerate(data) for number, s in line_dedup.line_sets(d)}
    got, node_of, bits_of = {}, {}, {}
    for words, line, row, number in line_dedup._blocks(data):
        at, node, n, alone, many, shared, b0, b1 = line_dedup.measured_lines(words, line, levels)
        for k, found in enumerate(np.split(shared, np.cumsum(many)[:-1])):
            s = want[int(row[at[k]]), int(number[at[k]])]
            got[int(row[at[k]]), int(number[at[k]])] = s
            prefix = line_dedup.prefix(s, levels)
            assert (n[k], alone[k]) == (len(s), np.count_nonzero(levels[line_dedup._cell(prefix)] == 1))
            assert found.tolist() == prefix[alone[k] :].view(np.int64).tolist()
            assert node_of.setdefault(s.tobytes(), int(node[k])) == int(node[k])
            bits_of[int(node[k])] = (s, np.array([b0[k], b1[k]]))
    assert got.keys() == want.keys() and len(bits_of) == len(node_of) > 100
    for (s, x), (t, y) in zip(list(bits_of.values())[1:], bits_of.values(), strict=False):
        plain = line_dedup.differing_bits(line_dedup.bitmap(s), line_dedup.bitmap(t)).sum()
        assert line_dedup.differing_bits(x, y).sum() == plain


@pytest.mark.parametrize("small, at_once", [(64, 7), (3, 1 << 19)])
def test_small_and_large_shards_give_the_same(docs_of, monkeypatch, small, at_once):
    monkeypatch.setattr(line_dedup, "SMALL", small)
    monkeypatch.setattr(line_dedup, "AT_ONCE", at_once)
    texts = corpus(12, 50)
    rows = line_dedup.remove_matching_lines(docs_of(texts).repartition(3)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == dict(enumerate(brute(texts)))

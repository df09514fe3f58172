"""Spelling variants against edit distance by deletion neighbourhoods and a plain loop over words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from docflow.llm import spelling
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def fold(run):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in run)


def counted(rows, least=5, often=3, one_in=97):
    total = Counter()
    for i, text in rows:
        for run in map(fold, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= least and n >= often}


def near_of(words):
    same = defaultdict(set)
    for w in words:
        for j in range(len(w)):
            same[j, w[:j], w[j + 1 :]].add(w)
    near = {w: set() for w in words}
    for (_, a, b), group in same.items():
        for w in group:
            near[w] |= group - {w}
        if (shorter := a + b) in near:
            near[shorter] |= group
            for w in group:
                near[w].add(shorter)
    return near


def grouped(rows, **options):
    words = counted(rows, **options)
    near = near_of(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def test_position_index_finds_one_error():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(700)})
    near = near_of(words)
    for m in range(1, 7):
        mine, longer = ([w for w in words if len(w) == k] for k in (m, m + 1))
        q = spelling._letters(mine)
        same = spelling.PositionIndex(q).one_replaced(q, np.arange(len(mine)))
        found = {(mine[a], mine[b]) for a, b in zip(*spelling.set_bits(same), strict=True)}
        assert found == {(w, x) for w in mine for x in near[w] if len(x) == m}
        more = spelling.PositionIndex(spelling._letters(longer)).one_inserted(q)
        found = {(mine[a], longer[b]) for a, b in zip(*spelling.set_bits(more), strict=True)}
        assert found == {(w, x) for w in mine for x in near[w] if len(x) == m + 1}


@pytest.mark.parametrize("bucket,part", [(spelling.BUCKET, spelling.PART), (60, 1 << 19), (1 << 30, 40), (200, 30)])
def test_near_words_in_any_layout(spark, bucket, part):
    """Few and many buckets, and buckets cut into grids of cells; a hot first half of nearly all words."""
    rng = random.Random(bucket % 97 + part)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(5, 7))) for _ in range(150)}
    words |= {"hothot" + "".join(rng.choice("xy") for _ in range(rng.randint(3, 6))) for _ in range(60)}
    words = {w: k + 3 for k, w in enumerate(sorted(words))}
    got = spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n bigint"), bucket, part).collect()
    want = {(w, x, words[x]) for w, near in near_of(words).items() for x in near}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_groups_equal_brute_force(spark, docs_of, odd_texts):
    rng = random.Random(9)
    base = ["garden", "gardens", "garde", "straße", "Straße", "élève", "naïveté", "x×y÷zab", "mother", "bother"]

    def misspelt(w):
        j = rng.randrange(len(w))
        return rng.choice([w, w, w, w[:j] + w[j + 1 :], w[:j] + rng.choice("aeé") + w[j:], w[:j] + rng.choice("aeé") + w[j + 1 :]])

    texts = [" ".join(misspelt(rng.choice(base)) for _ in range(80)) + rng.choice(["", "\u0100word", "3word", "中garden"]) for _ in range(60)]
    texts += [*odd_texts, "a" * 300 + " " + "b" * 70, "a" * 300 + " " + "b" * 70, "a" * 301 + " " + "a" * 300 + " " + "b" * 70]
    ids = [*range(len(texts) - 3), None, 5, 5]
    docs = docs_of(texts, ids)
    for c in ("word", "n", "near", "bucket", "kind", "form", "root"):
        docs = docs.withColumn(c, F.lit("x"))
    rows = list(zip(ids, texts, strict=True))
    for options in ({}, {"one_in": 3, "least_count": 1}, {"least_letters": 2, "least_count": 2}):
        plain = {{"least_letters": "least", "least_count": "often"}.get(k, k): v for k, v in options.items()}
        got = spelling.group_variants(docs, **options).select(COLUMNS).collect()
        want = grouped(rows, **plain)
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert sum(w[1] is not None for w in grouped(rows)) > 20 and any(w[1] not in (None, w[2]) for w in grouped(rows, often=1, one_in=3))


def test_long_chain_of_forms(spark):
    words = ["a" * 5 + "b" * k for k in range(12)]
    forms = spark.createDataFrame([(a, b) for a, b in zip(words, words[1:], strict=False)], "word string, form string")
    assert {tuple(r) for r in spelling._roots(forms).collect()} == {(w, words[-1]) for w in words[:-1]}


def test_empty_and_blank_tables(docs_of):
    assert spelling.group_variants(docs_of([]).limit(0)).collect() == []
    assert spelling.group_variants(docs_of([None, "", "a b c 1234567"])).collect() == []


@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 10**12)), st.text("aZé÷ 中\u0100\n1Å", max_size=60)), max_size=12))
@settings(max_examples=60, deadline=None)
def test_word_counts(rows):
    import pyarrow as pa

    batch = pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], names=["i", "t"])
    total = Counter()
    for out in spelling._count_words(2, 3)(iter([batch])):
        for w, n in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
            total[w] += n
    assert dict(total) == counted(rows, 2, 1, 3)


def test_slices_are_cut_between_words(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(spelling, "SLICE", 50)
    monkeypatch.setattr(spelling.arrays, "SEGMENT", 16)
    texts = ["élève garden " * 30 + "ü" * 90, "中中中garden中" * 9]
    batch = pa.record_batch([pa.array([1, 2]), pa.array(texts)], names=["i", "t"])
    total = Counter()
    for out in spelling._count_words(5, 97)(iter([batch])):
        total.update(dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)))
    assert dict(total) == counted(list(zip([1, 2], texts, strict=True)), 5, 1)

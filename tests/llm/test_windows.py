"""Repeated windows of words and bytes against brute force."""

import random
import re

import numpy as np
import pytest
from docflow import runtime
from docflow.llm import substring_dedup, suffix_dedup, windows
from hypothesis import given, settings
from hypothesis import strategies as st


def brute_words(texts, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = {}
    for i, w in enumerate(words):
        for s in range(len(w) - width + 1):
            seen.setdefault(tuple(w[s : s + width]), []).append((i, s))
    gone = [[False] * len(w) for w in words]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s : s + width] = [True] * width
    return [(len(w), sum(g), " ".join(x for x, y in zip(w, g, strict=True) if not y)) for w, g in zip(words, gone, strict=True)]


def brute_bytes(texts, width):
    data = [(t or "").encode() for t in texts]
    seen, gone = set(), [bytearray(len(d)) for d in data]
    for d, g in zip(data, gone, strict=True):
        for s in range(len(d) - width + 1):
            if d[s : s + width] in seen:
                g[s : s + width] = b"\1" * width
            seen.add(d[s : s + width])
    out = []
    for d, g in zip(data, gone, strict=True):
        spans = len(re.findall(b"\1+", bytes(g)))
        out.append((len(d), sum(g), spans, bytes(x for x, y in zip(d, g, strict=True) if not y)))
    return out


def corpus(seed, n=120):
    """Random texts with shared passages, copies, near copies, periodic texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" if i % 7 else f"É{i}é" for i in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 90))] for _ in range(6)]
    texts = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages[:1] if i % 3 == 0 else passages)
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
        if i % 10 == 9:
            texts.append(rng.choice(texts))
        if i % 15 == 7:
            words[rng.randrange(len(words) + 1) :] = ["changed"]
            texts.append(" ".join(words))
        if i % 40 == 3:
            texts.append(" ".join(["again", "and"][: 1 + i % 2] * rng.randint(30, 60)))
    return texts


@pytest.mark.parametrize("often", [2_000, 3])
def test_words_equal_brute_force(docs_of, odd_texts, monkeypatch, often):
    monkeypatch.setattr(windows, "FREQUENT", often)
    texts = odd_texts + corpus(1)
    rows = substring_dedup.remove_repeats(docs_of(texts).repartition(7)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == dict(enumerate(brute_words(texts, 35)))


def test_words_short_windows(docs_of):
    texts = corpus(2, 40)
    for width, first in ((3, 8), (9, 4), (40, 5)):
        rows = substring_dedup.remove_repeats(docs_of(texts).repartition(3), width, first).collect()
        assert {r.doc_id: tuple(r)[1:] for r in rows} == dict(enumerate(brute_words(texts, width)))


@pytest.mark.parametrize("often", [2_000, 3])
def test_bytes_equal_brute_force(docs_of, odd_texts, monkeypatch, often):
    monkeypatch.setattr(windows, "FREQUENT", often)
    texts = odd_texts[:6] + [odd_texts[6][:30_000]] + odd_texts[7:] + corpus(3)
    rows = suffix_dedup.remove_repeats(docs_of(texts).repartition(7)).collect()
    assert {r.doc_id: (*tuple(r)[1:4], bytes(r.kept)) for r in rows} == dict(enumerate(brute_bytes(texts, 100)))


def test_long_texts_are_cut_without_loss(docs_of, monkeypatch):
    monkeypatch.setattr(windows, "_SPAN", 64)
    texts = corpus(4, 40)
    rows = substring_dedup.remove_repeats(docs_of(texts).coalesce(2)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == dict(enumerate(brute_words(texts, 35)))
    rows = suffix_dedup.remove_repeats(docs_of(texts).coalesce(2)).collect()
    assert {r.doc_id: (*tuple(r)[1:4], bytes(r.kept)) for r in rows} == dict(enumerate(brute_bytes(texts, 100)))


def test_levels_leave_nothing_behind(docs_of, monkeypatch, tmp_path):
    monkeypatch.setattr(runtime, "shared_dir", lambda spark: str(tmp_path))
    texts = corpus(5, 40)
    rows = substring_dedup.remove_repeats(docs_of(texts)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == dict(enumerate(brute_words(texts, 35)))
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["removed", "texts"]


def test_batches_are_compared_in_pieces(docs_of, monkeypatch):
    monkeypatch.setattr(windows, "_PIECE", 500)
    texts = corpus(6, 40)
    rows = suffix_dedup.remove_repeats(docs_of(texts).coalesce(1)).collect()
    assert {r.doc_id: (*tuple(r)[1:4], bytes(r.kept)) for r in rows} == dict(enumerate(brute_bytes(texts, 100)))


def test_equal_runs_meet_the_others_once(docs_of):
    text = " ".join(f"word{i}" for i in range(50))

    def settle(key, uid, tag, start, sizes, values):
        assert len({v.tobytes() for v in values}) == len(values), "a run of bytes came twice"
        return suffix_dedup._later(key, uid, tag, start, sizes, values)

    docs = docs_of([text, *(f"{i} {text}" for i in range(40))])
    _, removed = windows.removed_windows(docs, suffix_dedup.byte_values, 100, (32,), settle, content=True)
    assert removed.select("uid").distinct().count() == 40


def test_null_and_repeated_ids(docs_of):
    text = " ".join(f"word{i}" for i in range(50))
    rows = substring_dedup.remove_repeats(docs_of([text, text, "x " + text, "other"], [1, 1, None, None])).collect()
    assert sorted((r.n_words, r.n_removed) for r in rows) == [(1, 0), (50, 50), (50, 50), (51, 50)]
    rows = suffix_dedup.remove_repeats(docs_of([text, text, "other"], [1, 1, None])).collect()
    assert sorted(r.n_removed for r in rows) == [0, 0, 0]
    rows = suffix_dedup.remove_repeats(docs_of([text, text], [1, 2])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, 0), (2, len(text))]
    empty = docs_of([])
    assert substring_dedup.remove_repeats(empty).count() == 0 and suffix_dedup.remove_repeats(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 12))
def test_minimisers(values, w):
    grams = np.array(values, dtype=np.uint64) << np.uint64(40)
    if len(values) >= w:
        got = windows.minimisers(grams, w)
        assert got.tolist() == [min(range(s, s + w), key=lambda k: (values[k], k)) for s in range(len(values) - w + 1)]


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=20, max_size=120).map(lambda b: bytes(x % 3 for x in b)), st.integers(1, 19))
def test_radix_groups(data, depth):
    content = np.frombuffer(data + bytes(32), dtype=np.uint8)
    at = np.arange(len(data) - depth + 1)
    index, group = suffix_dedup.radix_groups(content, at, np.zeros(len(at), dtype=np.int64), depth)
    want = {}
    for s in at.tolist():
        want.setdefault(data[s : s + depth], set()).add(s)
    got = {}
    for i, g in zip(index.tolist(), group.tolist(), strict=True):
        got.setdefault(g, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)

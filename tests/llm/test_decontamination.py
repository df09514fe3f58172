"""Containment search against brute force."""

import random
import re

import pytest
from docflow.llm import decontamination
from pyspark.sql import functions as F


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts, items):
    sets = [shingles(t) for t in items]
    out = set()
    for i, t in enumerate(texts):
        have = shingles(t)
        for k, s in enumerate(sets):
            if s and 10 * len(s & have) >= 8 * len(s):
                out.add((i, k, len(s), len(s & have)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    items = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 5, 8, 20, 45, 130]))) for _ in range(80)]
    texts = []
    for i in range(150):
        w = [rng.choice(words) for _ in range(rng.choice([0, 4, 100, 3000]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            item = rng.choice(items).split()
            if rng.random() < 0.5:
                item[rng.randrange(len(item))] = "Changed"
            if rng.random() < 0.2:
                cut = rng.randrange(len(item) + 1)
                w[0:0] = item[:cut]
                item = item[cut:]
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() for x in item] if i % 2 else item
        texts.append(rng.choice([" ", "\n\t "]).join(w))
    return texts, items


def items_of(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")


@pytest.mark.parametrize("block", [20_000, 13])
def test_leaks_equal_brute_force(spark, docs_of, odd_texts, monkeypatch, block):
    monkeypatch.setattr(decontamination, "ITEMS", block)
    texts, items = corpus(block)
    texts, items = odd_texts + texts, items + [None, "", "  ", "word"]
    docs, items_df = docs_of(texts).repartition(4), items_of(spark, items)
    rows = decontamination.find_leaks(docs, items_df).collect()
    want = brute(texts, items)
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want and len(want) > 40
    docs = docs.withColumn("item_id", F.lit("x")).withColumn("n_item", F.lit(1))
    left = decontamination.drop_leaks(docs, items_df)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - {w[0] for w in want}


def test_long_texts_are_searched_in_parts(spark, docs_of, monkeypatch):
    monkeypatch.setattr(decontamination, "_PART", 64)
    texts, items = corpus(5)
    rows = decontamination.find_leaks(docs_of(texts), items_of(spark, items)).collect()
    assert {tuple(r) for r in rows} == brute(texts, items)


def test_empty_tables(spark, docs_of):
    docs, items = docs_of(["a b c"]), items_of(spark, ["x y"])
    assert decontamination.find_leaks(docs.limit(0), items).count() == 0
    assert decontamination.find_leaks(docs, items.limit(0)).count() == 0
    assert decontamination.drop_leaks(docs, items.limit(0)).count() == 1
    nulls = docs_of(["x y", None], [None, None])
    assert [tuple(r) for r in decontamination.find_leaks(nulls, items).collect()] == [(None, 0, 1, 1)]

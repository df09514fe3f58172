"""Exact dedup, packing, quality and toxicity against plain Python."""

import hashlib
import zlib

import numpy as np
import pytest
from docflow.llm import exact_dedup, jaccard_join, packing, quality, toxicity
from docflow.llm.queries import tokenizer_path
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_groups(docs_of, odd_texts):
    texts = odd_texts + ["WORD", "É", "é"]
    rows = exact_dedup.exact_groups(docs_of(texts), buckets=4).collect()
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(fold(t), []).append(i)
    want = {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert len(rows) == len(texts) and {tuple(r) for r in rows} == want


def test_exact_repeated_and_null_ids(docs_of):
    docs = docs_of(["a", "a", "a", "b", "b"], [1, 1, None, None, None])
    rows = exact_dedup.exact_groups(docs, buckets=2).collect()
    assert len(rows) == 5 and sum(r.kept for r in rows) == 2
    assert {(r.keep_id, r.group_size) for r in rows} == {(1, 3), (None, 2)}
    left = exact_dedup.drop_copies(docs, buckets=2).collect()
    assert sorted(r.text for r in left) == ["a", "b"]
    assert exact_dedup.exact_groups(docs.limit(0), buckets=2).count() == 0


def test_exact_index_is_persistent(spark, docs_of, tmp_path):
    path = str(tmp_path / "index")
    first = exact_dedup.exact_groups(docs_of(["a", "b"]), 4, path).collect()
    assert all(r.kept for r in first)
    spark.sql("DROP TABLE " + exact_dedup.DigestIndex(spark, path, 4).table)  # as in a new session
    second = exact_dedup.exact_groups(docs_of(["B", "c"], [7, 8]), 4, path).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in second} == {(7, 1, False), (8, 8, True)}
    assert exact_dedup.DigestIndex(spark, path, 4).rows().count() == 3


def test_exact_index_side_is_not_shuffled(spark, docs_of, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "i"), 4)
    index.add(exact_dedup.digests(docs_of(list("abc"))).withColumn("copies", F.lit(1)))
    plan = index.rows().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("drop", [exact_dedup.drop_copies, jaccard_join.drop_near_copies])
def test_clashing_columns_come_back_as_they_were(docs_of, drop):
    names = ["__uid", "__tag", "__u", "__t", "__w", "__id", "__digest", "uid", "tag", "row", "id", "digest", "winner", "keep_id", "copies", "a.b"]
    docs = docs_of(["a b", "A b", "c d e f g h", None, "c d e f g h"], [1, 1, 2, 3, 2])
    for k, c in enumerate(names):
        docs = docs.withColumn(c, F.concat(F.lit(f"{k}-"), F.col("doc_id").cast("string")))
    out = drop(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 3]
    assert all(r[c] == f"{k}-{r.doc_id}" for r in rows for k, c in enumerate(names))


def test_extra_columns_are_kept(docs_of):
    docs = docs_of(["a", "A"]).withColumn("digest", F.lit("x")).withColumn("copies", F.lit(1)).withColumn("keep_id", F.lit(3))
    out = exact_dedup.drop_copies(docs, 2)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [1]


def encode_plain(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def test_pack_round_trip(docs_of, odd_texts):
    texts = odd_texts + ["one two three " * k for k in (1, 50, 170, 400)]
    want = encode_plain(texts)
    rows = packing.pack(docs_of(texts).coalesce(2), tokenizer_path(), pool=5).collect()
    pieces, places = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert r.length == len(ids) and r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.doc_tokens == len(want[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, ids.tolist()))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, ids in enumerate(want):
        assert sum((p for _, p in sorted(pieces[i])), []) == ids
    padding = 0
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 1024
        padding += 0 if end & (end - 1) == 0 else 1024 - end
    assert padding <= 0.02 * sum(map(len, want))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'9 \n\t 　\x1cé<|endoftx>")), max_size=60))
def test_runs_are_encoded_alike(text):
    assert np.frombuffer(packing.token_bytes(text, tokenizer_path()), "<u4").tolist() == encode_plain([text])[0][:-1]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("aZé\u024f'stvrlm09²½.,-!?<|>\t\n \x85\xa0\x1c\x00×÷€中ªµ", max_size=40), max_size=12))
def test_latin_texts_equal_the_tokenizer(texts):
    texts = [y for x in texts for y in (x, x + "<|endoftext|>", " " + x + "'ll we're ")]
    got = [np.frombuffer(packing.token_bytes(x, tokenizer_path()), "<u4").tolist() for x in texts]
    assert got == [ids[:-1] for ids in encode_plain(texts)]


def test_a_small_memory_gives_the_same_ids():
    text = " ".join(f"mot{k % 7}, it's {k} d’été" for k in range(60))
    assert np.frombuffer(packing.token_bytes(text, tokenizer_path(), 3), "<u4").tolist() == encode_plain([text])[0][:-1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
def test_best_fit_takes_the_tightest(lengths):
    got = packing.best_fit_decreasing(np.array(lengths), 64)
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [c for c in room if c >= n]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else 64) - n)
    assert sorted(64 - sum(lengths[i] for i in s) for s in got) == sorted(room)
    levelled = packing.level([[(i, 0, lengths[i]) for i in s] for s in got], 64, 1)
    assert sum(p[2] for s in levelled for p in s) == sum(lengths)
    loads = [sum(p[2] for p in s) for s in levelled]
    assert all(64 - n <= 1 or n & (n - 1) == 0 for n in loads)


def labelled(spark, rows, name):
    return spark.createDataFrame(rows, f"doc_id bigint, {name} int")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("quality is not null").toPandas()
    assert (rows.held_out == rows.doc_id.map(held_out)).all()
    test = rows[rows.held_out]
    assert (test.predicted == test.quality).mean() >= 0.93
    assert test[test.quality == 1].predicted.mean() >= 0.97


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").where("toxic is not null").toPandas()
    test = rows[rows.held_out]
    assert test[test.toxic == 1].predicted.mean() >= 0.75
    assert test[test.toxic == 0].predicted.mean() <= 0.04


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_odd_cases(spark, docs_of, odd_texts, module, label):
    docs = docs_of(odd_texts, [None, *range(1, len(odd_texts))]).withColumn("score", F.lit("x")).withColumn("y", F.lit(1))
    empty = labelled(spark, [], label)
    rows = module.classify(docs, empty).collect()
    assert len(rows) == len(odd_texts) and {r.score for r in rows} == {0.5}
    some = labelled(spark, [(1, 1), (2, 0), (2, None), (3, 1), (3, 1), (4, 0), (None, 1), (6, 0), (7, 1), (8, 1)], label)
    rows = module.classify(docs.union(docs), some).collect()
    assert len(rows) == 2 * len(odd_texts) and all(0 <= r.score <= 1 for r in rows)
    assert module.classify(docs.limit(0), some).count() == 0


def test_forest_equals_plain_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > -0.3)).astype(float)
    forest = quality.grow(x, y, trees=40)
    got = forest.scores(x)
    assert ((got > 0.5) == y).mean() > 0.95
    for i in range(20):
        margin = forest.base
        for t in range(len(forest.leaf)):
            at = 0
            while at < forest.feature.shape[1]:
                at = 2 * at + 1 + int(x[i, forest.feature[t, at]] > forest.value[t, at])
            margin += forest.leaf[t, at - forest.feature.shape[1]]
        assert abs(got[i] - 1 / (1 + np.exp(-margin))) < 1e-12


def test_keep_good_keeps_rows_and_columns(spark, docs_of):
    good = [f"the sentence number {i} tells of {i * 7} things in plain words" for i in range(200)]
    bad = ["### ### $$$ " * (3 + i % 5) for i in range(200)]
    docs = docs_of(good + bad).withColumn("score", F.lit(7))
    labels = labelled(spark, [(i, int(i < 200)) for i in range(400)], "quality")
    left = quality.keep_good(docs, labels)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(range(200))


def test_swaps_take_the_score_off_identity_terms():
    rng = np.random.default_rng(5)
    words = lambda *w: toxicity.text_words(np.frombuffer(" ".join(w).encode(), dtype=np.uint8))
    texts, y = [], []
    for _ in range(600):
        toxic = rng.random() < 0.3
        group = "women" if rng.random() < (0.9 if toxic else 0.1) else "men"
        texts.append(words(group, "insult" if toxic and rng.random() < 0.7 else "calm", f"w{rng.integers(40)}"))
        y.append(float(toxic))
    y = np.array(y)

    def gap(model):
        return model.score(words("women", "calm")) - model.score(words("men", "calm"))

    plain, fair = toxicity.train(texts, y, fairness=0.0), toxicity.train(texts, y, fairness=50.0)
    assert gap(plain) > 0.2 and abs(gap(fair)) < 0.25 * gap(plain)
    assert fair.score(words("men", "insult")) > 0.5


def test_pipeline_writes_the_token_ids(spark, docs_of, odd_texts, tmp_path):
    import corpus_pipeline

    texts = [*odd_texts, "one two three " * 900]
    corpus_pipeline.packed(spark, docs_of(texts), "").write.parquet(f"{tmp_path}/packed")
    pieces = {}
    for r in spark.read.parquet(f"{tmp_path}/packed").collect():
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert [sum((p for _, p in sorted(pieces[i])), []) for i in range(len(texts))] == encode_plain(texts)

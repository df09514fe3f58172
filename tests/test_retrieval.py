"""Search and novelty against brute force."""

import math
import re

import numpy as np
import pytest

from docflow.functions.wordlists import STOP_WORDS
from docflow.operators import retrieval as rt
from docflow.operators import stats
from docflow.sources import files, sinks


def vectors(spark, n, name, seed, extra=""):
    rng = np.random.default_rng(seed)
    rows = [(i, "docx" if i % 3 else "web", [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(n)]
    return spark.createDataFrame(rows, f"{name} int, source_type string, vector array<float>").repartition(4)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_both_routes_equal_brute_force(spark, metric):
    corpus, queries = vectors(spark, 300, "chunk_id", 1), vectors(spark, 17, "query_id", 2).drop("source_type")
    c, q = corpus.collect(), queries.collect()
    want = set()
    for a in q:
        for kind, k in (("docx", 4), ("web", 7)):
            v = np.array(a.vector)
            def dist(r):
                w = np.array(r.vector)
                if metric == "l2":
                    return round(float(((v - w) ** 2).sum()), 6)
                return round(1 - float(v @ w) / ((np.linalg.norm(v) + 1e-8) * (np.linalg.norm(w) + 1e-8)), 6)
            best = sorted((dist(r), r.chunk_id) for r in c if r.source_type == kind)[:k]
            want |= {(a.query_id, kind, n + 1, d) for n, (d, _) in enumerate(best)}
    for options in ({}, {"broadcast_bytes": 0, "block_bytes": 1000}):
        got = rt.search(corpus, queries, {"docx": 4, "web": 7}, metric, **options).collect()
        assert {(r.query_id, r.source_type, r["rank"], round(r.distance, 6)) for r in got} == want


def brute_novelty(texts):
    def terms(t):
        import unicodedata

        t = "".join(x for x in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(x))
        w = [x for x in re.findall(r"(?u)\b\w[\w’']+\b", t) if x not in STOP_WORDS]
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    docs = [terms(t) for t in texts]
    df = {t: sum(t in d for d in docs) for d in docs for t in d}
    vec = [{t: d.count(t) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in set(d)} for d in docs]
    norm = [math.sqrt(sum(x * x for x in v.values())) for v in vec]
    return [1 - (sum(vec[0].get(t, 0) * x for t, x in v.items()) / (norm[0] * n) if n and norm[0] else 0) for v, n in zip(vec[1:], norm[1:])]


def test_novelty_equals_brute_force(spark):
    texts = ["La chute du patient l’été à l'hôpital, chute grave", "Chute du patient âgé", "rien de commun ici", "le la les", "chute chute chute"]
    rows = spark.createDataFrame([(1, n, t) for n, t in enumerate(texts)], "query_id int, doc_no int, text string")
    got = [r.novelty for r in rt.tfidf_novelty(rows).orderBy("doc_no").collect()]
    assert got == pytest.approx(brute_novelty(texts))


def test_gate_keeps_one_per_url(spark):
    rows = [(1, 1, 0.9, 0.5, "http://a/"), (1, 2, 0.8, 0.5, "HTTP://A"), (1, 3, 0.7, 0.9, "http://b"), (1, 4, 0.7, 0.5, ""), (1, 5, 0.65, 0.5, ""), (1, 6, 0.61, 0.5, "http://c")]
    web = spark.createDataFrame(rows, "query_id int, rank int, similarity double, novelty double, source string")
    assert [r["rank"] for r in rt.gate_web(web).orderBy("n").collect()] == [1, 4, 5]


def test_guard_and_footer(spark):
    corpus = vectors(spark, 9, "chunk_id", 3)
    rt.check_index(corpus, ("docx", "web"), 6)
    with pytest.raises(rt.IndexNotReady, match="dimensions"):
        rt.check_index(corpus, ("docx",), 7)
    with pytest.raises(rt.IndexNotReady, match="not available"):
        rt.check_index(corpus, ("other",), 6)


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text('﻿[{"x": 1}, {"x": 2}]', encoding="utf8")
    (tmp_path / "sub" / "b.json").write_text('{"x": 3}')
    (tmp_path / "c.json").write_text("{broken")
    read = files.read_whole_files(spark, str(tmp_path))
    assert sorted(r.doc for r in files.json_documents(read).collect()) == ['{"x":1}', '{"x":2}', '{"x":3}']
    assert [r.file.rsplit("/", 1)[1] for r in files.unreadable_files(read).collect()] == ["c.json"]
    assert {r.folder: r.n_files for r in files.file_inventory(spark, str(tmp_path)).collect()} == {tmp_path.name: 2, "sub": 1}


def test_patient_changes_in_order(spark):
    base = spark.createDataFrame([("a.json", "0")], "name string, content string")
    steps = [(1, "a.json", "create", "1"), (2, "a.json", "delete", None), (3, "a.json", "update", "3"), (4, "a.json", "create", "4"), (5, "b.json", "update", "5"), (6, "../c", "create", "6")]
    changes = spark.createDataFrame(steps, "seq bigint, name string, op string, content string")
    from pyspark.sql import functions as F

    for width in (1, 100):
        b = F.floor(F.col("seq") / width)
        got = [r.status for r in sinks.change_status(base, changes, b).orderBy("seq").collect()]
        assert got == ["409 exists", "deleted", "404 missing", "created", "404 missing", "400 invalid name"]
        assert sorted(map(tuple, sinks.apply_changes(base, changes, b).collect())) == [("a.json", "4")]


def test_stats_with_missing_columns(spark):
    rows = spark.createDataFrame([("web", "http://a.fr/x"), ("web", "note"), ("docx", "g.docx")], "source_type string, source string")
    got = {r.source_type: (r.n_chunks, r.n_pages, r.n_domains, r.n_files) for r in stats.index_stats(rows).collect()}
    assert got == {"web": (2, 1, 1, 0), "docx": (1, 0, 0, 1)}

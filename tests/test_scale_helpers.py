"""Bucketed helpers equal plain windows, with one key that holds most rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from docflow.operators import changes, docs, graph, ordered


def hot_rows(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(20)}", i, rng.choice([None, 1, 2, 3])) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, o bigint, v int").repartition(5)


def test_previous_index_and_last_equal_windows(spark):
    df, w, b = hot_rows(spark), Window.partitionBy("k").orderBy("o"), F.floor(F.col("o") / 64)
    got = ordered.with_previous(df, ["k"], "o", ["v"], b)
    got = ordered.with_row_index(got, ["k"], "o", b, "n")
    got = ordered.with_last_before(got, ["k"], "o", F.col("v"), b)
    plain = df.select(
        "k", "o", F.lag("o").over(w).alias("po"), F.lag("v").over(w).alias("pv"), (F.row_number().over(w) - 1).alias("n"),
        F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("l"),
    )
    left = {(r.k, r.o): (r.prev.o if r.prev else None, r.prev.v if r.prev else None, r.n, r.last) for r in got.collect()}
    assert left == {(r.k, r.o): (r.po, r.pv, r.n, r.l) for r in plain.collect()}


def test_debounce_splits_exactly_at_the_gap(spark):
    rows = [("a", 0), ("a", 9), ("a", 19), ("a", 28), ("b", 5)]
    df = spark.createDataFrame(rows, "k string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = changes.debounce_events(df, "k", "ts", 10).select("k", F.unix_seconds("burst_start"), F.unix_seconds("burst_end"), "n_events")
    assert sorted(map(tuple, got.collect())) == [("a", 0, 9, 2), ("a", 19, 28, 2), ("b", 5, 5, 1)]


def test_frontier_handles_cycles_and_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    got = dict(map(tuple, graph.bounded_frontier(edges, seeds, 2).collect()))
    assert got == {"a": 0, "b": 1, "c": 2}
    assert graph.bounded_frontier(edges, seeds, 9).count() == 4


def test_packing_keeps_all_text(spark):
    rng = random.Random(3)
    parts = [["p" * rng.randrange(1, 1500) for _ in range(30)] for _ in range(20)]
    df = spark.createDataFrame([(p,) for p in parts], "p array<string>")
    for r in df.select("p", docs.pack_1k(F.col("p")).alias("c"), docs.pack_1k(F.col("p"), compat=True).alias("k")).collect():
        assert "\n".join(r.c) == "\n".join(r.p)
        assert all(len(c) <= 1000 or "\n" not in c for c in r.c)
        assert [c for c in r.k if c] == r.c and (r.k[0] == "") == (len(r.p[0]) >= 1000)


def test_sheet_headings(spark):
    text = "avant\nFiche Recommandation 0012 : Chute\ncorps\nfiche arbre décisionnel 3\nÉtape\nFICHE 1234 x"
    df = spark.createDataFrame([(text, "g.docx")], "t string, f string")
    got = docs.split_fiches(df, "t", "f").orderBy("idx").collect()
    assert [(r.fiche_id, r.titre) for r in got] == [("012", "Chute"), ("003", "Étape"), ("123", "4 x")]

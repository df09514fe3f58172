"""Steps of record queries that must not be repeated or grow with the number of folders, and their results."""

import re
import unicodedata

from pyspark.sql import functions as F

from docflow.functions import text
from docflow.operators import privacy, render
from docflow.sources import sinks


def test_exports_in_buckets_replace_by_patient(spark, tmp_path):
    path = str(tmp_path / "exports")
    rows = spark.range(40).select(F.concat(F.lit("p"), "id").alias("patient"), F.lit("# one").alias("markdown"))
    rows = rows.unionByName(spark.createDataFrame([(None, "# none"), ("", "# blank")], "patient string, markdown string"))
    sinks.write_chat_exports(rows, "2024-05-01", path, buckets=4)
    sinks.write_chat_exports(rows.limit(1).withColumn("markdown", F.lit("# next")), "2024-05-02", path, buckets=4)
    again = spark.createDataFrame([("p3", "# two"), ("p3", "# three"), (None, "# no name")], "patient string, markdown string")
    sinks.write_chat_exports(again, "2024-05-01", path, buckets=4)
    got = sorted((r.day, r.patient or str(r.patient), r.markdown) for r in sinks.read_chat_exports(spark, path, buckets=4).collect())
    kept = [("2024-05-01", f"p{n}", "# one") for n in range(40) if n != 3]
    named = [("2024-05-01", "p3", "# two"), ("2024-05-01", "p3", "# three"), ("2024-05-02", "p0", "# next"), ("2024-05-01", "None", "# no name")]
    assert [g for g in got if g[1] != ""] == sorted(kept + named)
    assert len(list((tmp_path / "exports").glob("day=2024-05-01/*"))) <= 4


def test_schedule_reads_its_entries_once(spark):
    entries = spark.range(3).select(
        F.col("id").alias("d"), F.lit(1).alias("week"), F.array(F.lit("Lundi")).alias("days"), F.array(F.lit("Matin")).alias("moments"), F.array(F.lit("x")).alias("actions")
    )
    done = render.weekly_schedule(entries, "d")
    assert done._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert done.count() == 48 and done.where(F.col("Lundi") == "x").count() == 3


def test_schedule_of_odd_entries(spark):
    rows = [
        (1, 1, ["Lundi"], ["Matin"], []), (2, 1, ["Lundi"], ["Matin"], [None]), (None, 1, ["Lundi"], ["Matin"], ["x"]),
        (3, 3, ["Lundi"], ["Matin"], ["x"]), (4, 1, None, ["Matin"], ["x"]), (5, 2, ["Lundi"], [], ["x"]), (6, 2, ["Lundi"], ["Matin", "zz"], ["b", "a", "b"]),
    ]
    entries = spark.createDataFrame(rows, "d int, week int, days array<string>, moments array<string>, actions array<string>")
    got = render.weekly_schedule(entries, "d").collect()
    assert len(got) == 7 * 16
    filled = {(r.d, r.week, r.slot): r.Lundi for r in got if r.Lundi != "Non renseigné"}
    slot = render.MOMENT_SLOTS["Matin"]
    assert filled == {(2, 1, slot): "", (6, 2, slot): "a, b"}


def test_texts_that_nfkc_leaves_alone_stay_here(spark):
    """Latin letters in normal form don't travel to Python; everything else is normalised as before."""
    kept = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", text._maybe_not_nfkc()))
    inert = [chr(c) for c in range(0x3000) if not kept.match(chr(c))]
    assert {"é", "ß", "œ", "’"} <= set(inert) and not {"\u0301", "ﬁ", "\xa0", "²"} & set(inert)
    assert all(unicodedata.normalize("NFKC", a + b) == a + b for a in inert for b in inert)
    values = ["a b", " a", "a ", "a  b", "", None, "é\u0301 e\u0301", "ﬁn", "a\u00a0b", "\tAB\u00c9 C\n", "x²", "ÉTÉ À", "a\x1cb", "l'ÉTÉ", "Ab", "AbC"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for r in df.select("v", text.norm_text("v", "keep").alias("t")).collect():
        assert r.t == " ".join(unicodedata.normalize("NFKC", (r.v or "").strip()).split())
    shouted = {r.v: r.t for r in df.select("v", text.norm_text("v").alias("t")).collect()}
    assert shouted["ÉTÉ À"] == "Été À" and shouted["AbC"] == "AbC" and shouted["\tAB\u00c9 C\n"] != "ABÉ C"


def test_name_patterns_pass_by_other_places(spark):
    paths = (("prenomUtilise", "Zoé", "Léa"), ("nomUtilise", "Œd Été", "Huet"))
    rows = [(1, f"{privacy.PERSON}.{p}", o, a, True) for p, o, a in paths]
    rules = privacy.name_rules(spark.createDataFrame(rows, "d int, path string, original string, alias string, mapped boolean"), "d")
    assert rules.first().pattern.startswith("(?U)(?=(?iu:M)|")
    cases = {
        "mme zoe  été, ZOÉ ; azoé zoés Zoe\u0301.": "mme Léa  été, Léa ; azoé zoés Léa.", "M. œd ÉTE et Zoe œD ete": "M. Huet et Léa Huet", "rien": "rien",
    }
    texts = spark.createDataFrame([(1, t) for t in cases], "d int, value string")
    got = {r.value: r.m for r in privacy.mask_names(texts.withColumn("m", F.col("value")), rules, "d", "m").select("value", "m").collect()}
    assert got == cases

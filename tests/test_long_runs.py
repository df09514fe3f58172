"""Texts whose first words are all short, thousands of them: records are built from them without deep recursion."""

import re

import duckdb
import pytest
from check import differences
from pyspark.sql import functions as F

from docflow.registry import load
from docflow.registry import records as rr

QUERIES, ORACLES = load()
LETTERS = re.compile(r"[^\W\d_]+")


def _texts():
    texts = []
    for n, short in ((2_500, "Geö"), (6_000, "La"), (20_000, "ô")):
        run = f"{short} " * n
        texts += [run, f"{run}Maison {run}Jardin fin", f"Château {run}", f"Château, {run}\nÉtang"]
    return [*texts, "Anne Dupont va bien", "", None]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("runs"))
    docs = spark.createDataFrame([(n, t, "fr", f"s{n % 2}", len(t or "")) for n, t in enumerate(_texts())], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    people = spark.range(len(_texts()) + 2).select(
        F.col("id").alias("c_custkey"), F.format_string("Customer#%09d", "id").alias("c_name"), (F.col("id") % 2).cast("int").alias("c_nationkey"),
        F.lit(1.5).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment"),
    )
    people.write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame([(0, "NATION_0", 0), (1, "NATION_1", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{at}/nation.parquet")
    vectors = spark.range(6).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * 64 + i).cast("float") for i in range(64)]).alias("embedding"), (F.col("id") % 2).cast("int").alias("label"))
    vectors.write.parquet(f"{at}/embeddings.parquet")
    return at


def test_names_are_the_first_two_long_words(spark, folder):
    got = {r.c_custkey: (r.first_name, r.last_name) for r in rr.people(spark, folder).select("c_custkey", "first_name", "last_name").collect()}
    for n, text in enumerate(_texts()):
        long = [w for w in LETTERS.findall(text or "") if len(w) > 3]
        assert got[n] == ((long + ["Jean"])[0], long[1] if len(long) > 1 else "Duval")
    assert len(got) == len(_texts()) + 2


def test_words_are_those_of_the_patterns_in_the_sql(spark):
    odd = [
        "", "abc", "abcd", "abc abcd", "abcd abc", "abcd efgh", "abcd, a b 12 efghij k lmnop", "\nabcd\nefgh\n", "  éèàù ÉÈÀÙ", "ab1cdef2ghijk",
        "𝐀𝐁𝐂 𝐀𝐁𝐂𝐃 a𝐀b𝐁", "étés maison", "日本語 日本語文字 漢字漢字", "abcdabcd", "a-b-c-defg_hijk", "abcd" * 50, "ab cdef\u0085ghij", None,
    ]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    pairs = ((rr.WORD1, 1, rr.FIRST_WORD, 0), (rr.WORD2, 1, rr.SECOND_WORD, 1))
    for r in df.select("t", *[F.struct(F.regexp_extract("t", a, i).alias("a"), F.regexp_extract("t", b, j).alias("b")) for a, i, b, j in pairs]).collect():
        assert all(p.a == p.b for p in r[1:]), r


@pytest.mark.parametrize("name", [
    "recommendation_prompts", "aggir_rows", "deanonymize", "clean_leaves", "detect_gender", "clean_trace", "bloc_rows", "drop_sensitive", "emptied_containers",
    "generic_dump", "json_leaves", "mask_names_free_text", "name_leaks", "persona_contact", "personal_plan_prompts", "plan_table", "prune_containers",
    "pseudonymised_leaves", "record_schedule", "record_to_text", "restored_answers", "replace_and_map", "reverse_mapping", "assign_persona",
])
def test_query_equals_sql(spark, folder, name):
    duck = duckdb.connect()
    for t in ("documents", "customer", "nation", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    diff = differences(QUERIES[name](spark, folder).toPandas(), duck.sql(ORACLES[name]).df())
    assert diff is None, diff

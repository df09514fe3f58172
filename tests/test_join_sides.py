"""Joins whose sides grow with the records are shuffled, however small Spark takes their files for."""

from docflow.operators import privacy
from docflow.operators import retrieval as rt
from docflow.plans import care


def small(spark, at, rows, schema):
    """Rows in a Parquet file, whose size Spark knows."""
    spark.createDataFrame(rows, schema).write.parquet(str(at))
    return spark.read.parquet(str(at))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_replacements_rules_and_mappings_are_not_broadcast(spark, tmp_path):
    leaves = small(spark, tmp_path / "leaves", [(1, "note", "string", "Jean va")], "doc_id int, path string, type string, value string")
    changes = small(spark, tmp_path / "changes", [(1, "note", "Jean va", "Luc va")], "doc_id int, path string, original string, alias string")
    done = privacy.apply_replacements(leaves, changes, "doc_id")
    assert "Broadcast" not in plan(done) and [r.value for r in done.collect()] == ["Luc va"]
    rules = small(spark, tmp_path / "rules", [(1, "Jean", {"jean": "Luc"})], "doc_id int, pattern string, aliases map<string,string>")
    done = privacy.mask_leaves(leaves, rules, "doc_id")
    assert "Broadcast" not in plan(done) and [r.value for r in done.collect()] == ["Luc va"]
    mapping = small(spark, tmp_path / "mapping", [(1, {"Luc": "Jean"})], "doc_id int, mapping map<string,string>")
    answers = small(spark, tmp_path / "answers", [(1, "Luc va.", ""), (2, "Luc", "")], "query_id int, answer string, context string")
    done = care.restore_answers(answers, care.SafeRecords(leaves, mapping, leaves), "doc_id")
    assert "Broadcast" not in plan(done) and sorted(map(tuple, done.select("query_id", "answer").collect())) == [(1, "Jean va."), (2, "Luc")]


def test_records_and_contexts_are_not_broadcast(spark, tmp_path):
    texts = small(spark, tmp_path / "texts", [(1, "dossier")], "doc_id int, text string")
    requests = small(spark, tmp_path / "requests", [(1, "plan")], "query_id int, user_input string")
    blocks = small(spark, tmp_path / "blocks", [(1, 0, 1, "[DOCX1] t")], "query_id int, part int, n int, block string")
    contexts = rt.format_context(requests, blocks, blocks.limit(0), 0)
    made = care.prompts(care.SafeRecords(texts, texts, texts), "doc_id", requests, contexts, "{user_input}/{record}/{context}", "s")
    assert "Broadcast" not in plan(made) and [r.user for r in made.collect()] == ["plan/dossier/[DOCX1] t"]

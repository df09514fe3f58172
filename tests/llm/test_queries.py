"""Queries against their DuckDB SQL, and the pipeline stage by stage (``DOCFLOW_SF`` picks the folder)."""

import os
import sys

import corpus_pipeline
import pytest
from check import differences, make_duck
from docflow.llm import decontamination, exact_dedup, jaccard_join, quality
from docflow.llm.queries import ORACLES, QUERIES, table

SF = os.environ.get("DOCFLOW_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    diff = differences(QUERIES[name](spark, SF).toPandas(), make_duck(SF).sql(ORACLES[name]).df())
    assert diff is None, diff


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_entry_lists_the_operators():
    import __spark_entry__ as entry

    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert "corpus_pipeline" in sys.modules


def test_pipeline_stages(spark):
    """Each stage equals what its operator says about the stage's own input; its decisions take effect."""
    docs = table(spark, SF, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    good = stages["quality"](spark, docs, SF)
    model = quality.classify(docs, table(spark, SF, "labels"))
    assert good.columns == columns and ids(good) == ids(model.where("predicted = 1"))
    once = stages["exact_dedup"](spark, good, SF)
    assert once.columns == columns and ids(once) == ids(exact_dedup.exact_groups(good).where("kept"))
    apart = stages["near_dedup"](spark, once, SF)
    groups = jaccard_join.jaccard_components(once)
    assert apart.columns == columns and ids(apart) == ids(groups.where("doc_id = component_id OR n_shingles = 0"))
    clean = stages["decontamination"](spark, apart, SF)
    leaks = {r.doc_id for r in decontamination.find_leaks(apart, table(spark, SF, "benchmark")).collect()}
    assert clean.columns == columns and leaks and ids(clean) == [i for i in ids(apart) if i not in leaks]
    packed = stages["packing"](spark, clean, SF)
    assert sorted({r.doc_id for r in packed.collect()}) == ids(clean)
    assert ids(corpus_pipeline.run(spark, SF)) == ids(packed)


def test_pipeline_on_odd_rows(spark, docs_of, odd_texts):
    """Null, empty, long and repeated texts, null ids and clashing columns; an empty table goes through all stages."""
    from pyspark.sql import functions as F

    ids = [None, 10**9, *range(10**9, 10**9 + len(odd_texts) - 2)]
    docs = table(spark, SF, "documents").unionByName(docs_of(odd_texts, ids))
    for c in ("uid", "tag", "digest", "row", "node", "n_item", "score"):
        docs = docs.withColumn(c, F.concat_ws("-", F.lit(c), "doc_id"))
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        assert docs.columns == columns and 0 < len(rows) <= before, name
        assert all(r.node == ("node" if r.doc_id is None else f"node-{r.doc_id}") for r in rows)
        before = len(rows)
    texts = [fold for r in rows for fold in [(r.text or "").lower()]]
    assert len(set(texts)) == len(texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in rows}
    none = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0

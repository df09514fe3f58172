"""The lookup of files by name, with few names and with many."""

from docflow.operators import records


def test_few_names_meet_the_files_without_a_shuffle_of_the_index(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        names = spark.createDataFrame([("anna",), ("zz",), ("li",)], "name string")
        files = spark.createDataFrame([("x/Anna_1.json",), ("x/anna_2.json",), ("Lia.json",)], "file string")
        few = records.find_records(names, files)
        assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(records, "FEW_NAMES", 1)
        many = records.find_records(names, files)
        want = [("anna", "x/Anna_1.json", 2), ("li", "Lia.json", 1), ("zz", None, 0)]
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

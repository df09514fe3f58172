"""Streams over tables that are folders of part files, as larger tables are, or hold no rows."""

import pytest

from docflow.registry import load

QUERIES, _ = load()
TURNS = [(1, 0, "user", "bonjour"), (1, 1, "assistant", "oui ?"), (1, 2, "user", "oui"), (2, 0, "user", "demande")]


@pytest.mark.parametrize("rows", [TURNS, []])
def test_dialogue_reads_a_folder_of_part_files(spark, tmp_path, rows):
    schema = "conv_id bigint, turn int, role string, text string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "other.parquet"))
    streamed = QUERIES["confirm_dialogue_stream"](spark, str(tmp_path))
    batch = QUERIES["confirm_dialogue"](spark, str(tmp_path))
    columns = ["session", "turn", "action", "intent", "patient", "switched"]

    def got(df):
        return sorted(map(tuple, df.select(columns).collect()))

    assert got(streamed) == got(batch)
    assert len(got(streamed)) == sum(r[2] == "user" for r in rows)

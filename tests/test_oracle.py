"""Every registered query against its DuckDB SQL (``DOCFLOW_SF`` picks the folder)."""

import os

import pytest
from check import differences, make_duck

from docflow.registry import load

SF = os.environ.get("DOCFLOW_SF", "/root/testdata/sf0.001")
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def duck():
    return make_duck(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    assert not [c for c, t in df.dtypes if t.startswith(("array", "map", "struct", "variant"))]
    diff = differences(df.toPandas(), duck.sql(ORACLES[name]).df())
    assert diff is None, diff


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0

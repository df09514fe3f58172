"""The walk over records against Python's own reader; no record ends a job or is lost."""

import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docflow.operators import records, render
from docflow.plans import care


def walked(texts, **options):
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int32()), pa.array(texts, pa.string())], names=["i", "j"])
    return [r for out in records._walk(options.get("max_depth"))(iter([batch])) for r in out.to_pylist()]


def plain(value, keys=()):
    """Keys and value of each leaf, by recursion."""
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in plain(v, (*keys, k))]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in plain(v, (*keys, f"[{i}]"))]
    return [(keys, value)]


values = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**20), 10**20) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text("ab.[]\"\\é0", max_size=4), inner, max_size=3), max_leaves=12,
)


@given(values)
@settings(max_examples=200, deadline=None)
def test_walk_equals_python(value):
    rows = walked([json.dumps(value)])
    want = plain(value)
    assert len(rows) == len(want) and len({r["path"] for r in rows}) == len(rows)  # paths tell all leaves apart
    for row, (keys, leaf) in zip(rows, want, strict=True):
        assert [k if k in row["keys"] else records._quoted(k) for k in keys] == row["keys"]
        if isinstance(leaf, (dict, list)):
            assert row["type"] == "empty"
        elif isinstance(leaf, str):
            assert (row["type"], row["value"]) == ("string", leaf)
        elif leaf is None or isinstance(leaf, bool):
            assert (row["type"], row["value"]) == (("null", None) if leaf is None else ("boolean", str(leaf).lower()))
        else:
            assert row["type"] == "number" and float(row["value"]) == float(leaf)


@given(values)
@settings(max_examples=200, deadline=None)
def test_nested_parser_equals_python(value):
    for text in (json.dumps(value), json.dumps(value, ensure_ascii=False, indent=2)):
        same = json.loads(text, parse_int=records._Number, parse_float=records._float)
        assert records._parse_nested(text) == same


@pytest.mark.parametrize("text", ["", "{", "[1,", "[1 2]", '{"a"}', '{"a":}', "{,}", "[]]", '["a', "nul", "01", "[1,]", '{"a":1,}', "-", '{1:2}', "[}"])
def test_nested_parser_refuses_what_python_refuses(text):
    with pytest.raises(ValueError):
        json.loads(text)
    with pytest.raises(ValueError):
        records._parse_nested(text)


def test_any_depth_and_odd_values():
    deep = "[" * 100_000 + "1" + "]" * 100_000
    rows = walked([deep, '{"a":' * 60_000 + "{}" + "}" * 60_000, "[" * 100_000, '{"a": 1, "a": {"b": 2}}', '"\\ud800x"', "[NaN, -Infinity, 1e999]", "3", None])
    by = {}
    for r in rows:
        by.setdefault(r["i"] if "i" in r else r["id"], []).append(r)
    assert len(by[0][0]["keys"]) == 100_000 and by[1][0]["type"] == "empty" and 2 not in by and 7 not in by
    assert [(r["path"], r["value"]) for r in by[3]] == [("a.b", "2")]
    assert by[4][0]["value"].endswith("x") and [r["value"] for r in by[5]] == ["nan", "-inf", "1e999"]
    assert (by[6][0]["path"], by[6][0]["keys"]) == ("", [])


def test_batches_are_bounded(monkeypatch):
    monkeypatch.setattr(records, "BATCH_KEYS", 10)
    batch = pa.record_batch([pa.array([5, 6]), pa.array([json.dumps({"a": list(range(40))}), "[[1], 2]"])], names=["i", "j"])
    parts = [out.to_pylist() for out in records._walk(None)(iter([batch]))]
    assert max(map(len, parts)) <= 5 and [r["id"] for p in parts for r in p] == [5] * 40 + [6] * 2


def test_paths_of_containers_equal_those_of_leaves(spark):
    text = json.dumps({"a.b": {"c": [{"[0]": 1}]}, 'q"\\': {"x": 1}, "a": {"b": 2}})
    rows = records.json_leaves(spark.createDataFrame([(1, text)], "doc_id int, j string"), "doc_id", "j")
    assert {r.container for r in records.containers(rows, "doc_id").collect()} == {'["a.b"]', '["a.b"].c', '["a.b"].c[0]', '["q\\"\\\\"]', "a"}
    assert all(r.path == r.again for r in rows.withColumn("again", records.path_text(rows["keys"])).collect())


def test_odd_records_do_not_end_the_job(spark):
    texts = [
        '{"a.b": "x", "a": {"b": "y"}, "usager": {"x.y": "1", "x": {"y": "2"}}}', '{"a": 1, "a": 2}', '{"t":' * 30 + '"profond"' + "}" * 30,
        '{"social": {"blocs": [{"nom": "N", "nom.x": "1", "test": [{"r.s": "1", "r": {"s": "2"}}]}]}}', "{broken", None, "", "[]", "7",
        '{"contacts": {"a": 1}, "usager": [1, 2], "aggir": "x"}',
    ]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id int, j string")
    safe = care.safe_records(table, "doc_id", "j", "salt", 2026)
    out, lost = {r.doc_id: r.text for r in safe.texts.collect()}, {r.doc_id for r in safe.rejects.collect()}
    assert lost == {4, 5, 6} and "profond" in out[2]
    dump = render.generic_dump(records.json_leaves(table, "doc_id", "j"), "doc_id").collect()
    assert {r.doc_id for r in dump} == {0, 1, 2, 3, 9}

"""Work that must not be repeated per record or per file."""

import pyarrow as pa

from docflow.operators import records


def test_text_of_a_key_is_made_once_for_records_of_one_form(monkeypatch):
    made = []
    quoted = records._quoted
    monkeypatch.setattr(records, "_quoted", lambda key: made.append(key) or quoted(key))
    batch = pa.record_batch([pa.array(range(50)), pa.array(['{"a.b": {"c": [1, null]}, "d": ""}'] * 50)], names=["id", "json"])
    rows = [r for out in records._walk(None)(iter([batch])) for r in out.to_pylist()]
    assert made == ["a.b"]
    assert [(r["path"], r["keys"], r["type"], r["value"]) for r in rows if r["id"] == 49] == [
        ('["a.b"].c[0]', ["a.b", "c", "[0]"], "number", "1"), ('["a.b"].c[1]', ["a.b", "c", "[1]"], "null", None), ("d", ["d"], "string", ""),
    ]


def test_places_are_forgotten_between_records_of_many_forms(monkeypatch):
    monkeypatch.setattr(records, "PLACES", 3)
    batch = pa.record_batch([pa.array(range(20)), pa.array([f'{{"k{n}": {{"x": {n}, "y": [{n}]}}}}' for n in range(20)])], names=["id", "json"])
    outs = list(records._walk(None)(iter([batch])))
    assert len(outs) > 5
    rows = [(r["id"], r["path"], r["value"]) for out in outs for r in out.to_pylist()]
    assert rows == [x for n in range(20) for x in ((n, f"k{n}.x", str(n)), (n, f"k{n}.y[0]", str(n)))]

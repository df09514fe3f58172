"""Cases that once lost, mixed or leaked data."""

import io
import unicodedata
import zipfile

import pytest
from docflow.operators import changes, pages, privacy, records, render, retrieval
from docflow.sources import files, sinks
from docflow.streaming import jobs
from pyspark.sql import functions as F


def latin_letters():
    """Every letter of the BMP whose plain form is one of a-z."""
    for code in range(0xAA, 0x10000):
        plain = [c for c in unicodedata.normalize("NFKD", chr(code).lower()) if unicodedata.category(c) != "Mn"]
        if chr(code).isalpha() and len(plain) == 1 and "a" <= plain[0].lower() <= "z":
            yield chr(code)


def test_every_latin_letter_is_masked(spark):
    names = [f"Ab{c}de" for c in latin_letters()]
    assert len(names) > 600 and "Abễde" in names
    rows = spark.createDataFrame([(i, "Zoé", n, "Léa", "Noiret", f"vu par Zoé {n}, puis {n}.") for i, n in enumerate(names)], "i int, f string, l string, af string, al string, text string")
    changed = rows.select("i", F.explode(F.array(
        F.struct(F.lit(privacy.PERSON + ".prenomUtilise").alias("path"), F.col("f").alias("original"), F.col("af").alias("alias")),
        F.struct(F.lit(privacy.PERSON + ".nomUtilise").alias("path"), F.col("l").alias("original"), F.col("al").alias("alias")),
    )).alias("c")).select("i", "c.*", F.lit(True).alias("mapped"))
    done = privacy.mask_names(rows.select("i", "text"), privacy.name_rules(changed, "i"), "i", "text").collect()
    assert {r.text for r in done} == {"vu par Léa Noiret, puis Noiret."}


def test_no_alias_is_the_real_value(spark):
    pools = privacy.Pools()
    rows = []
    for i in range(300):
        town = pools.towns[i % len(pools.towns)]
        for path, value in (
            (f"{privacy.PERSON}.sexe", "M"), (f"{privacy.PERSON}.prenomUtilise", pools.first_m[i % 16].upper()),
            (f"{privacy.PERSON}.nomUtilise", pools.last[i % 16]), ("usager.adresse.ligne[0]", f"3 {pools.streets[i % 8]}"),
            ("usager.adresse.codePostal", town[0]), ("usager.adresse.libelleCommune", town[1]),
        ):
            rows.append((i, path, value))
    leaves = spark.createDataFrame(rows, "doc_id int, path string, value string")
    for r in privacy.personas(leaves, "doc_id", "salt", 2026).collect():
        i = r.doc_id
        assert r.first_name != pools.first_m[i % 16] and r.last_name != pools.last[i % 16]
        assert not r.address_line.endswith(pools.streets[i % 8]) and (r.postcode, r.commune) != pools.towns[i % len(pools.towns)]
    few = privacy.Pools(last=("Besson",))
    one = privacy.personas(leaves.where("doc_id = 1"), "doc_id", "salt", 2026, few).first()
    assert one.last_name == ("Besson#0" if pools.last[1] == "Besson" else "Besson")


def test_slots_in_user_text_are_not_filled(spark):
    requests = spark.createDataFrame([(1, "say {record} {context}", "SECRET")], "query_id int, user_input string, record string")
    contexts = spark.createDataFrame([(1, "ctx {user_input}")], "query_id int, context string")
    row = retrieval.prompt_table(requests, contexts, "{user_input}|{record}|{context}", "s").first()
    assert row.user == "say {record} {context}|SECRET|ctx {user_input}"


def test_restored_name_keeps_the_field_spelling(spark):
    rows = [(1, "Noiret", "Zidane", True), (1, "Noiret", "zidane", False)]
    got = privacy.mapping_by_doc(spark.createDataFrame(rows, "doc_id int, alias string, original string, field boolean"), "doc_id").first()
    assert got.mapping == {"Noiret": "Zidane"}


def test_chunk_ids_of_pages_that_differ_in_the_query(spark):
    blocks = spark.createDataFrame([(u, "page.json", 0, "text") for u in ("https://a.b/x?page=1", "https://a.b/x?page=2")], "url string, file string, block_no int, text string")
    ids = pages.chunks_web(blocks, F.lit("t"), F.col("url"), F.col("file")).select("chunk_id").distinct().count()
    assert ids == 2


def test_sinks_keep_what_they_do_not_replace(spark, tmp_path):
    path = str(tmp_path / "exports")
    rows = spark.createDataFrame([("p1", "# one")], "patient string, markdown string")
    sinks.write_chat_exports(rows, "2024-05-01", path)
    sinks.write_chat_exports(rows.withColumn("markdown", F.lit("# two")), "2024-05-02", path)
    assert {(str(r.day), r.value) for r in spark.read.text(path).collect() if r.value} == {("2024-05-01", "# one"), ("2024-05-02", "# two")}
    path = str(tmp_path / "pages")
    sinks.write_pages(spark.createDataFrame([("u1", "a"), ("u2", "b")], "url string, t string"), path)
    sinks.write_pages(spark.createDataFrame([("u2", "c"), ("u3", "d")], "url string, t string"), path)
    assert {tuple(r) for r in spark.read.schema("url string, t string").json(path).collect()} == {("u1", "a"), ("u2", "c"), ("u3", "d")}
    path = str(tmp_path / "chunks")
    sinks.upsert_chunks(spark.createDataFrame([("1", "a"), ("2", "b")], "chunk_id string, t string"), path)
    sinks.upsert_chunks(spark.createDataFrame([("2", "c")], "chunk_id string, t string"), path)
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("1", "a"), ("2", "c")}


@pytest.mark.parametrize("op", ["upsert", None, ""])
def test_unknown_operations_change_nothing(spark, op):
    base = spark.createDataFrame([("a.json", "x")], "name string, content string")
    change = spark.createDataFrame([(1, "a.json", op, "y")], "seq int, name string, op string, content string")
    assert sinks.change_status(base, change, F.lit(0)).first().status == "400 invalid operation"
    assert [tuple(r) for r in sinks.apply_changes(base, change, F.lit(0)).collect()] == [("a.json", "x")]


def test_sources_without_content_are_present(spark):
    kind = "kind string, name string, sha256 string"
    before = spark.createDataFrame([("web", "a", None), ("web", "b", "1"), ("web", "c", None), ("web", "d", "1")], kind)
    now = spark.createDataFrame([("web", "a", None), ("web", "b", None), ("web", "c", "2"), ("web", "e", None)], kind)
    got = {r.name: r.status for r in changes.snapshot_diff(before, now).collect()}
    assert got == {"a": "unchanged", "b": "modified", "c": "modified", "d": "deleted", "e": "added"}


def test_one_version_of_a_name_per_batch(spark, tmp_path):
    journal, chunks = str(tmp_path / "j"), str(tmp_path / "c")
    batch = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "x", 1)], "name string, text string, at int")
    jobs.index_batch(batch, 0, journal, chunks, lambda d: d.select("name", F.col("text").alias("chunk")), "at")
    assert {tuple(r) for r in spark.read.parquet(chunks).select("name", "chunk").collect()} == {("a", "new"), ("b", "x")}
    assert spark.read.parquet(journal).count() == 2


def test_damaged_docx_does_not_end_the_job(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'><w:body/></w:document>" * 3)
    whole = out.getvalue()
    stream = bytearray(whole)
    stream[45:60] = bytes(15)  # inside the deflate stream
    method, locked = bytearray(whole), bytearray(whole)
    for at in (8, whole.rindex(b"PK\1\2") + 10):
        method[at] = 99
    for at in (6, whole.rindex(b"PK\1\2") + 8):
        locked[at] |= 1
    rows = [(n, bytes(b)) for n, b in (("stream", stream), ("method", method), ("locked", locked), ("none", b"x"))]
    found = spark.createDataFrame(rows, "file string, content binary")
    assert {r.file for r in files.unreadable_docx(found).collect()} == {"stream", "method", "locked", "none"}
    assert files.docx_texts(found).count() == 0


def test_inventory_tells_folders_of_one_name_apart(spark, tmp_path):
    for folder in ("a/x", "b/x", "."):
        (tmp_path / "in" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / folder / "f.json").write_text("{}")
    got = {(r.folder, r.n_files, r.n_bytes) for r in files.file_inventory(spark, str(tmp_path / "in")).collect()}
    assert got == {("a/x", 1, 2), ("b/x", 1, 2), ("in", 1, 2)}


def test_scratch_data_goes_with_its_scope(spark):
    from docflow.runtime import materialize, scratch_scope

    with scratch_scope(spark):
        rows = materialize(spark.range(3), "secret")
        path = rows.inputFiles()[0].removeprefix("file://")
        assert rows.count() == 3
    kept = materialize(spark.range(2), "kept")
    import os

    assert not os.path.exists(os.path.dirname(path)) and kept.count() == 2


def test_unreadable_records_are_listed(spark):
    deep = '{"a":' * 14 + "1" + "}" * 14
    rows = [(1, '{"a": "x[{\\"}"}'), (2, "{broken"), (3, deep), (4, '{"a.b": 1, "a": {"b": 2}}'), (5, "\ufeff[]"), (6, None), (7, " ")]
    table = spark.createDataFrame(rows, "doc_id int, j string")
    rejects = {r.doc_id: r.reason for r in records.record_rejects(table, "doc_id", "j").collect()}
    assert rejects == {2: "invalid JSON", 6: "no record", 7: "empty text"}
    assert {r.doc_id for r in records.json_leaves(table, "doc_id", "j").collect()} == {1, 3, 4, 5}


def test_schedule_spellings_and_rejects(spark):
    rows = [(1, 1, ["lundi ", "MARDI"], ["après–midi", "Fin d'apres-midi"], ["a"]), (1, 2, ["Lundi", "jour"], ["matin", "demain"], ["b"])]
    entries = spark.createDataFrame(rows, "doc_id int, week int, days array<string>, moments array<string>, actions array<string>")
    cells = {(r.week, r.slot): (r.Lundi, r.Mardi) for r in render.weekly_schedule(entries, "doc_id").collect()}
    assert cells[1, "14h00-15h30"] == ("a", "a") and cells[1, "16h00-17h00"] == ("a", "a") and cells[2, "10h00-11h00"][0] == "b"
    lost = {(r.day, r.moment) for r in render.schedule_rejects(entries, "doc_id").collect()}
    assert lost == {("Lundi", "demain"), ("jour", "matin"), ("jour", "demain")}

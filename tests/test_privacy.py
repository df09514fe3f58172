"""Privacy properties on hand-made records."""

import json

import pytest
from pyspark.sql import functions as F

from docflow.operators import privacy, records, render
from docflow.plans import care

RECORD = {
    "usager": {
        "Informations d'état civil": {"clientId": "C1", "personnePhysique": {
            "nomFamille": "Hébert", "nomUtilise": "Hébert", "prenomUtilise": "Zoé", "dateNaissance": "1931-02-03", "sexe": "F",
            "situationFamiliale": None, "communeNaissance": {"libelleCommune": "Gap"}}},
        "adresse": {"ligne": ["4 rue X"], "codePostal": "05000", "libelleCommune": "Gap"}, "mouvement": {"service": "S"}},
    "contacts": [{"personnePhysique": {"civilite": "Mme", "prenomUtilise": "Lou", "nomUtilise": "Autre"}, "numRpps": "9", "vide": {}}],
    "sante": {"blocs": [{"nom": "Note", "questionReponse": [{"question": "Q", "reponse": "Mme HEBERT et Zoé  Hébert; zoe hebert, Hébertin. M. Hébert Zoé"}]}]},
    "liste": [[1, [2, {"a": [True, None, "null"]}]]],
}


def leaves(spark, record=RECORD):
    return records.json_leaves(spark.createDataFrame([(1, json.dumps(record, ensure_ascii=False))], "doc_id int, j string"), "doc_id", "j")


def test_leaves_cover_nesting_and_cleaning_is_idempotent(spark):
    rows = leaves(spark)
    got = {r.path: (r.type, r.value) for r in rows.collect()}
    assert got["liste[0][1][1].a[0]"] == ("boolean", "true")
    assert got["contacts[0].vide"][0] == "empty"
    once = records.clean_leaves(rows)
    kept = {r.path for r in once.collect()}
    assert records.clean_leaves(once).count() == len(kept)
    assert f"{privacy.PERSON}.situationFamiliale" in kept
    assert not any("communeNaissance" in p or "numRpps" in p or "mouvement" in p or "vide" in p for p in kept)
    assert "liste[0][1][1].a" in {r.container for r in records.containers(once, "doc_id").collect()}


def test_depth_is_limited_on_request_alone(spark):
    rows = spark.createDataFrame([(1, "[" * 5 + "1" + "]" * 5)], "doc_id int, j string")
    assert [r.path for r in records.json_leaves(rows, "doc_id", "j").collect()] == ["[0]" * 5]
    assert records.json_leaves(rows, "doc_id", "j", max_depth=3).count() == 0
    assert [r.reason for r in records.record_rejects(rows, "doc_id", "j", max_depth=3).collect()] == ["nested deeper than 3"]


def test_plan_hides_and_restores(spark):
    source = spark.createDataFrame([(1, json.dumps(RECORD, ensure_ascii=False))], "doc_id int, j string")
    safe = care.safe_records(source, "doc_id", "j", "salt", 2024)
    text, mapping = safe.texts.first().text, safe.mapping.first().mapping
    for secret in ("HEBERT", "Hébert;", "Zoé", "zoe hebert", "C1", "4 rue X", "1931-02-03", "Lou", "Autre"):
        assert secret not in text
    assert "Hébertin" in text
    alias = {v: k for k, v in mapping.items()}
    answer = spark.createDataFrame([(1, f"{alias['C1']}: {alias['4 rue X']} ({alias['Lou']}).", "")], "query_id int, answer string, context string")
    assert care.restore_answers(answer, safe, "doc_id").first().answer == "C1: 4 rue X (Lou)."


def test_same_salt_same_persona_and_salt_is_required(spark):
    rows = records.clean_leaves(leaves(spark))
    one, two, other = (sorted(map(tuple, privacy.replacements(rows, "doc_id", s, 2024).collect())) for s in ("a", "a", "b"))
    assert one == two != other
    with pytest.raises(ValueError, match="salt"):
        privacy.replacements(rows, "doc_id", "", 2024)


def test_colliding_aliases_get_numbers(spark):
    record = json.loads(json.dumps(RECORD))
    record["usager"]["Informations d'état civil"]["personnePhysique"]["nomFamille"] = "Durand"
    rows = privacy.replacements(records.clean_leaves(leaves(spark, record)), "doc_id", "s", 2024).where("mapped").collect()
    by_alias = {}
    for r in rows:
        by_alias.setdefault(r.alias, set()).add(r.original)
    assert all(len(v) == 1 for v in by_alias.values())
    family = {r.path: r.alias for r in rows}
    assert family[f"{privacy.PERSON}.nomUtilise"] == family[f"{privacy.PERSON}.nomFamille"] + "#2"


def mask(spark, text, compat=False):
    df = spark.createDataFrame([(1, text)], "doc_id int, value string")
    changes = spark.createDataFrame(
        [(1, f"{privacy.PERSON}.prenomUtilise", "Zoé", "Ada", True), (1, f"{privacy.PERSON}.nomUtilise", "Hébert", "Noir", True)],
        "doc_id int, path string, original string, alias string, mapped boolean",
    )
    return privacy.mask_names(df, privacy.name_rules(changes, "doc_id", compat), "doc_id").first()


def test_name_variants(spark):
    assert mask(spark, "Zoé Hébert, HÉBERT  Zoe; M. hebert; Mme Zoé Hébert; Zoéline").value == "Ada Noir, Noir Ada; M. Noir; Mme Ada Noir; Zoéline"
    assert mask(spark, "Mme Zoé Hébert, M Hébert", compat=True).value == "Mme Noir, Ada Noir"
    seen = {(s.alias, s.original) for s in mask(spark, "HEBERT puis hébert").seen}
    assert seen == {("Noir", "HEBERT"), ("Noir", "hébert")}


def test_deanonymize_prefers_long_aliases_once(spark):
    df = spark.createDataFrame([("Ada Noir a vu Ada (CLT-1, CLT-12) $1 Adaline", {"Ada": "Noir", "Ada Noir": r"Z\1$", "CLT-1": "A", "CLT-12": "B"})], "t string, m map<string,string>")
    assert df.select(privacy.deanonymize(F.col("t"), F.col("m")).alias("r")).first().r == r"Z\1$ a vu Noir (A, B) $1 Adaline"


def test_age_distribution_and_gender(spark):
    table = privacy.age_distribution()
    assert table[0][0] == 60 and table[-1] == (100, 1.0) and all(a[1] < b[1] for a, b in zip(table, table[1:]))
    df = spark.createDataFrame([("H", None), (" ", "Mlle"), ("x", "Dr"), (None, None)], "s string, t string")
    assert [r.g for r in df.select(privacy.detect_gender(F.col("s"), F.col("t")).alias("g")).collect()] == ["M", "F", None, None]


def test_find_records_finds_every_match(spark):
    names = spark.createDataFrame([("Deloin",), ("a",), ("zz",), ("ÉL",)], "name string")
    files = spark.createDataFrame([(f,) for f in ("/d/poa_DELOIN_2.json", "poa_deloin_1.json", "élan.json", "b")], "file string")
    got = {r.name: (r.file, r.n_matches) for r in records.find_records(names, files).collect()}
    assert got == {"Deloin": ("/d/poa_DELOIN_2.json", 2), "a": ("/d/poa_DELOIN_2.json", 3), "zz": (None, 0), "ÉL": ("élan.json", 1)}


def test_text_without_contacts(spark):
    text = render.record_text(leaves(spark, {"usager": {"adresse": {"ligne": "4 rue"}}}), "doc_id").first().text
    assert "- Aucun contact renseigné" in text and "- Adresse : 4 rue," in text

"""Scalar rules on hand-made values."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from docflow.functions import text as tx
from docflow.functions import urls as ux


def apply(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "fn, given, expected",
    [
        (tx.norm_space, [" a \t b\x1cc "], ["a b c"]),
        (tx.norm_for_eq, ["﻿Été​  ﬁn ", "Straße", None], ["été fin", "strasse", ""]),
        (tx.strip_accents, ["Éàç é"], ["Eac e"]),
        (tx.normalize_token, [" M. ", "_Féminin-", "Mme"], ["m", "feminin", "mme"]),
        (tx.looks_shouting, ["ABc", "ABCDe", "AB", "A1B2C3"], [False, True, False, True]),
        (
            tx.smart_title_fr,
            ["CHU de LYON", "de la rue", "rue d'ALZON", "l’hôpital DU bois"],
            ["CHU de LYON", "De la Rue", "Rue d’Alzon", "l’Hôpital DU Bois"],
        ),
        (tx.norm_bool, ["vrai", "FAUX", "", "peut-être"], ["Oui", "Non", "Non renseigné", "peut-être"]),
        (
            tx.norm_date,
            ["2024-1-5", "05/03/2024 14:30", "1h36min", "", "31/02/2024", None],
            ["2024-01-05", "2024-03-05", "1h36min", "Non renseigné", "31/02/2024", "Non renseigné"],
        ),
        (tx.norm_number, ["8,46", "33.3", "1e3", "nan", "x 1", "12d"], ["8.46", "33.3", "1e3", "nan", "x 1", "12d"]),
        (
            tx.parse_any_date,
            ["2024-05-17", "2024-05-17T08:09:10Z", "May 17, 2024", "bientôt", "2024-05-17 08:09:10.250+0100"],
            ["2024-05-17T00:00:00", "2024-05-17T08:09:10+00:00", "2024-05-17T00:00:00", "bientôt", "2024-05-17T08:09:10.250000+01:00"],
        ),
        (lambda x: tx.shorten_ellipsis(x, 10), ["short", "aaaaaa bbbbbb", "aa bbbbbbbbbbbb"], ["short", "aaaaaa…", "aa bbbbbb…"]),
        (tx.is_irrelevant_text, ["abc", "Menu du jour", "Bonjour à tous", None], [True, True, False, True]),
        (tx.validate_patient_name, ["dUPONT", "Jean Dupont", "Nom patient introuvable"], ["Dupont", None, None]),
        (tx.patient_key, [" jean  dupont", None, " "], ["JEAN_DUPONT", "UNKNOWN", "UNKNOWN"]),
        (ux.url_domain, ["https://WWW.Example.org:80/x", "/rel"], ["example.org:80", ""]),
        (ux.url_blocked, ["", "mailto:x", "/a.PDF?x", "/a.pdfx", "#top"], [True, True, True, False, True]),
        (ux.slug_title, ["https://x.fr/a/bilan-sanguin_%C3%A9t%C3%A9-12/", "https://x.fr/fr/"], ["Bilan sanguin été", ""]),
        (ux.page_file_name, ["https://x.fr/a/b/?p=2", "https://x.fr"], ["x.fr_a_b.json", "x.frindex.json"]),
        (ux.url_to_filename, ["https://x.fr/a b/c", ""], ["x.fr_a_b_c.json", "index.json"]),
    ],
)
def test_values(spark, fn, given, expected):
    assert apply(spark, fn, given) == expected


BASES = ["https://x.fr/a/b/c.html?q=1#f", "https://x.fr/a/b/", "http://x.fr", "https://x.fr/a//b/../c"]
LINKS = [
    "d", "./d", "../d", "../../d", "../../../d", "/d/./e/../f", "?p=2", "#g", "//y.fr/z", "https://y.fr/../z", "mailto:a@b",
    "d/", ".", "..", "", "d?x=/../y", "d#h", "http:d", "a//b",
]


def test_url_join_is_urljoin(spark):
    rows = spark.createDataFrame([(b, l) for b in BASES for l in LINKS], "b string, l string")
    for r in rows.select("b", "l", ux.url_join("b", "l").alias("u")).collect():
        assert r.u == urljoin(r.b, r.l), (r.b, r.l)

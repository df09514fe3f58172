"""Records to readable text, typed rows and tables.

Leaves are grouped into *items* (a contact, a question, an action, ...). An item is small whatever the
size of the record, and every line of the text is built from one item.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.text import auto_case, constant, iso_date, norm_space, norm_text, strip_accents
from docflow.functions.wordlists import MOMENT_SLOTS, NOT_GIVEN, SLOTS, WEEK_DAYS

_N = r"(?:\[([0-9]+)\])?"
# (order, kind, path pattern with groups i, j, field). The first match wins.
_KINDS = (
    ("01", "usager", r"^usager()()\.(.+)$"),
    ("02", "contact", rf"^contacts{_N}()\.?(.*)$"),
    ("03", "aggir_sub", rf"^aggir\.AggirVariable{_N}\.AggirSousVariable{_N}\.(.+)$"),
    ("03", "aggir_var", rf"^aggir\.AggirVariable{_N}()\.(.+)$"),
    ("03", "aggir", r"^aggir()()\.([^.\[]+)$"),
    *[
        row
        for order, top in (("04", "social"), ("05", "sante"))
        for row in (
            (order, "question", rf"^{top}\.blocs{_N}\.questionReponse{_N}\.?(.*)$"),
            (order, "test", rf"^{top}\.blocs{_N}\.test{_N}\.?(.*)$"),
            (order, "measure", rf"^{top}\.blocs{_N}\.mesureConstante{_N}\.?(.*)$"),
            (order, "comorbidity", rf"^{top}\.blocs{_N}\.comorbidites{_N}\.?(.*)$"),
            (order, "bloc", rf"^{top}\.blocs{_N}()\.?(.*)$"),
        )
    ],
    ("06", "device", rf"^dispositifs{_N}()\.?(.*)$"),
    ("07", "material", rf"^materiels{_N}()\.?(.*)$"),
    *[
        row
        for order, top in (("08", "poaSocial"), ("09", "poaSante"))
        for row in (
            (order, "plan_action", rf"^{top}\.problemes{_N}\.planActions{_N}\.?(.*)$"),
            (order, "problem", rf"^{top}\.problemes{_N}()\.?(.*)$"),
        )
    ],
    ("10", "autonomy", rf"^poaAutonomie\.actions{_N}()\.?(.*)$"),
    ("11", "extra", r"^()()(.+)$"),
)
_RANK = {"aggir": 0, "bloc": 0, "problem": 0, "aggir_var": 1, "aggir_sub": 2, "question": 1, "test": 2,
         "measure": 3, "extra_bloc": 4, "comorbidity": 5, "plan_action": 1}

_HEADINGS = {
    "01": "### Présentation de la personne accompagnée",
    "02": "\n### Contacts identifiés",
    "03": "\n### AGGIR",
    "04": "\n### Social",
    "05": "\n### Santé",
    "06": "\n### Dispositifs",
    "07": "\n### Matériels",
    "08": "\n### poaSocial",
    "09": "\n### poaSante",
    "10": "\n### poaAutonomie",
    "11": "\n### Informations supplémentaires",
}


def record_items(leaves: DataFrame, doc_id: str) -> DataFrame:
    """``doc_id, section, kind, i, j, fields map<field, struct<raw, auto, keep>>``, one row per item."""
    def found(order: str, name: str, pattern: str) -> Column:
        return F.struct(
            F.lit(order).alias("section"), F.lit(name).alias("kind"),
            *[F.regexp_extract("path", pattern, n).alias(c) for n, c in enumerate(("i", "j", "field"), start=1)],
        )

    def number(x: str) -> Column:  # a cast that fails inside raises and catches an exception for every leaf
        return F.coalesce(F.when(F.col(x) != "", F.col(x).try_cast("int")), F.lit(0))

    # the name at the top tells which patterns can match, so a leaf meets a few of them only
    *known, extra = _KINDS
    tops = {}
    for row in known:
        tops.setdefault(re.match(r"\^(\w+)", row[2])[1], []).append(row)
    place = found(*extra)
    for top, rows in tops.items():
        inner = found(*extra)
        for row in reversed(rows):
            inner = F.when(F.col("path").rlike(row[2]), found(*row)).otherwise(inner)
        place = F.when(F.col("path").startswith(top), inner).otherwise(place)
    value = F.struct(F.col("value").alias("raw"), auto_case(F.col("keep")).alias("auto"), F.col("keep"))
    normal = leaves.where(F.col("type") != "empty").select(doc_id, "path", "value", norm_text("value", case_mode="keep").alias("keep"))
    placed = normal.select(doc_id, place.alias("p"), value.alias("value"))
    rows = placed.select(
        doc_id, "p.section", "p.kind", number("p.i").alias("i"), number("p.j").alias("j"), "p.field", "value",
    )
    return rows.groupBy(doc_id, "section", "kind", "i", "j").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields")
    )


# ------------------------------------------------------------------ reading an item

def _auto(*names: str, default: str = "") -> Column:
    found = [F.nullif(F.col("fields")[n]["auto"], F.lit("")) for n in names]
    return F.coalesce(*found, F.lit(default))


def _keep(*names: str, default: str = "") -> Column:
    found = [F.nullif(F.col("fields")[n]["keep"], F.lit("")) for n in names]
    return F.coalesce(*found, F.lit(default))


def _date(name: str) -> Column:
    return iso_date(F.col("fields")[name]["keep"])


def _entries(predicate) -> Column:
    return F.filter(F.map_entries("fields"), predicate)


def _filled(e: Column) -> Column:
    return F.coalesce(e["value"]["raw"], F.lit("")) != ""


def _list_of(name: str, sep: str = ", ") -> Column:
    """A list field (or a single value in its place) as joined text."""
    items = _entries(lambda e: e["key"].rlike(rf"^{name}(\[[0-9]+\])?$") & (e["value"]["auto"] != ""))
    order = F.array_sort(items, lambda a, b: _index_of(a["key"]) - _index_of(b["key"]))
    joined = F.array_join(F.transform(order, lambda e: e["value"]["auto"]), sep)
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(NOT_GIVEN))


def _index_of(key: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(key, r"\[([0-9]+)\]$", 1), F.lit("")).cast("int"), F.lit(0))


def _pairs(between: str, sep: str) -> Column:
    """Every filled field as ``key<between>value``; a bare value stands alone."""
    shown = F.transform(
        _entries(_filled),
        lambda e: F.when(e["key"] == "", e["value"]["auto"]).otherwise(F.concat(e["key"], F.lit(between), e["value"]["auto"])),
    )
    return F.array_join(shown, sep)


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _address(prefix: str) -> Column:
    head = prefix.replace(".", r"\.")
    street = _list_of(f"{head}ligne", " ")
    town = _text(street, ", ", _keep(f"{prefix}codePostal"), " ", _auto(f"{prefix}libelleCommune"))
    return F.rtrim(town)


def _join_names(*values: Column, sep: str) -> Column:
    kept = F.filter(F.array(*values), lambda v: v != "")
    return F.coalesce(F.nullif(F.array_join(kept, sep), F.lit("")), F.lit(NOT_GIVEN))


def _others(known: tuple[str, ...], indent: str, header: str) -> Column:
    """Unknown fields of an item as an indented dump below a header line; no lines when none."""
    pattern = r"^(" + "|".join(known) + r")($|[.\[])"
    rest = _entries(lambda e: _filled(e) & (e["key"] != "") & ~e["key"].rlike(pattern))
    lines = F.transform(rest, lambda e: _text(indent + "  ", e["key"], ": ", e["value"]["auto"]))
    return F.when(F.size(rest) > 0, F.concat(F.array(F.lit(indent[:-2] + header)), lines)).otherwise(
        F.array().cast("array<string>")
    )


def _adverbs(prefix: str = "") -> Column:
    """``S / T / C / H`` answers of an AGGIR variable, a dash where there is none."""
    def answer(letter: str) -> Column:
        asked = F.get(
            _entries(lambda e: e["key"].rlike(rf"^{prefix}AggirAdverbes(\[[0-9]+\])?\.Question$") & (e["value"]["keep"] == letter)), F.lit(0)
        )
        reply = F.col("fields")[F.replace(asked["key"], F.lit("Question"), F.lit("Reponse"))]["keep"]
        return F.coalesce(F.nullif(reply, F.lit("")), F.lit("–"))

    s, t, c, h = (answer(x) for x in "STCH")
    return _text("Adverbes S/T/C/H : ", s, " / ", t, " / ", c, " / ", h)


def _usager_lines() -> Column:
    p = "Informations d'état civil.personnePhysique."
    c = "contactInfosPersonnels."
    return F.array(
        _text("- Nom : ", _auto(p + "nomFamille", p + "nomUtilise", default=NOT_GIVEN)),
        _text("- Prénom : ", _auto(p + "prenomUtilise", p + "prenom", default=NOT_GIVEN)),
        _text("- Sexe : ", _auto(p + "sexe", default=NOT_GIVEN)),
        _text("- Date de naissance : ", F.coalesce(_date(p + "dateNaissance"), F.lit(NOT_GIVEN))),
        _text("- Situation familiale : ", _auto(p + "situationFamiliale", default=NOT_GIVEN)),
        _text("- Adresse : ", _address("adresse.")),
        _text("- Tel. domicile : ", _keep(c + "domicile", default=NOT_GIVEN)),
        _text("- Tel. mobile : ", _keep(c + "mobile", default=NOT_GIVEN)),
        _text("- Courriel : ", _keep(c + "mailMSSANTE", c + "mailPro", c + "mail", default=NOT_GIVEN)),
    )


def _contact_lines() -> Column:
    p, c = "personnePhysique.", "contactInfosPersonnels."
    who = _join_names(_auto(p + "prenomUtilise"), _auto(p + "nomUtilise"), sep=" ")
    role = _join_names(_auto("role"), _auto("natureLien"), _auto("typeStructure"), sep=", ")
    phone = _join_names(_keep(c + "mobile"), _keep(c + "domicile"), sep=", ")
    number = (F.col("i") + 1).cast("string")
    known = ("personnePhysique", "contactInfosPersonnels", "adresse", "role", "natureLien", "typeStructure", "structure", "finessET")
    lines = F.array(
        _text("- Contact ", number, " : ", who, " (", role, ")"),
        _text("  - Téléphone : ", phone),
        _text("  - Email : ", _keep(c + "mailMSSANTE", c + "mailPro", c + "mail", default=NOT_GIVEN)),
        _text("  - Adresse : ", _address("adresse.")),
    )
    plain = F.array(_text("- Contact ", number, " : ", _auto("")))
    full = F.concat(lines, _others(known, "    ", "- Détails supplémentaires :"))
    return F.when(F.map_contains_key("fields", ""), plain).otherwise(full)


def _aggir_lines() -> Column:
    return F.array(
        _text("- GIR : ", _keep("GIR", default=NOT_GIVEN)),
        _text("- Date de modification : ", _keep("dateModification", default=NOT_GIVEN)),
        _text("- Temps d'aide/24h : ", _keep("TempsAide24H", default=NOT_GIVEN)),
    )


def _aggir_item(lead: str, default: str, indent: str) -> Column:
    note = _auto("Commentaires")
    lines = F.array(
        _text(lead, _auto("Nom", default=default), " — Résultat : ", _keep("Resultat", default=NOT_GIVEN)),
        F.when(note != "", _text(indent + "Commentaires : ", note)),
        _text(indent, _adverbs()),
    )
    return F.array_compact(lines)


def _bloc_lines() -> Column:
    known = ("nom", "questionReponse", "test", "mesureConstante", "comorbidites")
    head = F.array(_text("\n- Bloc : ", _auto("nom", default="Sans nom")))
    plain = F.array(_text("- Bloc : ", _auto("")))
    return F.when(F.map_contains_key("fields", ""), plain).otherwise(F.concat(head, _others(known, "    ", "• Détails du bloc :")))


def _dated(text: Column, name: str, before: str, after: str) -> Column:
    day = _date(name)
    given = F.coalesce(F.col("fields")[name]["raw"], F.lit("")) != ""
    return F.when(given, _text(text, before, day, after)).otherwise(text)


def _test_line() -> Column:
    base = _text("  • Test — ", _auto("nom", default="?"), " : ", _keep("resultat", "résultat", default=NOT_GIVEN))
    return _dated(base, "dateTest", " (le ", ")")


def _measure_line() -> Column:
    unit, state = _keep("unite"), _auto("statut", "status")
    base = _text(
        "  • Mesure — ", _auto("type", default="?"), " : ", _keep("valeur", "value", default=NOT_GIVEN),
        F.when(unit != "", _text(" ", unit)).otherwise(""),
        F.when((state != "") & (state != NOT_GIVEN), _text(" (", state, ")")).otherwise(""),
    )
    return _dated(base, "dateSaisie", " le ", "")


def _problem_lines() -> Column:
    worry = _join_names(_auto("preoccupationPatient"), _auto("preoccupationProfessionel"), sep=" / ")
    return F.array(
        _text("\n- Bloc : ", _auto("nomBloc", default="Sans nom"), " (Statut: ", _auto("statut", default="?"), ")"),
        _text("  • Problème : ", _auto("problemePose", default=NOT_GIVEN)),
        _text("  • Objectifs : ", _auto("objectifs", default=NOT_GIVEN)),
        _text("  • Préoccupation patient/professionnel : ", worry),
    )


def _autonomy_lines() -> Column:
    low = F.lower(_keep("dureeAction"))
    lasting = (
        F.when(low.isin("true", "vrai", "oui"), "Oui").when(low.isin("false", "faux", "non"), "Non")
        .otherwise(_auto("dureeAction", default=NOT_GIVEN))
    )
    free = [
        F.when(_auto(k) != "", _text(f"  • {k} : ", _auto(k))) for k in ("detailAction", "critereEvaluation", "resultatActions")
    ]
    known = (
        "typeAction", "personneChargeAction", "joursIntervention", "dateDebutAction", "dureeAction", "dureePassage",
        "momentJournee", "typeAide", "actions", "detailAction", "critereEvaluation", "resultatActions",
    )
    start = F.coalesce(_date("dateDebutAction"), F.lit(NOT_GIVEN))
    lines = F.array(
        _text("\n- Type d'action : ", _auto("typeAction", default=NOT_GIVEN)),
        _text("  • Personnes en charge : ", _list_of("personneChargeAction")),
        _text("  • Jours d'intervention : ", _list_of("joursIntervention")),
        _text("  • Début : ", start),
        _text("  • Durée action : ", lasting),
        _text("  • Durée passage : ", _keep("dureePassage", default=NOT_GIVEN)),
        _text("  • Moments : ", _list_of("momentJournee")),
        _text("  • Type d'aide : ", _list_of("typeAide")),
        _text("  • Actions : ", _list_of("actions")),
        *free,
    )
    return F.concat(F.array_compact(lines), _others(known, "    ", "• Détails de l'action :"))


def item_lines(items: DataFrame) -> DataFrame:
    """Add ``rank`` (place inside its parent) and ``lines``."""
    kind = F.col("kind")

    def one(line: Column) -> Column:
        return F.array(line)

    extras = F.transform(_entries(_filled), lambda e: _text(e["key"], ": ", e["value"]["auto"]))
    lines = (
        F.when(kind == "usager", _usager_lines())
        .when(kind == "contact", _contact_lines())
        .when(kind == "aggir", _aggir_lines())
        .when(kind == "aggir_var", _aggir_item("\n- ", "(Variable)", "  "))
        .when(kind == "aggir_sub", _aggir_item("  * ", "(Sous-variable)", "    "))
        .when(kind == "bloc", _bloc_lines())
        .when(kind == "question", one(F.when(F.map_contains_key("fields", ""), _text("  • ", _auto(""))).otherwise(
            _text("  • ", _auto("question", default="?"), " : ", _auto("reponse", default=NOT_GIVEN)))))
        .when(kind == "test", one(F.when(F.map_contains_key("fields", ""), _text("  • Test — ", _auto(""))).otherwise(_test_line())))
        .when(kind == "measure", one(F.when(F.map_contains_key("fields", ""), _text("  • Mesure — ", _auto(""))).otherwise(_measure_line())))
        .when(kind == "comorbidity", one(_text("  • Comorbidité — ", _pairs(": ", " | "))))
        .when(kind.isin("device", "material"), one(_text("- ", _pairs(": ", " | "))))
        .when(kind == "problem", _problem_lines())
        .when(kind == "plan_action", one(_text("  • Action : ", _pairs("=", "; "))))
        .when(kind == "autonomy", _autonomy_lines())
        .otherwise(extras)
    )
    rank = F.lit(0)
    for name, place in _RANK.items():
        rank = F.when(kind == name, place).otherwise(rank)
    # AGGIR sub-variables follow their own variable; the header comes before all variables
    first = F.when(kind == "aggir", -1).otherwise(F.col("i"))
    return items.withColumn("rank", rank).withColumn("i", first).withColumn("lines", lines)


def record_text(leaves: DataFrame, doc_id: str) -> DataFrame:
    """``doc_id, text``: the whole record as sectioned text, sections in their fixed order."""
    lined = item_lines(record_items(leaves, doc_id))
    heading = constant(_HEADINGS)
    body = F.transform(
        F.array_sort(F.collect_list(F.struct("i", "rank", "j", "lines"))), lambda x: F.array_join(x["lines"], "\n")
    )
    sections = lined.groupBy(doc_id, "section").agg(F.array_join(body, "\n").alias("body"))
    full = sections.select(doc_id, "section", F.concat(heading[F.col("section")], F.lit("\n"), F.col("body")).alias("part"))
    always = F.array(
        *[F.struct(F.lit(s).alias("section"), F.lit(t).alias("part")) for s, t in (("01", _HEADINGS["01"]), ("02", _HEADINGS["02"] + "\n- Aucun contact renseigné"))]
    )
    docs = full.groupBy(doc_id).agg(F.collect_list(F.struct("section", "part")).alias("parts"))
    missing = F.filter(always, lambda a: ~F.exists("parts", lambda p: p["section"] == a["section"]))
    ordered = F.array_sort(F.concat("parts", missing))
    return docs.select(doc_id, F.array_join(F.transform(ordered, lambda p: p["part"]), "\n").alias("text"))


def generic_dump(leaves: DataFrame, doc_id: str) -> DataFrame:
    """``doc_id, line_key, line``: indented dump of any record, one row per leaf or container.

    ``line_key`` sorts the lines of a document; keys are in alphabetical order, list items by number.
    """
    def label(k: Column) -> Column:
        number = (F.regexp_extract(k, r"^\[([0-9]+)\]$", 1).try_cast("int") + 1).cast("string")
        return F.when(k.startswith("["), _text("- élément ", number)).otherwise(k)

    def sort_part(k: Column) -> Column:
        number = F.regexp_extract(k, r"^\[([0-9]+)\]$", 1)
        return F.when(k.startswith("["), F.lpad(number, 9, "0")).otherwise(k)

    def sort_key(keys: Column) -> Column:
        return F.array_join(F.transform(keys, sort_part), "\u0001")

    depth = F.size("keys")
    value = F.coalesce(F.nullif(auto_case(F.col("keep")), F.lit("")), F.lit(NOT_GIVEN))
    last = F.element_at("keys", -1)
    normal = leaves.where((depth > 0) & (F.col("type") != "empty")).select(doc_id, "keys", norm_text("value", case_mode="keep").alias("keep"))
    own = normal.select(
        doc_id, sort_key(F.col("keys")).alias("line_key"),
        F.concat(F.repeat(F.lit("  "), depth - 1), F.when(last.startswith("["), _text("- ", value)).otherwise(_text(last, ": ", value))).alias("line"),
    )
    heads = F.transform(F.sequence(F.lit(1), depth - 1), lambda n: F.slice("keys", F.lit(1), n))
    containers = (
        leaves.where((depth > 1) & (F.col("type") != "empty"))
        .select(doc_id, F.explode(heads).alias("k"))
        .select(
            doc_id, sort_key(F.col("k")).alias("line_key"),
            F.concat(F.repeat(F.lit("  "), F.size("k") - 1), label(F.element_at("k", -1)), F.lit(":")).alias("line"),
        )
        .distinct()
    )
    return own.unionByName(containers)


# ------------------------------------------------------------------ typed rows and tables

def aggir_rows(items: DataFrame, doc_id: str) -> DataFrame:
    """One row per AGGIR variable and sub-variable with its adverb answers as columns."""
    def answer(letter: str) -> Column:
        parts = F.split(F.regexp_replace(_adverbs(), "^[^:]*: ", ""), " / ")
        return F.get(parts, F.lit("STCH".index(letter)))

    return items.where(F.col("kind").isin("aggir_var", "aggir_sub")).select(
        doc_id, "kind", "i", F.when(F.col("kind") == "aggir_sub", F.col("j")).alias("j"),
        _auto("Nom").alias("name"), _keep("Resultat", default=NOT_GIVEN).alias("result"), _auto("Commentaires").alias("comment"),
        *[answer(x).alias(x) for x in "STCH"],
    )


def bloc_rows(items: DataFrame, doc_id: str) -> DataFrame:
    """Questions, tests, measures and comorbidities of social and health blocks as typed rows."""
    lined = item_lines(items.where(F.col("kind").isin("question", "test", "measure", "comorbidity")))
    return lined.select(
        doc_id, F.when(F.col("section") == "04", "social").otherwise("sante").alias("area"), "kind",
        F.col("i").alias("bloc_no"), F.col("j").alias("item_no"),
        _auto("question", "nom", "type").alias("name"), _keep("reponse", "resultat", "résultat", "valeur", "value").alias("value"),
        F.get("lines", F.lit(0)).alias("line"),
    )


def plan_table(items: DataFrame, doc_id: str) -> DataFrame:
    """Six-column help plan, one row per action, blanks filled with the default."""
    actions = items.where(F.col("kind") == "plan_action").select(
        doc_id, "section", "i", F.col("j").alias("action_no"),
        _auto("typeAction", "action", default=NOT_GIVEN).alias("action"),
        _list_of("personneChargeAction").alias("in_charge"),
        _auto("critereEvaluation", default=NOT_GIVEN).alias("criterion"),
        _auto("resultatActions", default=NOT_GIVEN).alias("result"),
    )
    problems = items.where(F.col("kind") == "problem").select(
        doc_id, "section", "i",
        _auto("problemePose", default=NOT_GIVEN).alias("problem"), _auto("objectifs", default=NOT_GIVEN).alias("objectives"),
    )
    joined = problems.join(actions, [doc_id, "section", "i"], "left")
    filled = {c: F.coalesce(c, F.lit(NOT_GIVEN)) for c in ("action", "in_charge", "criterion", "result")}
    return joined.select(
        doc_id, F.when(F.col("section") == "08", "social").otherwise("sante").alias("area"), F.col("i").alias("problem_no"),
        F.coalesce("action_no", F.lit(0)).alias("action_no"), "problem", "objectives",
        *[v.alias(k) for k, v in filled.items()],
    )


def schedule_entries(items: DataFrame, doc_id: str) -> DataFrame:
    """``doc_id, week, days, moments, actions`` of every autonomy action, week 2 from its own fields only."""
    def listed(name: str) -> Column:
        hits = _entries(lambda e: e["key"].rlike(rf"^{name}(\[[0-9]+\])?$"))
        return F.transform(hits, lambda e: e["value"]["auto"])

    told = F.when(F.size(listed("actions")) > 0, listed("actions")).otherwise(F.array_compact(F.array(F.nullif(_auto("message"), F.lit("")))))

    def week(n: int, days: str, moments: str) -> Column:
        return F.struct(F.lit(n).alias("week"), listed(days).alias("days"), listed(moments).alias("moments"), told.alias("actions"))

    weeks = F.array(week(1, "joursIntervention", "momentJournee"), week(2, "secondJoursIntervention", "secondMomentJournee"))
    return items.where(F.col("kind") == "autonomy").select(doc_id, F.inline(weeks))


def _spelling(x: Column) -> Column:
    """Case, accents, edges and the form of apostrophes and dashes don't tell moments or days apart."""
    same = F.regexp_replace(F.regexp_replace(x, "[‘’ʼ`´]", "'"), "[‐-―]", "-")
    return norm_space(strip_accents(F.lower(same)))


def _schedule_cells(entries: DataFrame, doc_id: str, outer: bool = False) -> DataFrame:
    """One row per day, moment and action, with ``slot`` and ``on`` (the day); null where nothing matches.

    ``outer`` keeps entries without a day, moment or action too.
    """
    explode = F.explode_outer if outer else F.explode

    def named(names: dict[str, str], x: Column) -> Column:
        pairs = [v for name, value in names.items() for v in (_spelling(F.lit(name)), F.lit(value))]
        return F.create_map(*pairs)[_spelling(x)]

    return (
        entries.select(doc_id, "week", explode("days").alias("day"), "moments", "actions")
        .select(doc_id, "week", "day", explode("moments").alias("moment"), "actions")
        .select(
            doc_id, "week", "day", "moment", explode("actions").alias("action"),
            named(MOMENT_SLOTS, F.col("moment")).alias("slot"), named({d: d for d in WEEK_DAYS}, F.col("day")).alias("on"),
        )
    )


def schedule_rejects(entries: DataFrame, doc_id: str) -> DataFrame:
    """``doc_id, week, day, moment, action`` of the actions whose day or moment has no place in the schedule."""
    cells = _schedule_cells(entries, doc_id)
    return cells.where(F.col("slot").isNull() | F.col("on").isNull()).select(doc_id, "week", "day", "moment", "action")


def weekly_schedule(entries: DataFrame, doc_id: str) -> DataFrame:
    """Two weeks of 8 slots by 7 days per document; every slot is present, empty cells say so.

    The entries are read once; entries without a cell keep their document in. Documents without an id have empty
    cells. Actions without a place are in ``schedule_rejects``.
    """
    placed = F.col("slot").isNotNull() & F.col("on").isNotNull()
    place = [F.when(placed, F.col(c)).alias(n) for c, n in (("week", "week"), ("on", "day"), ("slot", "slot"), ("action", "action"))]
    acting = entries.withColumn("days", F.when(F.size("actions") > 0, F.col("days")))
    cells = _schedule_cells(acting, doc_id, outer=True).select(doc_id, *place).distinct()
    filled = cells.groupBy(doc_id, "week", "slot", "day").agg(F.array_join(F.array_sort(F.collect_list("action")), ", ").alias("cell"))
    known = F.col("slot").isNotNull() & F.col("week").isin(1, 2) & F.col(doc_id).isNotNull()
    # at most 2 x 8 x 7 cells of the grid per document
    cell = F.when(known, F.struct(F.concat_ws("|", "week", "slot", "day").alias("at"), F.col("cell")))
    docs = filled.groupBy(doc_id).agg(F.map_from_entries(F.collect_list(cell)).alias("cells"))
    slots = F.array(*[F.struct(F.lit(n + 1).alias("slot_no"), F.lit(s).alias("slot")) for n, s in enumerate(SLOTS)])
    grid = docs.select(doc_id, "cells", F.explode(F.array(F.lit(1), F.lit(2))).alias("week"), slots.alias("s"))
    grid = grid.select(doc_id, "cells", "week", F.inline("s"))

    def at(day: str) -> Column:
        return F.col("cells")[F.concat_ws("|", "week", "slot", F.lit(day))]

    return grid.select(doc_id, "week", "slot_no", "slot", *[F.coalesce(at(d), F.lit(NOT_GIVEN)).alias(d) for d in WEEK_DAYS])


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``line``: the row as a Markdown table row. Lines stay rows, so no group is gathered."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.withColumn("line", _text("| ", F.concat_ws(" | ", *cells), " |"))


def markdown_table(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One Markdown table per ``keys``. Choose keys whose groups are small, such as person and month."""
    head = "| " + " | ".join(columns) + " |\n|" + "|".join([":---"] * len(columns)) + "|\n"
    lines = markdown_rows(df, columns).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "line"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    return lines.select(*keys, F.concat(F.lit(head), body).alias("table"))

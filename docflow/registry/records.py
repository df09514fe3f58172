"""Person records: leaves, clean-up, pseudonyms, masking, text, schedules.

Records are built by Spark from whole customer rows (with nation and the document of the same number).
One template gives both the JSON that Spark reads and the leaf rows the SQL expects.
"""

from pyspark.sql import functions as F

from docflow.functions.wordlists import MOMENT_SLOTS, NOT_GIVEN, SLOTS, WEEK_DAYS
from docflow.operators import privacy, records, render
from docflow.registry.base import query, s_list, s_quote, s_space, table
from docflow.registry.scalars import _s_shout, _s_title
from docflow.runtime import materialize

SALT, YEAR = "test-salt", 2024
DAY = "CASE c_custkey % 6 " + " ".join(f"WHEN {n} THEN '{d}'" for n, d in enumerate(WEEK_DAYS[:6])) + " END"
MOMENT = "CASE c_custkey % 3 WHEN 0 THEN 'Matin' WHEN 1 THEN 'Midi' ELSE 'Coucher' END"

# (path, expression valid in Spark and DuckDB, type)
TEMPLATE = [
    ("usager/Informations d'état civil/clientId", "c_name", "string"),
    ("usager/Informations d'état civil/personnePhysique/nomFamille", "last_name", "string"),
    ("usager/Informations d'état civil/personnePhysique/nomUtilise", "last_name", "string"),
    ("usager/Informations d'état civil/personnePhysique/prenomUtilise", "first_name", "string"),
    ("usager/Informations d'état civil/personnePhysique/prenomsActeNaissance", "first_name", "string"),
    ("usager/Informations d'état civil/personnePhysique/dateNaissance", "'19' || CAST(30 + c_custkey % 40 AS STRING) || '-03-15'", "string"),
    ("usager/Informations d'état civil/personnePhysique/sexe", "CASE c_custkey % 3 WHEN 0 THEN 'Féminin' WHEN 1 THEN 'M.' ELSE ' ' END", "string"),
    ("usager/Informations d'état civil/personnePhysique/civilite", "CASE WHEN c_custkey % 2 = 0 THEN 'Mme' END", "string"),
    ("usager/Informations d'état civil/personnePhysique/situationFamiliale", "CASE WHEN c_custkey % 4 = 0 THEN 'Non renseigné' WHEN c_custkey % 4 = 1 THEN 'Veuf' END", "string"),
    ("usager/Informations d'état civil/personnePhysique/communeNaissance/libelleCommune", "n_name", "string"),
    ("usager/Informations d'état civil/personnePhysique/paysNaissance/inseePays", "'99100'", "string"),
    ("usager/adresse/ligne/[0]", "CAST(c_custkey AS STRING) || ' rue ' || n_name", "string"),
    ("usager/adresse/codePostal", "lpad(CAST(c_custkey % 100000 AS STRING), 5, '0')", "string"),
    ("usager/adresse/libelleCommune", "n_name", "string"),
    ("usager/adresse/commentaire", "''", "string"),
    ("usager/contactInfosPersonnels/domicile", "CAST(NULL AS STRING)", "string"),
    ("usager/contactInfosPersonnels/mobile", "'06' || lpad(CAST(c_custkey AS STRING), 8, '0')", "string"),
    ("usager/contactInfosPersonnels/mail", "CASE WHEN c_custkey % 5 = 0 THEN 'null' ELSE 'p' || CAST(c_custkey AS STRING) || '@example.org' END", "string"),
    ("usager/mouvement/service", "'Geriatrie'", "string"),
    ("contacts/[0]/typeContact", "'Entourage'", "string"),
    ("contacts/[0]/role", "'Aidant'", "string"),
    ("contacts/[0]/natureLien", "'Fille'", "string"),
    ("contacts/[0]/numRpps", "'100' || CAST(c_custkey AS STRING)", "string"),
    ("contacts/[0]/structure/nom", "'CLIC'", "string"),
    ("contacts/[0]/personnePhysique/civilite", "'Mme'", "string"),
    ("contacts/[0]/personnePhysique/prenomUtilise", "'Anne'", "string"),
    ("contacts/[0]/personnePhysique/nomUtilise", "last_name", "string"),
    ("contacts/[0]/personnePhysique/dateNaissance", "'1960-01-02'", "string"),
    ("contacts/[0]/adresse/ligne/[0]", "'1 rue'", "string"),
    ("contacts/[0]/contactInfosPersonnels/mobile", "'07'", "string"),
    ("contacts/[0]/contactInfosPersonnels/mail", "'c@example.org'", "string"),
    ("contacts/[1]/role", "'MEDECIN TRAITANT'", "string"),
    ("contacts/[1]/personnePhysique/civilite", "'M'", "string"),
    ("contacts/[1]/personnePhysique/prenomUtilise", "'Paul'", "string"),
    ("contacts/[1]/personnePhysique/nomUtilise", "c_mktsegment", "string"),
    ("aggir/GIR", "CAST(c_custkey % 6 + 1 AS STRING)", "string"),
    ("aggir/dateModification", "'2024-01-02'", "string"),
    ("aggir/TempsAide24H", "CAST(NULL AS STRING)", "string"),
    ("aggir/AggirVariable/[0]/Nom", "'COHERENCE'", "string"),
    ("aggir/AggirVariable/[0]/Resultat", "CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'B' END", "string"),
    ("aggir/AggirVariable/[0]/AggirAdverbes/[0]/Question", "'S'", "string"),
    ("aggir/AggirVariable/[0]/AggirAdverbes/[0]/Reponse", "'Oui'", "string"),
    ("aggir/AggirVariable/[0]/AggirAdverbes/[1]/Question", "'C'", "string"),
    ("aggir/AggirVariable/[0]/AggirAdverbes/[1]/Reponse", "CASE WHEN c_custkey % 2 = 0 THEN 'Non' ELSE '' END", "string"),
    ("aggir/AggirVariable/[0]/AggirSousVariable/[0]/Nom", "'Communication'", "string"),
    ("aggir/AggirVariable/[0]/AggirSousVariable/[0]/Commentaires", "'parle peu'", "string"),
    ("social/blocs/[0]/nom", "'Habitat'", "string"),
    ("social/blocs/[0]/questionReponse/[0]/question", "'Segment'", "string"),
    ("social/blocs/[0]/questionReponse/[0]/reponse", "c_mktsegment", "string"),
    ("social/blocs/[0]/test/[0]/nom", "'TUG'", "string"),
    ("social/blocs/[0]/test/[0]/resultat", "'12'", "string"),
    ("social/blocs/[0]/test/[0]/dateTest", "'15/03/2024'", "string"),
    ("social/blocs/[0]/mesureConstante/[0]/type", "'Poids'", "string"),
    ("social/blocs/[0]/mesureConstante/[0]/valeur", "40 + c_custkey % 70", "number"),
    ("social/blocs/[0]/mesureConstante/[0]/unite", "'kg'", "string"),
    ("social/blocs/[0]/mesureConstante/[0]/dateSaisie", "'2024-03-15 08:00:00'", "string"),
    ("social/blocs/[0]/comorbidites/[0]/libelle", "'HTA'", "string"),
    ("social/blocs/[0]/comorbidites/[0]/statut", "'Actif'", "string"),
    ("social/blocs/[0]/acces/etage", "'2'", "string"),
    ("sante/blocs/[0]/nom", "'Note'", "string"),
    ("sante/blocs/[0]/questionReponse/[0]/question", "'Synthèse'", "string"),
    ("sante/blocs/[0]/questionReponse/[0]/reponse", "text", "string"),
    ("dispositifs/[0]/type", "'TELEALARME'", "string"),
    ("dispositifs/[0]/marque", "CAST(NULL AS STRING)", "string"),
    ("materiels/[0]", "'LIT'", "string"),
    ("poaSocial/problemes/[0]/nomBloc", "'Habitat'", "string"),
    ("poaSocial/problemes/[0]/statut", "'En cours'", "string"),
    ("poaSocial/problemes/[0]/problemePose", "'Chute'", "string"),
    ("poaSocial/problemes/[0]/objectifs", "''", "string"),
    ("poaSocial/problemes/[0]/planActions/[0]/typeAction", "'Visite'", "string"),
    ("poaSocial/problemes/[0]/planActions/[0]/personneChargeAction/[0]", "'IDE'", "string"),
    ("poaAutonomie/actions/[0]/typeAction", "'Toilette'", "string"),
    ("poaAutonomie/actions/[0]/personneChargeAction/[0]", "'Aide'", "string"),
    ("poaAutonomie/actions/[0]/joursIntervention/[0]", DAY, "string"),
    ("poaAutonomie/actions/[0]/joursIntervention/[1]", "'Dimanche'", "string"),
    ("poaAutonomie/actions/[0]/momentJournee/[0]", MOMENT, "string"),
    ("poaAutonomie/actions/[0]/actions/[0]", "'Aide au lever'", "string"),
    ("poaAutonomie/actions/[0]/dureeAction", "TRUE", "boolean"),
    ("poaAutonomie/actions/[0]/dateDebutAction", "'01/03/2024'", "string"),
    ("numero", "c_custkey", "number"),
]

WORD1 = r"^\P{L}*(?:\p{L}{1,3}\P{L}+)*(\p{L}{4,})"
WORD2 = r"^\P{L}*(?:\p{L}{1,3}\P{L}+)*\p{L}{4,}\P{L}+(?:\p{L}{1,3}\P{L}+)*(\p{L}{4,})"


# The same words found without a group that repeats: for each pass through one, Java's engine goes a level deeper, and some
# thousands of short words in a row overflow the stack and end the executor.
FIRST_WORD = r"\p{L}{4,}+"
SECOND_WORD = r"^(?>(?s:.*?)\p{L}{4,}+)(?s:.*?)(\p{L}{4,}+)"


def _dotted(path):
    return path.replace("/[", "[").replace("/", ".")


def _struct(rows):
    """Nested struct or array column from (key list, expression) rows."""
    below = {}
    for keys, expr in rows:
        below.setdefault(keys[0], []).append((keys[1:], expr))
    made = {k: F.expr(r[0][1]) if not r[0][0] else _struct(r) for k, r in below.items()}
    if next(iter(made)).startswith("["):
        return F.array(*made.values())
    return F.struct(*[c.alias(k) for k, c in made.items()])


def _grouped(template):
    """Give the second contact the keys of the first, in the same order: one array type."""
    given = {p: (p, e, t) for p, e, t in template}
    first = [r for r in template if not r[0].startswith("contacts/[1]/")]
    twins = []
    for path, _, kind in (r for r in first if r[0].startswith("contacts/[0]/")):
        twin = path.replace("[0]/", "[1]/", 1)
        twins.append(given.get(twin, (twin, "CAST(NULL AS STRING)", kind)))
    at = max(n for n, r in enumerate(first) if r[0].startswith("contacts/")) + 1
    return first[:at] + twins + first[at:]


ROWS = _grouped(TEMPLATE)


def people(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("c_custkey"), "text")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = table(spark, sf, "customer", spread=True).join(n, "c_nationkey").join(d, "c_custkey", "left")
    first = F.coalesce(F.nullif(F.regexp_extract("text", FIRST_WORD, 0), F.lit("")), F.lit("Jean"))
    last = F.coalesce(F.nullif(F.regexp_extract("text", SECOND_WORD, 1), F.lit("")), F.lit("Duval"))
    rows = rows.withColumn("first_name", first).withColumn("l", last)
    same = privacy.plain_name(F.col("l")) == privacy.plain_name(F.col("first_name"))
    return rows.withColumn("last_name", F.when(same, "Duval").otherwise(F.col("l"))).drop("l")


def record_json(spark, sf):
    body = _struct([(p.split("/"), e) for p, e, _ in ROWS])
    return people(spark, sf).select(
        F.col("c_custkey").alias("doc_id"), F.to_json(body, {"ignoreNullFields": "false"}).alias("json")
    )


def leaves(spark, sf):
    return records.json_leaves(record_json(spark, sf), "doc_id", "json")


PEOPLE_SQL = rf"""SELECT c_custkey, c_name, c_mktsegment, n_name, text, first_name,
  CASE WHEN strip_accents(lower(l)) = strip_accents(lower(first_name)) THEN 'Duval' ELSE l END AS last_name FROM (
  SELECT *, coalesce(nullif(regexp_extract(text, '{WORD1}', 1), ''), 'Jean') AS first_name, coalesce(nullif(regexp_extract(text, '{WORD2}', 1), ''), 'Duval') AS l
  FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN documents ON doc_id = c_custkey)"""
LEAVES_SQL = (
    "SELECT doc_id, u.path AS path, CASE WHEN u.value IS NULL THEN 'null' ELSE u.type END AS type, u.value AS value FROM (SELECT c_custkey AS doc_id, unnest(["
    + ", ".join(f"{{'path': {s_quote(_dotted(p))}, 'type': '{t}', 'value': ({e})::VARCHAR}}" for p, e, t in ROWS)
    + f"]) AS u FROM ({PEOPLE_SQL}))"
)


@query("json_leaves", LEAVES_SQL)
def json_leaves(spark, sf):
    return leaves(spark, sf).select("doc_id", "path", "type", "value")


def _s_reason():
    wild = r"regexp_replace(path, '\[[0-9]+\]', '[*]', 'g')"
    hits = " OR ".join(
        f"{wild} = {s_quote(r)} OR starts_with({wild}, {s_quote(r + '.')}) OR starts_with({wild}, {s_quote(r + '[')})" for r in records.SENSITIVE_PATHS
    )
    kept = f"path IN ({s_list(records.KEPT_NULL_PATHS)})"
    return f"""CASE WHEN {hits} THEN 'sensitive' WHEN type = 'string' AND lower(trim(value)) IN ('', 'non renseigné', 'null') THEN 'empty value'
      WHEN type = 'null' AND NOT {kept} THEN 'null' END"""


MARKED_SQL = f"SELECT *, {_s_reason()} AS reason FROM ({LEAVES_SQL})"


@query("clean_leaves", f"SELECT doc_id, path, type, value FROM ({MARKED_SQL}) WHERE reason IS NULL")
def clean_leaves(spark, sf):
    return records.clean_leaves(leaves(spark, sf)).select("doc_id", "path", "type", "value")


@query(
    "drop_sensitive",
    f"SELECT doc_id, count(*) FILTER (reason = 'sensitive') AS n_sensitive, count(*) FILTER (reason IS NULL AND path LIKE 'contacts%mail') AS n_contact_mail FROM ({MARKED_SQL}) GROUP BY doc_id",
)
def drop_sensitive(spark, sf):
    marked = records.mark_cleaned(leaves(spark, sf))
    mail = F.col("path").startswith("contacts") & F.col("path").endswith("mail") & F.col("reason").isNull()
    return marked.groupBy("doc_id").agg(
        F.count_if(F.col("reason") == "sensitive").alias("n_sensitive"), F.count_if(mail).alias("n_contact_mail")
    )


def _s_containers(where):
    return rf"""SELECT DISTINCT doc_id, container FROM (SELECT doc_id, unnest(list_transform(range(1, len(p)), lambda n: replace(array_to_string(p[:n], '.'), '.[', '['))) AS container
      FROM (SELECT doc_id, string_split(replace(path, '[', '.['), '.') AS p FROM ({MARKED_SQL}) WHERE {where}))"""


@query("prune_containers", _s_containers("reason IS NULL"))
def prune_containers(spark, sf):
    return records.containers(records.clean_leaves(leaves(spark, sf)), "doc_id")


@query(
    "emptied_containers",
    f"SELECT * FROM ({_s_containers('TRUE')}) EXCEPT SELECT * FROM ({_s_containers('reason IS NULL')})",
)
def emptied_containers(spark, sf):
    marked = materialize(records.mark_cleaned(leaves(spark, sf)).select("doc_id", "keys", "reason"), "marked")
    return records.emptied_containers(marked, "doc_id")


@query(
    "clean_trace",
    f"""SELECT doc_id, path, CASE WHEN reason IS NOT NULL THEN 'Removed ' || reason || ' at: ' || path ELSE 'Kept null at preserved key/path: ' || path END AS message
       FROM ({MARKED_SQL}) WHERE reason IS NOT NULL OR type = 'null'""",
)
def clean_trace(spark, sf):
    return records.clean_trace(records.mark_cleaned(leaves(spark, sf)), "doc_id")


# ------------------------------------------------------------ personas

S_GENDER = "CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE CASE WHEN c_custkey % 2 = 0 THEN 'F' END END"


@query("detect_gender", f"SELECT c_custkey AS doc_id, {S_GENDER} AS gender FROM customer")
def detect_gender(spark, sf):
    found = privacy.personas(leaves(spark, sf), "doc_id", SALT, YEAR).where(F.col("who") == "usager")
    return found.select("doc_id", privacy.detect_gender(F.col("sex"), F.col("title")).alias("gender"))


def _s_num(key, field):
    return f"('0x' || substr(sha256('{SALT}|' || {key} || '|{field}'), 1, 8))::BIGINT"


def _s_pick(options, key, field):
    return f"[{s_list(options)}][({_s_num(key, field)} % {len(options)} + 1)::INT]"


P = privacy.Pools()


def _s_dob(key):
    cdf = " ".join(f"WHEN {_s_num(key, 'age')} / 4294967296.0::DOUBLE <= {c!r}::DOUBLE THEN {a}" for a, c in privacy.age_distribution())
    return f"strftime(make_date({YEAR} - (CASE {cdf} END), ({_s_num(key, 'month')} % 12 + 1)::INT, ({_s_num(key, 'day')} % 28 + 1)::INT), '%Y-%m-%d')"


def _s_persona(key, gender):
    town = f"({_s_num(key, 'town')} % {len(P.towns)} + 1)::INT"
    return f"""CASE {gender} WHEN 'M' THEN {_s_pick(P.first_m, key, 'first')} WHEN 'F' THEN {_s_pick(P.first_f, key, 'first')} ELSE {_s_pick(P.first_m + P.first_f, key, 'first')} END AS p_first,
    {_s_pick(P.last, key, 'last')} AS p_last, ({_s_num(key, 'number')} % 199 + 1) || ' ' || {_s_pick(P.streets, key, 'street')} AS p_address,
    [{s_list(t[0] for t in P.towns)}][{town}] AS p_postcode, [{s_list(t[1] for t in P.towns)}][{town}] AS p_commune,
    'CLT-' || upper(substr(sha256('{SALT}|' || {key} || '|client'), 1, 8)) AS p_client,
    CASE {gender} WHEN 'M' THEN 'M.' WHEN 'F' THEN 'Mme' ELSE {_s_pick(('M.', 'Mme'), key, 'title')} END AS p_title, {_s_dob(key)} AS p_dob"""


USAGER_KEY = "c_custkey || '|usager'"
USAGER_SQL = f"SELECT *, {_s_persona(USAGER_KEY, f'({S_GENDER})')} FROM ({PEOPLE_SQL})"


@query(
    "assign_persona",
    f"SELECT c_custkey AS doc_id, p_first AS first_name, p_last AS last_name, p_address AS address_line, p_postcode AS postcode, p_commune AS commune, p_client AS client_id FROM ({USAGER_SQL})",
)
def assign_persona(spark, sf):
    found = privacy.personas(leaves(spark, sf), "doc_id", SALT, YEAR).where(F.col("who") == "usager")
    return found.select("doc_id", "first_name", "last_name", "address_line", "postcode", "commune", "client_id")


def _s_contact(n, gender):
    key = f"c_custkey || '|contacts[{n}]'"
    return f"SELECT c_custkey AS doc_id, 'contacts[{n}]' AS who, p_title AS civilite, p_first AS first_name, p_last AS last_name, p_dob AS dob FROM (SELECT *, {_s_persona(key, gender)} FROM customer)"


CONTACTS_SQL = _s_contact(0, "'F'") + " UNION ALL " + _s_contact(1, "'M'")


@query("persona_contact", CONTACTS_SQL)
def persona_contact(spark, sf):
    found = privacy.personas(leaves(spark, sf), "doc_id", SALT, YEAR).where(F.col("who") != "usager")
    return found.select("doc_id", "who", "civilite", "first_name", "last_name", "dob")


@query("sample_dob", f"SELECT c_custkey, {_s_dob('c_custkey')} AS dob FROM customer")
def sample_dob(spark, sf):
    key = F.col("c_custkey").cast("string")
    return table(spark, sf, "customer").select("c_custkey", privacy.sample_dob(SALT, key, YEAR).alias("dob"))


def changes(spark, sf, rows=None):
    rows = clean(spark, sf) if rows is None else rows
    return privacy.replacements(rows, "doc_id", SALT, YEAR)


_ALIAS = {
    "client_id": "p_client", "last_name": "p_last", "first_name": "p_first", "not_given": s_quote(NOT_GIVEN), "dob": "p_dob", "address_line": "p_address",
    "postcode": "p_postcode", "commune": "p_commune", "commentaire": "'Accès : interphone'", "domicile": "'domicile_1'", "mobile": "'mobile_1'", "mail": "'mail_1'",
}
_FIELD_LIST = [(p, _ALIAS[f], n) for n, (p, f) in enumerate(privacy.USAGER_FIELDS)]
BASES_SQL = (
    "SELECT doc_id, u.path AS path, u.base AS base, u.seq AS seq FROM (SELECT c_custkey AS doc_id, unnest(["
    + ", ".join(f"{{'path': {s_quote(p)}, 'base': {a}, 'seq': {n}}}" for p, a, n in _FIELD_LIST)
    + f"]) AS u FROM ({USAGER_SQL})) UNION ALL SELECT doc_id, u.path, u.base, u.seq FROM (SELECT doc_id, unnest(["
    + ", ".join(
        f"{{'path': who || '.personnePhysique.{f}', 'base': {c}, 'seq': 1000 + (who[10:10])::INT * 10 + {n}}}"
        for n, (f, c) in enumerate((("civilite", "civilite"), ("prenomUtilise", "first_name"), ("nomUtilise", "last_name"), ("dateNaissance", "dob")))
    )
    + f"]) AS u FROM ({CONTACTS_SQL}))"
)
_BLANK = f"(l.path IN ({s_list(privacy.BLANK_TO_DEFAULT)}) AND (value IS NULL OR lower(trim(value)) IN ('', 'non renseigné', 'null')))"
CHANGES_SQL = f"""WITH t AS (SELECT l.doc_id, l.path, value, base, seq, {_BLANK} AS blank FROM (SELECT * FROM ({MARKED_SQL}) WHERE reason IS NULL) l JOIN ({BASES_SQL}) b ON b.doc_id = l.doc_id AND b.path = l.path),
  f AS (SELECT doc_id, base, value, min(seq) AS s FROM t WHERE NOT blank AND value IS NOT NULL GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY s) AS r FROM f)
  SELECT t.doc_id, t.path, t.value AS original, CASE WHEN r.r = 1 THEN t.base ELSE t.base || '#' || r.r END AS alias, t.seq, TRUE AS mapped FROM t JOIN r ON r.doc_id = t.doc_id AND r.base = t.base AND r.value = t.value WHERE NOT t.blank
  UNION ALL SELECT doc_id, path, value, 'Non renseigné', seq, FALSE FROM t WHERE blank"""


@query("replace_and_map", CHANGES_SQL)
def replace_and_map(spark, sf):
    return changes(spark, sf)


@query(
    "pseudonymised_leaves",
    f"""SELECT l.doc_id, l.path, CASE WHEN c.alias IS NOT NULL THEN 'string' ELSE type END AS type, coalesce(c.alias, l.value) AS value FROM (SELECT * FROM ({MARKED_SQL}) WHERE reason IS NULL) l
       LEFT JOIN ({CHANGES_SQL}) c ON c.doc_id = l.doc_id AND c.path = l.path
       UNION ALL SELECT doc_id, {s_quote(privacy.BLANK_TO_DEFAULT[0])}, 'string', 'Non renseigné' FROM (SELECT DISTINCT doc_id FROM ({LEAVES_SQL})) WHERE doc_id % 4 = 0
       UNION ALL SELECT doc_id, {s_quote(privacy.BLANK_TO_DEFAULT[3])}, 'string', 'Non renseigné' FROM (SELECT DISTINCT doc_id FROM ({LEAVES_SQL})) WHERE doc_id % 5 = 0""",
)
def pseudonymised_leaves(spark, sf):
    rows = materialize(clean(spark, sf), "leaves")
    done = privacy.apply_replacements(rows, changes(spark, sf, rows), "doc_id")
    return done.unionByName(privacy.missing_defaults(rows, "doc_id")).select("doc_id", "path", "type", "value")


# ------------------------------------------------------------ free text


def _s_norm(e):
    return f"strip_accents(lower({e}))"


MASK_SQL = rf"""WITH c AS ({CHANGES_SQL}),
 n AS (SELECT doc_id, max(original) FILTER (path = {s_quote(privacy.PERSON + '.prenomUtilise')}) AS f, max(original) FILTER (path = {s_quote(privacy.PERSON + '.nomUtilise')}) AS l,
   max(alias) FILTER (path = {s_quote(privacy.PERSON + '.prenomUtilise')}) AS af, max(alias) FILTER (path = {s_quote(privacy.PERSON + '.nomUtilise')}) AS al FROM c GROUP BY doc_id),
 t AS (SELECT d.doc_id, f, l, af, al, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS tok FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id)
 SELECT doc_id, array_to_string(list_transform(tok, lambda w, i: CASE WHEN {_s_norm('w')} = {_s_norm('l')} THEN al WHEN {_s_norm('w')} = {_s_norm('f')} THEN af
   WHEN i > 1 AND i < len(tok) AND {s_space('w')} = '' AND {_s_norm('tok[i - 1]')} IN ({_s_norm('f')}, {_s_norm('l')}) AND {_s_norm('tok[i + 1]')} IN ({_s_norm('f')}, {_s_norm('l')})
     AND {_s_norm('tok[i - 1]')} <> {_s_norm('tok[i + 1]')} THEN ' ' ELSE w END), '') AS masked FROM t"""


def masked_documents(spark, sf, rules=None):
    rules = privacy.name_rules(changes(spark, sf), "doc_id") if rules is None else rules
    return privacy.mask_names(table(spark, sf, "documents", spread=True).select("doc_id", "text"), rules, "doc_id", "text")


@query("mask_names_free_text", MASK_SQL)
def mask_names_free_text(spark, sf):
    return masked_documents(spark, sf).select("doc_id", F.col("text").alias("masked"))


@query(
    "name_leaks",
    "SELECT count(*) AS n_docs, 0 AS n_leaks FROM documents JOIN customer ON c_custkey = doc_id",
)
def name_leaks(spark, sf):
    """Documents in which the person's name can still be found after masking (aliases aside)."""
    rules = materialize(privacy.name_rules(changes(spark, sf), "doc_id"), "rules")
    done = masked_documents(spark, sf, rules).join(rules, "doc_id")
    # an alias may by chance equal a real name; take aliases out before looking
    aliases = F.concat(F.lit("(?:"), F.array_join(F.map_values("aliases"), "|"), F.lit(")"))
    bare = F.regexp_replace(F.col("text"), aliases, F.lit("□"))
    return done.agg(
        F.count("*").alias("n_docs"), F.count_if(F.regexp_count(bare, F.col("pattern")) > 0).cast("int").alias("n_leaks")
    )


@query(
    "deanonymize",
    f"""SELECT doc_id, string_agg(original, ' ; ' ORDER BY seq) || ' (' || max(original) FILTER (path = {s_quote(privacy.PERSON + '.nomUtilise')}) || ').' AS restored FROM ({CHANGES_SQL}) WHERE mapped GROUP BY doc_id""",
)
def deanonymize(spark, sf):
    ch = materialize(changes(spark, sf).where("mapped"), "replacements")
    # a document has at most one mapping row per replaced field
    texts = ch.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "alias"))).alias("a"),
        F.max(F.when(F.col("path") == privacy.PERSON + ".nomUtilise", F.col("alias"))).alias("name"),
    )
    joined = texts.select("doc_id", F.concat(F.array_join(F.transform("a", lambda x: x["alias"]), " ; "), F.lit(" ("), F.col("name"), F.lit(").")).alias("text"))
    both = joined.join(privacy.mapping_by_doc(ch, "doc_id"), "doc_id")
    return both.select("doc_id", privacy.deanonymize(F.col("text"), F.col("mapping")).alias("restored"))


@query(
    "reverse_mapping",
    f"SELECT doc_id, original, arg_max(alias, seq) AS alias FROM ({CHANGES_SQL}) WHERE mapped GROUP BY doc_id, original",
)
def reverse_mapping(spark, sf):
    return privacy.reverse_mapping(changes(spark, sf).where("mapped"), "doc_id")


@query(
    "set_session_mapping",
    """SELECT conv_id, turn, role AS alias, length(text) AS original FROM conversations c WHERE turn = (SELECT max(turn) FROM conversations x WHERE x.conv_id = c.conv_id)""",
)
def set_session_mapping(spark, sf):
    entries = table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("alias"), F.length("text").alias("original"))
    return privacy.session_mapping(entries, "conv_id", "turn")


@query(
    "find_record_by_name",
    """WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ') || ['zz', p_brand]) AS name FROM part), f AS (SELECT replace(p_name, ' ', '_') || '_' || p_partkey || '.json' AS file, replace(p_name, ' ', '_') || '_' || p_partkey AS stem FROM part)
       SELECT name, min(file) AS file, count(file) AS n_matches FROM w LEFT JOIN f ON contains(lower(stem), lower(name)) GROUP BY name""",
)
def find_record_by_name(spark, sf):
    part = table(spark, sf, "part", spread=True)
    names = part.select(F.explode(F.concat(F.split(F.upper("p_name"), " "), F.array(F.lit("zz"), F.col("p_brand")))).alias("name"))
    names = names.select(F.when(F.col("name").startswith("Brand") | (F.col("name") == "zz"), F.col("name")).otherwise(F.lower("name")).alias("name"))
    files = part.select(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".json")).alias("file"))
    return records.find_records(names, files)


# ------------------------------------------------------------ text and tables


def clean(spark, sf):
    return records.clean_leaves(leaves(spark, sf))


def items(spark, sf, *tops):
    """Items below the named top keys, all without names; leaves elsewhere can't be part of them."""
    rows = leaves(spark, sf)
    for n, top in enumerate(tops):
        inside = F.col("path").startswith(top) if n == 0 else inside | F.col("path").startswith(top)
    return render.record_items(records.clean_leaves(rows.where(inside) if tops else rows), "doc_id")


def _s_auto(e):
    return f"(CASE WHEN {_s_shout(s_space(e))} THEN {_s_title(s_space(e))} ELSE {s_space(e)} END)"


_TEXT_LINES = [
    "'### Présentation de la personne accompagnée'",
    f"'- Nom : ' || {_s_auto('last_name')}", f"'- Prénom : ' || {_s_auto('first_name')}",
    "'- Sexe : ' || CASE c_custkey % 3 WHEN 0 THEN 'Féminin' WHEN 1 THEN 'M.' ELSE 'Non renseigné' END",
    "'- Date de naissance : 19' || (30 + c_custkey % 40) || '-03-15'",
    "'- Situation familiale : ' || CASE WHEN c_custkey % 4 = 1 THEN 'Veuf' ELSE 'Non renseigné' END",
    "'- Adresse : ' || c_custkey || ' rue ' || n_name || ', ' || lpad(c_custkey::VARCHAR, 5, '0') || ' Nation_' || n_name[8:]",
    "'- Tel. domicile : Non renseigné'", "'- Tel. mobile : 06' || lpad(c_custkey::VARCHAR, 8, '0')",
    "'- Courriel : ' || CASE WHEN c_custkey % 5 = 0 THEN 'Non renseigné' ELSE 'p' || c_custkey || '@example.org' END",
    "''", "'### Contacts identifiés'", f"'- Contact 1 : Anne ' || {_s_auto('last_name')} || ' (Aidant, Fille)'",
    "'  - Téléphone : Non renseigné'", "'  - Email : c@example.org'", "'  - Adresse : Non renseigné,'",
    "'  - Détails supplémentaires :'", "'      typeContact: Entourage'",
    "'- Contact 2 : Paul ' || c_mktsegment || ' (MEDECIN TRAITANT)'", "'  - Téléphone : Non renseigné'", "'  - Email : Non renseigné'", "'  - Adresse : Non renseigné,'",
    "''", "'### AGGIR'", "'- GIR : ' || (c_custkey % 6 + 1)", "'- Date de modification : 2024-01-02'", "'- Temps d''aide/24h : Non renseigné'",
    "''", "'- COHERENCE — Résultat : ' || CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'B' END",
    "'  Adverbes S/T/C/H : Oui / – / ' || CASE WHEN c_custkey % 2 = 0 THEN 'Non' ELSE '–' END || ' / –'",
    "'  * Communication — Résultat : Non renseigné'", "'    Commentaires : parle peu'", "'    Adverbes S/T/C/H : – / – / – / –'",
    "''", "'### Social'", "''", "'- Bloc : Habitat'", "'  • Détails du bloc :'", "'      acces.etage: 2'", "'  • Segment : ' || c_mktsegment",
    "'  • Test — TUG : 12 (le 2024-03-15)'", "'  • Mesure — Poids : ' || (40 + c_custkey % 70) || ' kg le 2024-03-15'", "'  • Comorbidité — libelle: HTA | statut: Actif'",
    "''", "'### Santé'", "''", "'- Bloc : Note'", f"'  • Synthèse : ' || coalesce(nullif({_s_auto('text')}, ''), 'Non renseigné')",
    "''", "'### Dispositifs'", "'- type: TELEALARME'", "''", "'### Matériels'", "'- LIT'",
    "''", "'### poaSocial'", "''", "'- Bloc : Habitat (Statut: En cours)'", "'  • Problème : Chute'", "'  • Objectifs : Non renseigné'",
    "'  • Préoccupation patient/professionnel : Non renseigné'", "'  • Action : personneChargeAction[0]=IDE; typeAction=Visite'",
    "''", "'### poaAutonomie'", "''", "'- Type d''action : Toilette'", "'  • Personnes en charge : Aide'", f"'  • Jours d''intervention : ' || ({DAY}) || ', Dimanche'",
    "'  • Début : 2024-03-01'", "'  • Durée action : Oui'", "'  • Durée passage : Non renseigné'", f"'  • Moments : ' || ({MOMENT})",
    "'  • Type d''aide : Non renseigné'", "'  • Actions : Aide au lever'", "''", "'### Informations supplémentaires'", "'numero: ' || c_custkey",
]
TEXT_SQL = f"SELECT c_custkey AS doc_id, array_to_string([{', '.join(_TEXT_LINES)}], chr(10)) AS text FROM ({PEOPLE_SQL})"


@query("record_to_text", TEXT_SQL)
def record_to_text(spark, sf):
    return render.record_text(clean(spark, sf), "doc_id")


@query(
    "generic_dump",
    rf"""WITH l AS (SELECT doc_id, string_split(replace(path, '[', '.['), '.') AS p, value FROM ({MARKED_SQL}) WHERE reason IS NULL),
     r AS (SELECT doc_id, p, coalesce(nullif({_s_auto("coalesce(value, '')")}, ''), 'Non renseigné') AS v, TRUE AS leaf FROM l
       UNION ALL SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(p)), lambda n: p[:n])), '', FALSE FROM l)
     SELECT doc_id, array_to_string(list_transform(p, lambda k: CASE WHEN k[1] = '[' THEN lpad(k[2:-2], 9, '0') ELSE k END), chr(1)) AS line_key,
       repeat('  ', len(p) - 1) || CASE WHEN leaf THEN CASE WHEN p[-1][1] = '[' THEN '- ' ELSE p[-1] || ': ' END || v
       ELSE CASE WHEN p[-1][1] = '[' THEN '- élément ' || (p[-1][2:-2]::INT + 1) ELSE p[-1] END || ':' END AS line FROM r""",
)
def generic_dump(spark, sf):
    return render.generic_dump(clean(spark, sf), "doc_id")


@query(
    "aggir_rows",
    """SELECT c_custkey AS doc_id, 'aggir_var' AS kind, 0 AS i, -1 AS j, 'COHERENCE' AS name, CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS result, '' AS comment,
        'Oui' AS "S", '–' AS "T", CASE WHEN c_custkey % 2 = 0 THEN 'Non' ELSE '–' END AS "C", '–' AS "H" FROM customer
       UNION ALL SELECT c_custkey, 'aggir_sub', 0, 0, 'Communication', 'Non renseigné', 'parle peu', '–', '–', '–', '–' FROM customer""",
)
def aggir_rows(spark, sf):
    return render.aggir_rows(items(spark, sf, "aggir"), "doc_id").fillna({"j": -1})


@query(
    "bloc_rows",
    f"""SELECT c_custkey AS doc_id, 'social' AS area, 'question' AS kind, 0 AS bloc_no, 0 AS item_no, 'Segment' AS name, c_mktsegment AS value, '  • Segment : ' || c_mktsegment AS line FROM customer
       UNION ALL SELECT c_custkey, 'social', 'test', 0, 0, 'TUG', '12', '  • Test — TUG : 12 (le 2024-03-15)' FROM customer
       UNION ALL SELECT c_custkey, 'social', 'measure', 0, 0, 'Poids', (40 + c_custkey % 70)::VARCHAR, '  • Mesure — Poids : ' || (40 + c_custkey % 70) || ' kg le 2024-03-15' FROM customer
       UNION ALL SELECT c_custkey, 'social', 'comorbidity', 0, 0, '', '', '  • Comorbidité — libelle: HTA | statut: Actif' FROM customer
       UNION ALL SELECT c_custkey, 'sante', 'question', 0, 0, 'Synthèse', coalesce({s_space('text')}, ''), '  • Synthèse : ' || coalesce(nullif({_s_auto('text')}, ''), 'Non renseigné') FROM ({PEOPLE_SQL})""",
)
def bloc_rows(spark, sf):
    return render.bloc_rows(items(spark, sf, "social", "sante"), "doc_id")


@query(
    "plan_table",
    """SELECT c_custkey AS doc_id, 'social' AS area, 0 AS problem_no, 0 AS action_no, 'Chute' AS problem, 'Non renseigné' AS objectives, 'Visite' AS action, 'IDE' AS in_charge,
       'Non renseigné' AS criterion, 'Non renseigné' AS result FROM customer""",
)
def plan_table(spark, sf):
    return render.plan_table(items(spark, sf, "poaSocial", "poaSante"), "doc_id")


def _s_cells(source):
    cols = ", ".join(f"coalesce(string_agg(action, ', ' ORDER BY action) FILTER (day = '{d}'), 'Non renseigné') AS \"{d}\"" for d in WEEK_DAYS)
    slots = ", ".join(f"({n + 1}, {s_quote(s)})" for n, s in enumerate(SLOTS))
    return f"""WITH c AS ({source}), g AS (SELECT DISTINCT doc_id FROM c)
      SELECT g.doc_id, w.week, s.slot_no, s.slot, {cols} FROM g CROSS JOIN (VALUES (1), (2)) w(week) CROSS JOIN (VALUES {slots}) s(slot_no, slot)
      LEFT JOIN (SELECT DISTINCT doc_id, week, slot, day, action FROM c) x ON x.doc_id = g.doc_id AND x.week = w.week AND x.slot = s.slot GROUP BY ALL"""


@query(
    "record_schedule",
    _s_cells(f"""SELECT c_custkey AS doc_id, 1 AS week, CASE c_custkey % 3 WHEN 0 THEN '10h00-11h00' WHEN 1 THEN '12h00-13h00' ELSE '20h00-21h00' END AS slot,
      unnest([{DAY}, 'Dimanche']) AS day, 'Aide au lever' AS action FROM customer"""),
)
def record_schedule(spark, sf):
    return render.weekly_schedule(render.schedule_entries(items(spark, sf, "poaAutonomie"), "doc_id"), "doc_id")


MOMENT_OF_HOUR = ("Nuit", "Nuit", "Lever", "Matin", "Déjeuner", "Après-midi", "Goûter", "Soir")


@query(
    "weekly_schedule",
    _s_cells(
        f"SELECT user_id AS doc_id, CASE WHEN event_type = 'view' THEN 2 ELSE 1 END AS week, [{s_list(MOMENT_SLOTS[m] for m in MOMENT_OF_HOUR)}][(hour(ts) // 3 + 1)::INT] AS slot, "
        f"[{s_list(WEEK_DAYS)}][isodow(ts)::INT] AS day, event_type AS action FROM events"
    ),
)
def weekly_schedule(spark, sf):
    """Events as interventions: weekday, moment by hour band, action by event type."""
    day = F.get(F.array(*[F.lit(d) for d in WEEK_DAYS]), F.weekday("ts"))
    moment = F.get(F.array(*[F.lit(m) for m in MOMENT_OF_HOUR]), F.floor(F.hour("ts") / 3).cast("int"))
    entries = table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), F.when(F.col("event_type") == "view", 2).otherwise(1).alias("week"),
        F.array(day).alias("days"), F.array(moment).alias("moments"), F.array("event_type").alias("actions"),
    )
    return render.weekly_schedule(entries, "doc_id")


# Records that readers trip over, one kind after the other: nested up to 40 deep, a repeated key, keys with dots,
# broken, missing, blank, nested lists, numbers in several forms.
ODD_SQL = """SELECT doc_id, doc_id % 8 AS kind, (1 + doc_id % 40)::INT AS d FROM documents"""


def _odd_records(spark, sf):
    number, depth = F.col("doc_id").cast("string"), (1 + F.col("doc_id") % 40).cast("int")
    kinds = (
        F.concat(F.repeat(F.lit('{"a":'), depth), F.lit('"x'), number, F.lit('"'), F.repeat(F.lit("}"), depth)),
        F.concat(F.lit('{"k": [1], "k": '), number, F.lit("}")),
        F.concat(F.lit('{"a.b": "x", "a": {"b": "'), number, F.lit('", "c[0]": 1, "c": [2]}}')),
        F.concat(F.lit('{"a": '), number), F.lit(None).cast("string"), F.lit(" "),
        F.concat(F.repeat(F.lit("["), depth), number, F.repeat(F.lit("]"), depth)),
        F.concat(F.lit('{"n": 1.50, "e": 1E3, "big": 1'), F.repeat(F.lit("0"), depth), F.lit(', "u": "\\u00e9é"}')),
    )
    text = F.lit(None).cast("string")
    for k, made in enumerate(kinds):
        text = F.when(F.col("doc_id") % 8 == k, made).otherwise(text)
    return table(spark, sf, "documents", spread=True).select("doc_id", text.alias("json"))


def _s_odd(kind: int, path: str, type_: str, value: str) -> str:
    return f"SELECT doc_id, {path} AS path, '{type_}' AS type, {value} AS value FROM ({ODD_SQL}) WHERE kind = {kind}"


@query(
    "odd_record_leaves",
    " UNION ALL ".join(
        (
            _s_odd(0, "'a' || repeat('.a', d - 1)", "string", "'x' || doc_id"), _s_odd(1, "'k'", "number", "doc_id::VARCHAR"),
            _s_odd(2, "'[\"a.b\"]'", "string", "'x'"), _s_odd(2, "'a.b'", "string", "doc_id::VARCHAR"),
            _s_odd(2, "'a[\"c[0]\"]'", "number", "'1'"), _s_odd(2, "'a.c[0]'", "number", "'2'"),
            _s_odd(6, "repeat('[0]', d)", "number", "doc_id::VARCHAR"), _s_odd(7, "'n'", "number", "'1.5'"),
            _s_odd(7, "'e'", "number", "'1000.0'"), _s_odd(7, "'big'", "number", "'1' || repeat('0', d)"), _s_odd(7, "'u'", "string", "'éé'"),
        )
    ),
)
def odd_record_leaves(spark, sf):
    return records.json_leaves(_odd_records(spark, sf), "doc_id", "json").select("doc_id", "path", "type", "value")


@query(
    "record_rejects",
    f"SELECT doc_id, CASE kind WHEN 3 THEN 'invalid JSON' WHEN 4 THEN 'no record' ELSE 'empty text' END AS reason FROM ({ODD_SQL}) WHERE kind IN (3, 4, 5)",
)
def record_rejects(spark, sf):
    return records.record_rejects(_odd_records(spark, sf), "doc_id", "json")

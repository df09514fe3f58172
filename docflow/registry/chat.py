"""Conversation queries over the whole conversations table (and events for patient switches)."""

from pyspark.sql import functions as F

from docflow.operators import chat as ct
from docflow.registry.base import query, s_list, s_quote, table
from docflow.registry.scalars import S_INTENT

# Keywords that occur in the invented prose of the test conversations.
KEYWORDS = {
    "generate_ppa": ("Élle", "heit ung"),
    "get_constants": ("que les", "the ’an", "ción"),
    "generate_recommendations": ("eaux", "über", "thation"),
}
PLAIN = {"generate_ppa": ("elle", "heit ung"), "get_constants": ("que les", "the 'an", "cion"), "generate_recommendations": ("eaux", "uber", "thation")}


def _s_hits(words):
    norm = S_INTENT.format("text")
    cases = ", ".join(
        "CASE WHEN " + " OR ".join(f"contains(n, {s_quote(w)})" for w in ws) + f" THEN '{intent}' END" for intent, ws in words.items()
    )
    return f"SELECT conv_id, turn, list_filter([{cases}], lambda x: x IS NOT NULL) AS hits FROM (SELECT conv_id, turn, {norm} AS n FROM conversations WHERE role = 'user')"


def user_turns(spark, sf):
    return table(spark, sf, "conversations").where(F.col("role") == "user")


@query("intent_keywords", f"SELECT conv_id, turn, unnest(hits) AS intent FROM ({_s_hits(PLAIN)})")
def intent_keywords(spark, sf):
    return user_turns(spark, sf).select("conv_id", "turn", F.explode(ct.intent_hits(F.col("text"), KEYWORDS)).alias("intent"))


@query("intent_keywords_compat", f"SELECT conv_id, turn, unnest(hits) AS intent FROM ({_s_hits(KEYWORDS)})")
def intent_keywords_compat(spark, sf):
    return user_turns(spark, sf).select(
        "conv_id", "turn", F.explode(ct.intent_hits(F.col("text"), KEYWORDS, compat=True)).alias("intent")
    )


INTENT_SQL = f"""SELECT conv_id, turn, CASE WHEN list_contains(hits, 'generate_recommendations') THEN 'generate_recommendations' WHEN list_contains(hits, 'generate_ppa') THEN 'generate_ppa'
  WHEN list_contains(hits, 'get_constants') THEN 'get_constants' ELSE 'unknown' END AS intent FROM ({_s_hits(PLAIN)})"""


@query("intent_priority", INTENT_SQL)
def intent_priority(spark, sf):
    return user_turns(spark, sf).select("conv_id", "turn", ct.top_intent(ct.intent_hits(F.col("text"), KEYWORDS)).alias("intent"))


@query(
    "confirm_text",
    f"""SELECT conv_id, turn, CASE intent WHEN 'unknown' THEN {s_quote("❌ Cette demande ne peut pas être traitée par l’assistant, car elle sort du cadre de l'accompagnement des personnes âgées.")} || chr(10) || chr(10) ||
        'Voici quelques exemples de requêtes que vous pouvez utiliser :' || chr(10) || '- *Prépare-moi le plan d’aide pour Madame Dupont*' || chr(10) || '- *Montre-moi les constantes du patient Martin sur le dernier mois*' || chr(10) || '- *Quelles sont les recommandations en cas d’AVC ?*'
        ELSE 'Je comprends que vous souhaitez une ' || CASE intent WHEN 'generate_ppa' THEN 'demande de génération de PPA' WHEN 'get_constants' THEN 'demande de constantes patient' ELSE 'demande de recommandations de soins' END || ', est-ce que vous confirmez oui/non ?' END AS reply FROM ({INTENT_SQL})""",
)
def confirm_text(spark, sf):
    return user_turns(spark, sf).select(
        "conv_id", "turn", ct.confirm_text(ct.top_intent(ct.intent_hits(F.col("text"), KEYWORDS))).alias("reply")
    )


# Typed messages: the type follows the turn, the patient the length of the text.
S_TYPE = "CASE WHEN role = 'user' THEN CASE WHEN turn % 4 < 2 THEN 'user_request' ELSE 'confirm_answer' END WHEN role = 'assistant' THEN CASE WHEN turn % 4 < 2 THEN 'confirm_prompt' ELSE 'bot_response' END END"
MSG_SQL = f"""SELECT conv_id AS session, turn, role, CASE WHEN role = 'assistant' AND length(text) % 2 = 0 THEN text || ' Confirmez ?' ELSE text END AS text, {S_TYPE} AS msg_type,
  'P' || (length(text) % 2) AS patient_key, 'u' || (conv_id % 10) AS user_id FROM conversations"""


def messages(spark, sf):
    early = F.col("turn") % 4 < 2
    kind = F.when(F.col("role") == "user", F.when(early, "user_request").otherwise("confirm_answer")).when(
        F.col("role") == "assistant", F.when(early, "confirm_prompt").otherwise("bot_response")
    )
    ask = (F.col("role") == "assistant") & (F.length("text") % 2 == 0)
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session"), "turn", "role",
        F.when(ask, F.concat("text", F.lit(" Confirmez ?"))).otherwise(F.col("text")).alias("text"), kind.alias("msg_type"),
        F.concat(F.lit("P"), (F.length("text") % 2).cast("string")).alias("patient_key"),
        F.concat(F.lit("u"), (F.col("conv_id") % 10).cast("string")).alias("user_id"),
    )


@query("unify_messages", f"SELECT session, turn, CASE WHEN role = 'system' THEN NULL ELSE role END AS role, text, msg_type, patient_key, user_id FROM ({MSG_SQL})")
def unify_messages(spark, sf):
    """User turns as API messages, assistant turns as interface components with nested children."""
    m = messages(spark, sf)
    tag = F.struct("patient_key", "user_id", "msg_type")
    api = F.to_json(F.struct("role", "text", "msg_type", "patient_key", "user_id"))
    nested = F.to_json(F.struct(F.struct(tag.alias("id"), F.lit("bot-response").alias("className"), F.struct(F.struct(F.col("text").alias("children")).alias("props")).alias("children")).alias("props")))
    flat = F.to_json(F.struct(F.struct(tag.alias("id"), F.lit("other").alias("className"), F.col("text").alias("children")).alias("props")))
    raw = F.when(F.col("role") == "user", api).when(F.col("role") == "assistant", nested).otherwise(flat)
    return ct.unify_messages(m.select("session", "turn", raw.alias("message")))


CURRENT_SQL = f"SELECT session, arg_max(patient_key, turn) AS patient_key, arg_max(user_id, turn) AS user_id FROM ({MSG_SQL}) GROUP BY session"


@query("filter_history", f"SELECT m.* FROM ({MSG_SQL}) m JOIN ({CURRENT_SQL}) c ON c.session = m.session AND c.patient_key = m.patient_key AND c.user_id = m.user_id")
def filter_history(spark, sf):
    m = messages(spark, sf)
    current = m.groupBy("session").agg(F.max_by("patient_key", "turn").alias("patient_key"), F.max_by("user_id", "turn").alias("user_id"))
    return ct.filter_history(m, current)


def _s_bounds(prompt, request):
    return f"""SELECT m.*, c.prompt, (SELECT max(turn) FROM ({MSG_SQL}) x WHERE x.session = m.session AND x.turn < c.prompt) AS previous,
      coalesce((SELECT max(turn) FROM ({MSG_SQL}) x WHERE x.session = m.session AND x.turn < c.prompt AND {request}), (SELECT max(turn) FROM ({MSG_SQL}) x WHERE x.session = m.session AND x.turn < c.prompt), c.prompt) AS start
      FROM ({MSG_SQL}) m LEFT JOIN (SELECT session, max(turn) AS prompt FROM ({MSG_SQL}) WHERE {prompt} GROUP BY session) c ON c.session = m.session"""


_COLS = "session, turn, role, text, msg_type, patient_key, user_id"
BLOCK_SQL = _s_bounds("msg_type = 'confirm_prompt'", "x.msg_type = 'user_request'")


@query("last_confirm_block", f"SELECT {_COLS} FROM ({BLOCK_SQL}) WHERE prompt IS NULL OR turn BETWEEN start AND prompt")
def last_confirm_block(spark, sf):
    return ct.last_confirm_block(messages(spark, sf))


@query(
    "retag_last_turn",
    f"SELECT session, turn, role, text, msg_type, CASE WHEN turn = prompt OR turn = previous THEN 'FINAL' || session ELSE patient_key END AS patient_key, user_id FROM ({BLOCK_SQL})",
)
def retag_last_turn(spark, sf):
    m = messages(spark, sf)
    final = m.select("session", F.concat(F.lit("FINAL"), F.col("session").cast("string")).alias("final_key")).distinct()
    return ct.retag_last_turn(m, final)


@query(
    "trim_to_confirmation",
    f"""SELECT {_COLS} FROM ({_s_bounds("(msg_type = 'confirm_prompt' OR (role = 'assistant' AND contains(lower(text), 'confirmez')))", "(x.msg_type = 'user_request' OR x.role = 'user')")}) WHERE prompt IS NULL OR turn >= start""",
)
def trim_to_confirmation(spark, sf):
    return ct.trim_to_confirmation(messages(spark, sf))


# Requests: the long text decides a name, short answers become yes or no.
REQ_SQL = f"""SELECT u.conv_id AS session, u.turn, CASE WHEN length(text) % 3 = 0 THEN ' OUI !' WHEN length(text) % 3 = 1 THEN 'C’est bien ça.' ELSE text END AS text, intent,
  CASE WHEN length(text) % 5 > 0 THEN 'N' || (length(text) % 5) END AS name FROM conversations u JOIN ({INTENT_SQL}) i ON i.conv_id = u.conv_id AND i.turn = u.turn WHERE role = 'user'"""


def requests(rows):
    n = F.length("text")
    said = F.when(n % 3 == 0, " OUI !").when(n % 3 == 1, "C’est bien ça.").otherwise(F.col("text"))
    return rows.select(
        F.col("conv_id").alias("session"), "turn", said.alias("text"),
        ct.top_intent(ct.intent_hits(F.col("text"), KEYWORDS)).alias("intent"),
        F.when(n % 5 > 0, F.concat(F.lit("N"), (n % 5).cast("string"))).alias("name"),
    )


DIALOGUE_SQL = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn) - 1 AS n, lag(intent) OVER (PARTITION BY session ORDER BY turn) AS pi, lag(name) OVER (PARTITION BY session ORDER BY turn) AS pn FROM ({REQ_SQL})),
 a AS (SELECT session, turn, CASE WHEN n % 2 = 0 THEN 'ask' WHEN trim(replace(lower(trim(text)), '’', ''''), ' .!?,;:') IN ({s_list(("oui", "yes", "ok", "o", "y", "c'est bien ça"))}) THEN 'execute' ELSE 'reset' END AS action,
   CASE WHEN n % 2 = 0 THEN intent ELSE pi END AS intent, CASE WHEN n % 2 = 0 THEN name ELSE pn END AS patient FROM r),
 s AS (SELECT session, turn, patient IS DISTINCT FROM lag(patient) OVER (PARTITION BY session ORDER BY turn) AS sw FROM a WHERE action = 'execute' AND patient IS NOT NULL AND intent <> 'unknown')
 SELECT a.*, coalesce(sw, FALSE) AS switched FROM a LEFT JOIN s ON s.session = a.session AND s.turn = a.turn"""


@query("confirm_dialogue", DIALOGUE_SQL)
def confirm_dialogue(spark, sf):
    return ct.confirm_dialogue(requests(user_turns(spark, sf)))


PAIRS_SQL = f"""SELECT session, turn, text AS question, next_text AS answer FROM (SELECT *, lead(role) OVER (PARTITION BY session ORDER BY turn) AS next_role,
  lead(text) OVER (PARTITION BY session ORDER BY turn) AS next_text FROM ({MSG_SQL})) WHERE role = 'user' AND next_role = 'assistant'"""


@query("turn_pairs", PAIRS_SQL)
def turn_pairs(spark, sf):
    return ct.turn_pairs(messages(spark, sf))


@query(
    "awaiting_confirmation",
    f"""SELECT session, coalesce(t[1] = 'user_request' AND t[2] = 'confirm_prompt', FALSE) AS awaiting FROM (SELECT session, CASE WHEN count(*) > 1 THEN list(msg_type ORDER BY turn)[-2:] ELSE [NULL, NULL] END AS t FROM ({MSG_SQL}) GROUP BY session)""",
)
def awaiting_confirmation(spark, sf):
    return ct.awaiting_confirmation(messages(spark, sf))


@query(
    "history_append",
    f"""WITH b AS (SELECT session, turn // 2 AS batch, CASE WHEN msg_type = 'user_request' THEN 'display' ELSE 'delta' END AS kind, turn, text FROM ({MSG_SQL})),
       c AS (SELECT session, max(batch) AS f FROM b WHERE kind = 'display' GROUP BY session)
       SELECT b.session, batch, kind, turn, text, row_number() OVER (PARTITION BY b.session ORDER BY batch, turn) - 1 AS position FROM b LEFT JOIN c ON c.session = b.session WHERE f IS NULL OR batch >= f""",
)
def history_append(spark, sf):
    m = messages(spark, sf)
    batches = m.select(
        "session", F.floor(F.col("turn") / 2).alias("batch"),
        F.when(F.col("msg_type") == "user_request", "display").otherwise("delta").alias("kind"), "turn", "text",
    )
    return ct.history_append(batches)


EXPORT_SQL = f"""SELECT session, turn // 1000 AS part, string_agg('### 🧑‍⚕️ Utilisateur' || chr(10) || chr(10) || '> ' || trim(question, chr(10) || ' ') || chr(10) || chr(10) || '**🤖 Réponse Assistant :**' || chr(10) || chr(10) || trim(answer, chr(10) || ' '),
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS markdown FROM ({PAIRS_SQL}) GROUP BY ALL"""


@query("export_markdown", EXPORT_SQL)
def export_markdown(spark, sf):
    return ct.export_markdown(ct.turn_pairs(messages(spark, sf)))


@query("export_rejects", f"SELECT DISTINCT conv_id AS session FROM conversations WHERE conv_id NOT IN (SELECT session FROM ({PAIRS_SQL}))")
def export_rejects(spark, sf):
    m = messages(spark, sf)
    return ct.sessions_without_turns(m, ct.turn_pairs(m))


@query(
    "session_state",
    f"""SELECT session, turn, user_id, patient_key, pending FROM (SELECT *, coalesce(msg_type = 'confirm_prompt', FALSE) AS pending, row_number() OVER (PARTITION BY session ORDER BY turn DESC) AS r FROM ({MSG_SQL}))
       WHERE r = 1 AND coalesce(msg_type <> 'bot_response', TRUE)""",
)
def session_state(spark, sf):
    m = messages(spark, sf)
    rows = m.withColumn("pending", F.coalesce(F.col("msg_type") == "confirm_prompt", F.lit(False))).withColumn(
        "ended", F.coalesce(F.col("msg_type") == "bot_response", F.lit(False))
    )
    return ct.session_state(rows, ["user_id", "patient_key", "pending"])


@query(
    "switch_detect",
    "SELECT event_id, user_id, event_type, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS switched FROM events",
)
def switch_detect(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return ct.switch_detect(rows, ["user_id"], "event_id", "event_type", F.floor(F.col("event_id") / 4096))

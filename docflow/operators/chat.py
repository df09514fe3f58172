"""Conversation analytics: intents, confirmation dialogue, history isolation, export.

A message row is ``session, turn, role, text, msg_type, patient_key, user_id``. Rules about "the last
prompt" are aggregations joined back, not windows, so a very long session is not one task.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.text import norm_edges, normalize_intent_text
from docflow.functions.wordlists import INTENT_KEYWORDS, INTENT_PRIORITY, YES_ANSWERS
from docflow.operators.ordered import turn_bucket, with_previous, with_row_index

UNKNOWN = "unknown"
_EXAMPLES = (
    "- *Prépare-moi le plan d’aide pour Madame Dupont*\n"
    "- *Montre-moi les constantes du patient Martin sur le dernier mois*\n"
    "- *Quelles sont les recommandations en cas d’AVC ?*"
)
_ASKED = {
    "generate_ppa": "demande de génération de PPA",
    "get_constants": "demande de constantes patient",
    "generate_recommendations": "demande de recommandations de soins",
}


# ------------------------------------------------------------------ intents

def intent_hits(text: Column, keywords: dict[str, tuple[str, ...]] = INTENT_KEYWORDS, compat: bool = False) -> Column:
    """Array of the intents whose keywords occur in the text, one pattern per intent.

    Keywords are normalised like the text. ``compat=True`` leaves them as written, so keywords with
    accents never match.
    """
    plain = normalize_intent_text(text)
    found = [F.when(plain.rlike(_folded(words, compat)), F.lit(intent)) for intent, words in keywords.items()]
    return F.array_compact(F.array(*found))


def _folded(words: tuple[str, ...], compat: bool) -> str:
    """Alternation of literal keywords; folding happens once, on the driver, over the fixed lists."""

    def plain(w: str) -> str:
        t = unicodedata.normalize("NFD", w.lower().replace("’", "'").replace("‘", "'").replace("`", "'"))
        t = "".join(c for c in t if unicodedata.category(c) != "Mn")
        return " ".join(re.sub(r"[^a-z0-9' ]", " ", t).split())

    return "|".join(f"\\Q{w if compat else plain(w)}\\E" for w in words)


def top_intent(hits: Column, priority: dict[str, int] = INTENT_PRIORITY) -> Column:
    """Highest-priority intent, ``unknown`` when none matched."""
    ranked = sorted(priority, key=priority.get, reverse=True)
    return F.coalesce(*[F.when(F.array_contains(hits, i), F.lit(i)) for i in ranked], F.lit(UNKNOWN))


def confirm_text(intent: Column, assistant: str = "l’assistant") -> Column:
    """Question that asks to confirm the intent, or the refusal with examples."""
    refusal = (
        f"❌ Cette demande ne peut pas être traitée par {assistant}, car elle sort du cadre de "
        f"l'accompagnement des personnes âgées.\n\nVoici quelques exemples de requêtes que vous pouvez utiliser :\n{_EXAMPLES}"
    )
    text = F.lit(refusal)
    for name, asked in _ASKED.items():
        question = f"Je comprends que vous souhaitez une {asked}, est-ce que vous confirmez oui/non ?"
        text = F.when(intent == name, question).otherwise(text)
    return text


def is_yes(answer: Column) -> Column:
    t = F.replace(F.lower(norm_edges(answer)), F.lit("’"), F.lit("'"))
    return F.btrim(norm_edges(t), F.lit(" .!?,;:")).isin(*YES_ANSWERS)


# ------------------------------------------------------------------ history

def unify_messages(raw: DataFrame, message: str = "message") -> DataFrame:
    """Replace a JSON message by ``role, text, msg_type, patient_key, user_id``.

    Understands API messages and serialised interface components (nested or plain children).
    """
    v = F.try_parse_json(F.col(message))

    def at(path: str) -> Column:
        return F.try_variant_get(F.col("_v"), path, "string")

    is_component = F.try_variant_get(F.col("_v"), "$.props", "variant").isNotNull()
    css = F.coalesce(at("$.props.className"), F.lit(""))
    shown = F.coalesce(at("$.props.children.props.children"), at("$.props.children"), F.lit(""))
    role = F.when(css.contains("bot-response"), "assistant").when(css.contains("user-message"), "user")
    plain = F.coalesce(F.nullif(at("$.markdown"), F.lit("")), at("$.text"), F.lit(""))

    def field(name: str) -> Column:
        return F.when(is_component, at(f"$.props.id.{name}")).otherwise(at(f"$.{name}"))

    rest = [c for c in raw.columns if c != message]
    return raw.withColumn("_v", v).select(
        *rest,
        F.when(is_component, role).otherwise(at("$.role")).alias("role"),
        F.when(is_component, shown).otherwise(plain).alias("text"),
        *[field(n).alias(n) for n in ("msg_type", "patient_key", "user_id")],
    )


def filter_history(messages: DataFrame, current: DataFrame) -> DataFrame:
    """Messages of each session's current patient and user only."""
    return messages.join(current.select("session", "patient_key", "user_id"), ["session", "patient_key", "user_id"], "left_semi")


def _last_prompt(messages: DataFrame, is_prompt: Column, is_request: Column) -> DataFrame:
    """Messages with ``prompt`` (last prompt turn) and ``start`` (last request before it, else the row before)."""
    prompts = messages.where(is_prompt).groupBy("session").agg(F.max("turn").alias("prompt"))
    before = messages.join(prompts, "session").where(F.col("turn") < F.col("prompt"))
    starts = before.groupBy("session").agg(
        F.max(F.when(is_request, F.col("turn"))).alias("request"), F.max("turn").alias("previous")
    )
    bounds = prompts.join(starts, "session", "left").select(
        "session", "prompt", "previous", F.coalesce("request", "previous", "prompt").alias("start")
    )
    return messages.join(bounds, "session", "left")


def last_confirm_block(messages: DataFrame) -> DataFrame:
    """From the last request before the last prompt through the prompt; everything when there is no prompt."""
    kind = F.col("msg_type")
    bounded = _last_prompt(messages, kind == "confirm_prompt", kind == "user_request")
    inside = F.col("turn").between(F.col("start"), F.col("prompt"))
    return bounded.where(F.col("prompt").isNull() | inside).select(*messages.columns)


def retag_last_turn(messages: DataFrame, final: DataFrame) -> DataFrame:
    """Give the last prompt and the row before it the final patient key of ``final(session, final_key)``."""
    kind = F.col("msg_type")
    bounded = _last_prompt(messages, kind == "confirm_prompt", kind == "user_request").join(final, "session", "left")
    hit = (F.col("turn") == F.col("prompt")) | (F.col("turn") == F.col("previous"))
    key = F.when(hit & F.col("final_key").isNotNull(), F.col("final_key")).otherwise(F.col("patient_key"))
    return bounded.withColumn("patient_key", key).select(*messages.columns)


def trim_to_confirmation(messages: DataFrame) -> DataFrame:
    """Everything from the request of the last confirmation question on."""
    asks = (F.col("role") == "assistant") & F.lower("text").contains("confirmez")
    prompt = F.coalesce(F.col("msg_type") == "confirm_prompt", F.lit(False)) | asks
    request = F.coalesce(F.col("msg_type") == "user_request", F.lit(False)) | (F.col("role") == "user")
    bounded = _last_prompt(messages, prompt, request)
    return bounded.where(F.col("prompt").isNull() | (F.col("turn") >= F.col("start"))).select(*messages.columns)


def history_append(batches: DataFrame) -> DataFrame:
    """Interface history from ``session, batch, kind, turn, ...``.

    A ``display`` batch replaces everything before it, a ``delta`` batch adds; turns are numbered anew.
    """
    cut = batches.where(F.col("kind") == "display").groupBy("session").agg(F.max("batch").alias("_from"))
    kept = batches.join(cut, "session", "left").where(F.col("_from").isNull() | (F.col("batch") >= F.col("_from"))).drop("_from")
    numbered = kept.withColumn("_o", F.struct("batch", "turn"))
    return with_row_index(numbered, ["session"], "_o", F.col("batch"), "position").drop("_o")


def turn_pairs(messages: DataFrame) -> DataFrame:
    """``session, turn, question, answer``: each user message directly followed by an assistant message."""
    prev = with_previous(messages.select("session", "turn", "role", "text"), ["session"], "turn", ["role", "text"], turn_bucket("turn"))
    return prev.where((F.col("role") == "assistant") & (F.col("prev.role") == "user")).select(
        "session", F.col("prev.turn").alias("turn"), F.col("prev.text").alias("question"), F.col("text").alias("answer")
    )


def awaiting_confirmation(messages: DataFrame) -> DataFrame:
    """Per session: are the last two messages a request and its confirmation prompt?"""
    prev = with_previous(messages.select("session", "turn", "msg_type"), ["session"], "turn", ["msg_type"], turn_bucket("turn"))
    last = prev.groupBy("session").agg(
        F.max_by(F.struct(F.col("prev.msg_type").alias("a"), F.col("msg_type").alias("b")), "turn").alias("x")
    )
    ok = (F.col("x.a") == "user_request") & (F.col("x.b") == "confirm_prompt")
    return last.select("session", F.coalesce(ok, F.lit(False)).alias("awaiting"))


def export_markdown(pairs: DataFrame, assistant: str = "Assistant", turns_per_part: int = 1000) -> DataFrame:
    """``session, part, markdown``. Long sessions become several parts, so no row grows without bound."""
    block = F.concat(
        F.lit("### 🧑‍⚕️ Utilisateur\n\n> "), norm_edges("question"), F.lit(f"\n\n**🤖 Réponse {assistant} :**\n\n"), norm_edges("answer")
    )
    parts = pairs.select("session", F.floor(F.col("turn") / turns_per_part).alias("part"), "turn", block.alias("b"))
    grouped = parts.groupBy("session", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "b"))).alias("x"))
    return grouped.select("session", "part", F.array_join(F.transform("x", lambda r: r["b"]), "\n\n---\n\n").alias("markdown"))


def sessions_without_turns(sessions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sessions that cannot be exported."""
    return sessions.select("session").distinct().join(pairs.select("session"), "session", "left_anti")


def session_state(events: DataFrame, fields: list[str], order: str = "turn") -> DataFrame:
    """Latest field values of every session that has not ended."""
    latest = events.groupBy("session").agg(
        F.max_by(F.struct(*fields, "ended"), F.col(order)).alias("s"), F.max(order).alias(order)
    )
    return latest.where(~F.col("s.ended")).select("session", order, *[f"s.{f}" for f in fields])


def switch_detect(rows: DataFrame, keys: list[str], order: str, patient: str, bucket: Column) -> DataFrame:
    """Add ``switched``: the patient differs from the one before in the same session."""
    prev = with_previous(rows, keys, order, [patient], bucket)
    return prev.withColumn("switched", ~F.col(patient).eqNullSafe(F.col(f"prev.{patient}"))).drop("prev")


# ------------------------------------------------------------------ dialogue

def confirm_dialogue(requests: DataFrame) -> DataFrame:
    """Replay the confirmation dialogue over user messages ``session, turn, text, intent, name``.

    Any message that finds the session idle is a request and leaves it pending; the next one is its
    answer and leaves it idle again. So a message is an answer exactly when its number within the
    session is odd. Result: ``session, turn, action`` (ask, execute, reset), the executed ``intent``
    and ``patient``, and ``switched`` when that patient differs from the last executed one.
    """
    numbered = with_row_index(requests, ["session"], "turn", turn_bucket("turn"), "n")
    paired = with_previous(numbered, ["session"], "turn", ["intent", "name"], turn_bucket("turn"), into="asked")
    answer = F.col("n") % 2 == 1
    action = F.when(~answer, "ask").when(is_yes(F.col("text")), "execute").otherwise("reset")
    acted = paired.withColumn("action", action).select(
        "session", "turn", "action",
        F.when(F.col("action") == "ask", F.col("intent")).otherwise(F.col("asked.intent")).alias("intent"),
        F.when(F.col("action") == "ask", F.col("name")).otherwise(F.col("asked.name")).alias("patient"),
    )
    named = (F.col("action") == "execute") & F.col("patient").isNotNull() & (F.col("intent") != UNKNOWN)
    moved = switch_detect(acted.where(named), ["session"], "turn", "patient", turn_bucket("turn"))
    return acted.join(moved.select("session", "turn", "switched"), ["session", "turn"], "left").withColumn(
        "switched", F.coalesce("switched", F.lit(False))
    )

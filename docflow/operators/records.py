"""Nested person records as a leaf table: one row per JSON leaf, with its path.

Working on leaves turns recursive clean-up rules into plain filters: a container exists only through
its leaves, so dropping rows prunes empty containers by itself.
"""

from __future__ import annotations

import json as js
import re
from collections.abc import Iterator
from json.decoder import scanstring

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.text import is_empty_marker
from docflow.runtime import materialize

#: Keys of leaves that one Arrow batch holds at most, but for a single leaf that lies deeper.
BATCH_KEYS = 1 << 19
#: Places of leaves that a task remembers between records.
PLACES = 20_000
#: Names that every task of a name lookup gets at most; more are dealt out by their substrings.
FEW_NAMES = 50_000

# --- fixed values: nulls that stay in a cleaned record ---
KEPT_NULL_KEYS = ("situationFamiliale",)
KEPT_NULL_PATHS = (
    "usager.Informations d'état civil.personnePhysique.situationFamiliale",
    "usager.contactInfosPersonnels.domicile",
    "usager.contactInfosPersonnels.mobile",
    "usager.contactInfosPersonnels.mail",
)

# --- fixed values: branches removed from every record before it is used ---
SENSITIVE_PATHS = (
    "usager.Informations d'état civil.personnePhysique.communeNaissance.libelleCommune",
    "usager.Informations d'état civil.personnePhysique.communeNaissance.codePostal",
    "usager.Informations d'état civil.personnePhysique.communeNaissance.inseeCommune",
    "usager.Informations d'état civil.personnePhysique.paysNaissance.libellePays",
    "usager.Informations d'état civil.personnePhysique.paysNaissance.inseePays",
    "usager.mouvement.service",
    "usager.mouvement.secteur",
    "contacts[*].adresse.ligne",
    "contacts[*].adresse.codePostal",
    "contacts[*].adresse.libelleCommune",
    "contacts[*].contactInfosPersonnels.domicile",
    "contacts[*].contactInfosPersonnels.mobile",
    "contacts[*].contactInfosPersonnels.mailMSSANTE",
    "contacts[*].contactInfosPersonnels.mailPro",
    "contacts[*].numRpps",
    "contacts[*].structure",
    "contacts[*].typeStructure",
    "contacts[*].finessET",
    "contacts[*].dateDesignationPersonneConfiance",
    "contacts[*].dateDesignationResponsableLegal",
)


# A key that a path can't show as it is stands in brackets and quotes, so different key lists have different paths.
_ODD_KEY = r'[.\[\]"]'
_INDEX = r"^\[[0-9]+\]$"


def _quoted(key: str) -> str:
    escaped = key.replace("\\", "\\\\").replace('"', '\\"')
    return f'["{escaped}"]'


def path_text(keys: Column) -> Column:
    """``a.b[0].c`` from the key list ``[a, b, [0], c]``; a key with dots, brackets or quotes gives ``a["b.c"]``."""

    def piece(k: Column) -> Column:
        escaped = F.replace(F.replace(k, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        odd = F.concat(F.lit('["'), escaped, F.lit('"]'))
        return F.when(k.rlike(_INDEX), k).when(k.rlike(r'^\["\[[0-9]+\]"\]$'), k).when(k.rlike(_ODD_KEY), odd).otherwise(F.concat(F.lit("."), k))

    return F.regexp_replace(F.array_join(F.transform(keys, piece), ""), r"^\.", "")


class _Number(str):
    """The text of a number, told apart from a string."""

    __slots__ = ()


def _float(text: str) -> _Number:
    value = float(text)
    return _Number(text if value in (float("inf"), float("-inf")) else repr(value))


def _constant(text: str) -> _Number:
    return _Number(str(float(text)))


_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_WORDS = {"null": None, "true": True, "false": False, "NaN": _constant("nan"), "Infinity": _constant("inf"), "-Infinity": _constant("-inf")}


def _parse_nested(text: str):
    """JSON that is nested deeper than the parser of the standard library goes: open containers are on a list."""
    at, holders, keys = _SPACE.match(text).end(), [], []
    while True:
        if text[at : at + 1] in ("{", "["):
            holders.append({} if text[at] == "{" else [])
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] != ("}" if isinstance(holders[-1], dict) else "]"):
                if isinstance(holders[-1], dict):
                    at = _key(text, at, keys)
                continue
            at, value = at + 1, holders.pop()
        elif text[at : at + 1] == '"':
            value, at = scanstring(text, at + 1, True)
        elif word := next((w for w in _WORDS if text.startswith(w, at)), None):
            value, at = _WORDS[word], at + len(word)
        elif number := _NUMBER.match(text, at):
            value, at = _float(number[0]) if number[1] or number[2] else _Number(number[0]), number.end()
        else:
            raise ValueError("no value")
        while True:  # the value is complete: give it to its container, which may end here too
            at = _SPACE.match(text, at).end()
            if not holders:
                if at != len(text):
                    raise ValueError("more than one value")
                return value
            holder = holders[-1]
            if isinstance(holder, dict):
                holder[keys.pop()] = value
            else:
                holder.append(value)
            sign = text[at : at + 1]
            at = _SPACE.match(text, at + 1).end()
            if sign == ",":
                if isinstance(holder, dict):
                    at = _key(text, at, keys)
                break
            if sign != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError("container not closed")
            value = holders.pop()


def _key(text: str, at: int, keys: list[str]) -> int:
    if text[at : at + 1] != '"':
        raise ValueError("no key")
    key, at = scanstring(text, at + 1, True)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError("no colon")
    keys.append(key)
    return _SPACE.match(text, at + 1).end()


_DECODER = js.JSONDecoder(parse_int=_Number, parse_float=_float, parse_constant=_constant)


def _read(text: str | None):
    """The record and None, or None and why there is none. Of a key that is repeated the last value counts."""
    if text is None:
        return None, "no record"
    text = text.removeprefix("\ufeff")
    if not text.strip():
        return None, "empty text"
    try:
        return _DECODER.decode(text), None
    except RecursionError:
        pass
    except ValueError:
        return None, "invalid JSON"
    try:
        return _parse_nested(text), None
    except ValueError:
        return None, "invalid JSON"


class _Place:
    """A key below another place. Records of one form share their places, so a key's text is made once."""

    __slots__ = ("up", "key", "step", "below")

    def __init__(self, up: _Place | None, key: str, step: str):
        self.up, self.key, self.step, self.below = up, key, step, {}

    def under(self, key: str | int) -> _Place:
        if isinstance(key, int):
            name = step = f"[{key}]"
        elif re.search(_ODD_KEY, key):
            step = _quoted(key)
            name = step if re.search(_INDEX, key) else key
        else:
            name, step = key, key if self.up is None else f".{key}"
        place = self.below[key] = _Place(self, name, step)
        return place

    def keys_and_path(self) -> tuple[list[str], str]:
        keys, steps, place = [], [], self
        while place.up is not None:
            keys.append(place.key)
            steps.append(place.step)
            place = place.up
        return keys[::-1], "".join(reversed(steps))


def _leaves_of(record, top: _Place) -> Iterator[tuple[_Place, str, str | None]]:
    """Place, type and text of every leaf in the order of the record, without recursion."""
    waiting = [(top, record)]
    while waiting:
        place, value = waiting.pop()
        if value is None:
            yield place, "null", None
        elif isinstance(value, _Number):
            yield place, "number", str(value)
        elif isinstance(value, str):
            yield place, "string", value
        elif isinstance(value, bool):
            yield place, "boolean", "true" if value else "false"
        elif not value:
            yield place, "empty", "{}" if isinstance(value, dict) else "[]"
        else:
            below = place.below
            children = value.items() if isinstance(value, dict) else enumerate(value)
            waiting += [(below.get(k) or place.under(k), v) for k, v in children][::-1]


def _depth(record) -> int:
    depth, level = 0, [record]
    while level := [c for v in level if isinstance(v, (dict, list)) for c in ((v.values() if isinstance(v, dict) else v) or (None,))]:
        depth += 1
    return depth


def _strings(values: list) -> pa.Array:
    """Half of a character pair alone, which JSON may hold and a table can't, becomes a question mark."""
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([v if v is None else v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for v in values], pa.string())


def _walk(max_depth: int | None):
    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = _Place(None, "", "")
        for batch in batches:
            rows, at, types, values, n_keys = [], [], [], [], 0
            places: dict[_Place, tuple[int, int]] = {}  # number in this output batch and count of keys
            texts: list[tuple[list[str], str]] = []

            def flush(ids=batch.column(0)):
                nonlocal rows, at, types, values, n_keys, places, texts
                offsets = np.concatenate([[0], np.cumsum([len(k) for k, _ in texts], dtype=np.int64)])
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _strings([k for keys, _ in texts for k in keys]))
                place = pa.array(at, pa.int64())
                out = [
                    ids.take(pa.array(rows, pa.int64())), listed.take(place), _strings([p for _, p in texts]).take(place),
                    pa.array(types, pa.string()), _strings(values),
                ]
                rows, at, types, values, n_keys, places, texts = [], [], [], [], 0, {}, []
                return pa.record_batch(out, names=["id", "keys", "path", "type", "value"])

            for i, text in enumerate(batch.column(1).to_pylist()):
                record, reason = _read(text)
                if reason or max_depth is not None and _depth(record) > max_depth:
                    continue
                for place, kind, value in _leaves_of(record, top):
                    if (known := places.get(place)) is None:
                        texts.append(place.keys_and_path())
                        known = places[place] = len(places), len(texts[-1][0])
                    rows.append(i)
                    at.append(known[0])
                    types.append(kind)
                    values.append(value)
                    n_keys += known[1]
                    if n_keys >= BATCH_KEYS:
                        yield flush()
                if len(places) > PLACES:  # records of many forms: remembered places would fill the memory
                    yield flush()
                    top = _Place(None, "", "")
            yield flush()
            top = _Place(None, "", "")

    return leaves


def _refuse(max_depth: int | None):
    def reasons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, said = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                record, reason = _read(text)
                if not reason and max_depth is not None and _depth(record) > max_depth:
                    reason = f"nested deeper than {max_depth}"
                if reason:
                    rows.append(i)
                    said.append(reason)
            yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(said, pa.string())], names=["id", "reason"])

    return reasons


def _id_field(records: DataFrame, doc_id: str) -> str:
    return f"`{doc_id}` {records.schema[doc_id].dataType.simpleString()}"


def record_rejects(records: DataFrame, doc_id: str, json: str, max_depth: int | None = None) -> DataFrame:
    """``doc_id, reason`` of the records without leaves: null, blank, no JSON or, on request, too deep."""
    return records.select(doc_id, json).mapInArrow(_refuse(max_depth), f"{_id_field(records, doc_id)}, reason string")


def json_leaves(records: DataFrame, doc_id: str, json: str, max_depth: int | None = None) -> DataFrame:
    """``doc_id, keys, path, type, value`` for every leaf; empty containers count as leaves.

    Each record is read once, in Arrow batches without a shuffle, at any depth; of a repeated key the last value
    counts. Leaves carry all their keys, so a record's rows are as large as its leaves times their depth.
    ``record_rejects`` lists the records that have none. In ``keys`` a list item is ``[0]``; an object's key that
    looks so is quoted.
    """
    return records.select(doc_id, json).mapInArrow(
        _walk(max_depth), f"{_id_field(records, doc_id)}, keys array<string>, path string, type string, value string"
    )


def string_leaves(leaves: DataFrame) -> DataFrame:
    return leaves.where(F.col("type") == "string")


def _under_any(rules: tuple[str, ...]) -> Column:
    any_index = r"\E\[[0-9]+\]\Q"
    return F.col("path").rlike("^(" + "|".join(f"\\Q{r.replace('[*]', any_index)}\\E" for r in rules) + r")($|[.\[])")


def clean_reason() -> Column:
    """Why a leaf is removed, or null when it stays."""
    key = F.element_at("keys", -1)
    keep_null = key.isin(*KEPT_NULL_KEYS) | F.col("path").isin(*KEPT_NULL_PATHS)
    return (
        F.when(_under_any(SENSITIVE_PATHS), "sensitive")
        .when(F.col("type") == "empty", "empty container")
        .when((F.col("type") == "string") & is_empty_marker("value"), "empty value")
        .when((F.col("type") == "null") & ~keep_null, "null")
    )


def mark_cleaned(leaves: DataFrame) -> DataFrame:
    return leaves.withColumn("reason", clean_reason())


def clean_leaves(leaves: DataFrame) -> DataFrame:
    """Leaves without empty markers, nulls and sensitive branches."""
    return mark_cleaned(leaves).where(F.col("reason").isNull()).drop("reason")


def containers(leaves: DataFrame, doc_id: str) -> DataFrame:
    """Every object or list that encloses a leaf."""
    depth = F.sequence(F.lit(1), F.size("keys") - 1)
    prefixes = F.transform(depth, lambda n: path_text(F.slice(F.col("keys"), F.lit(1), n)))
    inner = leaves.where(F.size("keys") > 1)
    return inner.select(doc_id, F.explode(prefixes).alias("container")).distinct()


def clean_trace(marked: DataFrame, doc_id: str) -> DataFrame:
    """``doc_id, path, message`` for every removal and every null kept on purpose."""
    message = (
        F.when(F.col("reason").isNotNull(), F.concat(F.lit("Removed "), F.col("reason"), F.lit(" at: "), F.col("path")))
        .when(F.col("type") == "null", F.concat(F.lit("Kept null at preserved key/path: "), F.col("path")))
    )
    return marked.select(doc_id, "path", message.alias("message")).where(F.col("message").isNotNull())


def emptied_containers(marked: DataFrame, doc_id: str) -> DataFrame:
    """Containers that lose their last leaf."""
    kept = containers(marked.where(F.col("reason").isNull()), doc_id)
    return containers(marked, doc_id).join(kept, [doc_id, "container"], "left_anti")


def find_records(names: DataFrame, files: DataFrame) -> DataFrame:
    """``name, file, n_matches``: first file (by name) whose stem contains the name, ignoring case.

    A substring join without comparing all pairs: file stems are indexed by their substrings of up to three
    characters, and a name probes with the one of its own that the fewest stems have, so names and stems that share
    a beginning don't all meet. ``n_matches > 1`` warns of an ambiguous person.
    """
    size = F.least(F.length("n"), F.lit(3))
    own = F.transform(F.sequence(F.lit(1), F.length("n") - size + 1), lambda i: F.substring(F.col("n"), i, size))
    wanted = names.select("name", F.lower("name").alias("n")).distinct().where(F.length("n") > 0)
    wanted = wanted.select("name", "n", F.explode(F.array_distinct(own)).alias("gram"))
    stem = F.lower(F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"(?<=.)\.[^.]+$", ""))
    starts = F.sequence(F.lit(1), F.greatest(F.length("stem"), F.lit(1)))
    grams = F.array_distinct(
        F.flatten(F.transform(starts, lambda i: F.array(*[F.substring(F.col("stem"), i, F.lit(k)) for k in (1, 2, 3)])))
    )
    indexed = files.select("file", stem.alias("stem")).select("file", "stem", F.explode(grams).alias("gram"))
    counts = indexed.groupBy("gram").agg(F.count(F.lit(1)).alias("stems"))
    rarest = F.min(F.struct(F.coalesce("stems", F.lit(0)).alias("stems"), "gram")).alias("least")
    probes = wanted.join(counts, "gram", "left").groupBy("name", "n").agg(rarest).select("name", "n", "least.gram")
    probes = materialize(probes, "probes")  # one row per name; few of them go to the stems, which then aren't shuffled
    few = probes.limit(FEW_NAMES + 1).count() <= FEW_NAMES
    hits = indexed.join(F.broadcast(probes) if few else probes, "gram").where(F.col("stem").contains(F.col("n")))
    found = hits.groupBy("name").agg(F.min("file").alias("file"), F.count("*").alias("n_matches"))
    return names.select("name").distinct().join(found, "name", "left").select(
        "name", "file", F.coalesce("n_matches", F.lit(0)).alias("n_matches")
    )

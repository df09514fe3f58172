"""Text, number and date scalars as Column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.functions.wordlists import (
    EMPTY_MARKERS,
    NOISE_WORDS,
    NOT_GIVEN,
    TITLE_SMALL_WORDS,
)

# Java's Unicode \s lacks the four ASCII separators that Python's split() removes.
SPACES = r"(?U)[\s\x1c-\x1f]+"
# Anything but single blanks between printable ASCII: the rest is normal text already.
_ODD_TEXT = r"[^ -~]|^ | $"
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body`` (keeps generated plans small)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def constant(value) -> Column:
    """A literal array, map or scalar as one parsed expression (lists to arrays, dicts to maps)."""
    return F.expr(_sql(value))


def _sql(value) -> str:
    if isinstance(value, dict):
        return f"map({', '.join(_sql(x) for pair in value.items() for x in pair)})"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(_sql(x) for x in value)})"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else repr(value)


@lru_cache(maxsize=None)
def _accent_pairs(form: str) -> tuple[str, str]:
    """Every BMP letter whose decomposition is one base character plus marks."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        ch = chr(code)
        decomposed = unicodedata.normalize(form, ch)
        base = "".join(c for c in decomposed if not unicodedata.combining(c))
        if len(base) == 1 and base != ch:
            source.append(ch)
            target.append(base)
    return "".join(source), "".join(target)


def norm_space(x: Column | str) -> Column:
    """Collapse every run of Unicode spaces to one blank and trim."""
    return F.trim(F.regexp_replace(_col(x), SPACES, " "))


def strip_accents(x: Column | str, form: str = "NFD") -> Column:
    """Remove diacritics; stays in the JVM (character table plus mark removal)."""
    source, target = _accent_pairs(form)
    return F.regexp_replace(F.translate(_col(x), source, target), r"\p{Mn}+", "")


@lru_cache(maxsize=None)
def _maybe_not_nfkc() -> str:
    """Pattern of characters that NFKC may change. All others, Latin letters above all, stay as they are in any text."""
    def inert(ch: str) -> bool:
        return unicodedata.is_normalized("NFKC", ch) and not unicodedata.combining(ch)

    ranges = [[0, 0x7F]]
    # none of these composes with a character before it, as combining marks and Hangul letters do
    for code in [c for c in (*range(0x80, 0x250), *range(0x2010, 0x2070), 0x20AC) if inert(chr(c))]:
        if code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    # ASCII is passed by at once, without a look at all the ranges
    return r"(?![\x00-\x7F])[^" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


@F.pandas_udf(T.StringType())
def _nfkc_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def nfkc(x: Column | str, whole: Column | None = None) -> Column:
    """NFKC. Only values that it may change travel to the Arrow worker; ``whole`` may hold what x is a part of."""
    x = _col(x)
    needs = (x if whole is None else whole).rlike(_maybe_not_nfkc())
    return F.when(needs, _nfkc_batch(F.when(needs, x))).otherwise(x)


def casefold(x: Column | str) -> Column:
    return F.replace(F.lower(_col(x)), F.lit("ß"), F.lit("ss"))


def norm_for_eq(x: Column | str) -> Column:
    """Comparison form of a title: NFKC, no zero-width characters, one-blank spaces, casefold."""
    cleaned = F.translate(nfkc(F.coalesce(_col(x), F.lit(""))), "\u200b\ufeff", "")
    return casefold(norm_space(cleaned))


def normalize_intent_text(x: Column | str) -> Column:
    """Lower case, plain apostrophes, no accents, only ``a-z0-9' `` left."""
    t = F.translate(F.lower(F.coalesce(_col(x), F.lit(""))), "’‘`", "'''")
    return norm_space(F.regexp_replace(strip_accents(t), r"[^a-z0-9' ]", " "))


def normalize_token(x: Column | str) -> Column:
    """Strip accents, lower, and drop punctuation at both ends."""
    t = F.lower(strip_accents(norm_edges(_col(x)), "NFKD"))
    return F.btrim(t, F.lit(" .,-_/\\"))


def norm_edges(x: Column | str) -> Column:
    """Python-style strip: Unicode spaces at both ends only."""
    return F.regexp_replace(_col(x), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def norm_name_key(x: Column | str) -> Column:
    """Accent-free, one-blank, casefolded key used to compare names."""
    return casefold(norm_space(strip_accents(_col(x), "NFKD")))


def looks_shouting(x: Column | str) -> Column:
    """At least three letters, 80 % of them upper case."""
    x = _col(x)
    adjacent = x.rlike(r"\p{Lu}\P{L}*+\p{Lu}")  # always there then, and seldom in other text
    letters = F.length(F.regexp_replace(x, r"\P{L}+", ""))
    upper = F.length(F.regexp_replace(x, r"\P{Lu}+", ""))
    return adjacent & (letters >= 3) & (upper >= 0.8 * letters)


def _capital_first(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, sys.maxsize >> 33)))


def smart_title_fr(x: Column | str) -> Column:
    """French title case: acronyms kept, elided articles curled, small words lowered."""

    def title(word: Column, i: Column) -> Column:
        article = F.lower(F.substring(word, 1, 1))
        rest = F.regexp_extract(word, r"(?s)^[dlDL]['’](.+)$", 1)
        return (
            F.when(word.rlike(r"^[A-Z0-9]{2,}$"), word)
            .when(rest != "", F.concat(article, F.lit("’"), _capital_first(rest)))
            .when(F.lower(word).isin(*TITLE_SMALL_WORDS) & (i > 0), F.lower(word))
            .otherwise(_capital_first(word))
        )

    words = F.split(_col(x), r"(?U)(?<=\S)(?=\s)|(?<=\s)(?=\S)")
    return F.array_join(F.transform(words, title), "")


def norm_text(x: Column | str, case_mode: str = "auto", fold_spaces: bool = True) -> Column:
    """Normalised display text; ``auto`` re-titles only shouted text, null becomes ''."""
    raw = F.coalesce(_col(x).cast("string"), F.lit(""))
    full = nfkc(norm_edges(raw), raw)
    odd = raw.rlike(_ODD_TEXT)
    if fold_spaces:
        full, odd = norm_space(full), raw.rlike(_ODD_TEXT + "|  ")
    t = F.when(odd, full).otherwise(raw)
    if case_mode == "lower":
        return F.lower(t)
    if case_mode == "upper":
        return F.upper(t)
    if case_mode == "title":
        return smart_title_fr(t)
    if case_mode == "auto":
        return let(t, auto_case)
    return t


def auto_case(t: Column) -> Column:
    """``norm_text`` in its ``auto`` form for a text that is normalised with ``keep``."""
    return F.when(looks_shouting(t), smart_title_fr(t)).otherwise(t)


def _or_default(x: Column, default: str = NOT_GIVEN) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def norm_bool(x: Column | str) -> Column:
    text = norm_text(_col(x))
    low = F.lower(text)
    return (
        F.when(low.isin("true", "vrai", "oui"), "Oui")
        .when(low.isin("false", "faux", "non"), "Non")
        .otherwise(_or_default(text))
    )


def _first_timestamp(raw: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in formats])


def iso_date(normal: Column) -> Column:
    """``norm_date`` for a text that is already normalised; stays in the JVM."""
    stamp = _first_timestamp(normal, ("yyyy-M-d", "yyyy-M-d H:m:s", "d/M/yyyy", "d/M/yyyy H:m"))
    return F.when(normal == "", NOT_GIVEN).otherwise(F.coalesce(F.date_format(stamp, "yyyy-MM-dd"), normal))


def norm_date(x: Column | str) -> Column:
    """Four accepted layouts to ISO date; any other text stays as it is."""
    return let(norm_text(_col(x), case_mode="keep"), iso_date)


def norm_number(x: Column | str) -> Column:
    """Decimal comma to point when the text is a number, otherwise normalised text."""
    raw = norm_text(_col(x), case_mode="keep")
    dotted = F.translate(raw, ",", ".")
    return F.when(raw == "", NOT_GIVEN).when(dotted.rlike(_NUMBER), dotted).otherwise(norm_text(_col(x)))


# Lenient layouts, tried in order. Month-first wins for ambiguous slashes, day-first is the fallback.
LENIENT_DATE_FORMATS = (
    "yyyy-M-d", "yyyy-M-d['T'][' ']H:m", "yyyy-M-d['T'][' ']H:m:s", "yyyy-M-d['T'][' ']H:m:s.SSS",
    "yyyy-M-d['T'][' ']H:m:s.SSSSSS", "yyyyMMdd", "yyyy/M/d", "M/d/yyyy", "d/M/yyyy", "d.M.yyyy",
    "M/d/yyyy H:m", "d/M/yyyy H:m", "M/d/yyyy H:m:s", "d/M/yyyy H:m:s",
    "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy",
)


def parse_any_date(x: Column | str) -> Column:
    """Best-effort ISO timestamp; keeps a UTC offset if one is given; raw text if not parseable."""
    offset = r"(?<=[0-9])\s*(Z|[+-][0-9]{2}:?[0-9]{2})$"
    raw = norm_edges(_col(x))
    zone = F.when(raw.rlike(r"[0-9]:[0-9]"), F.regexp_extract(raw, offset, 1)).otherwise("")
    local = F.when(zone != "", F.regexp_replace(raw, offset, "")).otherwise(raw)
    zone_text = (
        F.when(zone == "", "")
        .when(zone == "Z", "+00:00")
        .otherwise(F.concat(F.substring(zone, 1, 3), F.lit(":"), F.right(zone, F.lit(2))))
    )

    def iso(stamp: Column) -> Column:
        micros = F.date_format(stamp, "SSSSSS")
        fraction = F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros))
        return F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), fraction)

    stamp = let(local, lambda t: _first_timestamp(t, LENIENT_DATE_FORMATS))
    return F.when(raw != "", F.coalesce(F.concat(let(stamp, iso), zone_text), raw))


def first_nonblank(*values: Column | str, default: str | None = None) -> Column:
    """First value that is not null or blank, trimmed."""
    trimmed = [F.nullif(norm_edges(_col(v).cast("string")), F.lit("")) for v in values]
    return F.coalesce(*trimmed, F.lit(default).cast("string"))


def join_nonblank(values: Column, sep: str = ", ", default: str = NOT_GIVEN) -> Column:
    """Join the non-blank items of an array of already normalised texts."""
    kept = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    return _or_default(F.array_join(kept, sep), default)


def cap_text(x: Column | str, max_chars: int) -> Column:
    return F.substring(norm_space(F.coalesce(_col(x), F.lit(""))), 1, max_chars)


def shorten_ellipsis(x: Column | str, max_chars: int) -> Column:
    """Cut at the last blank before the limit unless that loses 40 %, then add an ellipsis."""
    t = norm_space(F.coalesce(_col(x), F.lit("")))
    if max_chars <= 1:
        return F.when(t == "", "").otherwise("…")

    def cut(full: Column) -> Column:
        head = F.substring(full, 1, max_chars - 1)
        back = F.instr(F.reverse(head), " ")
        at = max_chars - 1 - back
        hard = (back == 0) | (at < int(0.6 * max_chars))
        end = F.when(hard, max_chars - 1).otherwise(at)
        short = F.concat(F.rtrim(F.substring(full, F.lit(1), end)), F.lit("…"))
        return F.when(F.length(full) <= max_chars, full).otherwise(short)

    return let(t, cut)


def is_irrelevant_text(x: Column | str) -> Column:
    """True for blank or tiny texts, and for short ones that hold a boilerplate word."""
    t = norm_edges(F.coalesce(_col(x), F.lit("")))
    words = "|".join(f"\\Q{w}\\E" for w in NOISE_WORDS)
    return (F.length(t) < 5) | ((F.length(t) < 60) & F.lower(t).rlike(words))


def is_empty_marker(x: Column | str) -> Column:
    t = norm_edges(_col(x))
    # no marker is that long, and lower case of long texts takes its time
    return F.when(F.length(t) > 64, F.lit(False)).otherwise(F.lower(t).isin(*EMPTY_MARKERS))


def validate_patient_name(x: Column | str) -> Column:
    """A model's answer counts as a name only if it is one word and not the refusal sentence."""
    t = norm_edges(_col(x))
    bad = t.contains("Nom patient introuvable") | norm_space(t).contains(" ")
    return F.when(~bad, _capital_first(t))


def patient_key(name: Column | str, file_path: Column | str | None = None) -> Column:
    """File stem if a path is known, else the upper-cased name with underscores, else UNKNOWN."""
    upper = F.regexp_replace(F.upper(norm_edges(F.coalesce(_col(name), F.lit("")))), SPACES, "_")
    key = _or_default(upper, "UNKNOWN")
    if file_path is None:
        return key
    base = F.regexp_extract(_col(file_path), r"([^/]+)/*$", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")
    return F.coalesce(F.nullif(stem, F.lit("")), key)

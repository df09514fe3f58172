"""Query registration, table access and the SQL snippets the expected-result strings share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docflow.runtime import fill_cores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` is the same result in DuckDB SQL."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A standard table. ``spread`` cuts a scan of few files into enough tasks for row-heavy parsing."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return fill_cores(df) if spread else df


# Unicode spaces for RE2, whose \s is ASCII only.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
# Scheme, netloc, path, query of a URL.
URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def s_space(e: str) -> str:
    return f"trim(regexp_replace({e}, '{WS}', ' ', 'g'))"


def s_edges(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}|{WS}$', '', 'g')"


def s_part(e: str, n: int) -> str:
    return f"regexp_extract({e}, '{URL}', {n})"


def s_domain(e: str) -> str:
    return f"regexp_replace(lower({s_part(e, 2)}), '^www\\.', '')"


def s_quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def s_list(words) -> str:
    return ", ".join(s_quote(w) for w in words)


def s_irrelevant(e: str) -> str:
    from docflow.functions.wordlists import NOISE_WORDS

    t = s_edges(e)
    hits = " OR ".join(f"contains(lower({e}), {s_quote(w)})" for w in NOISE_WORDS)
    return f"(length({t}) < 5 OR (length({t}) < 60 AND ({hits})))"

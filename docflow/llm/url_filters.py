"""Allow and block rules for URLs by hashed expressions.

A rule names a host and the start of a path; it fits that host and all hosts below it. Each URL is expanded into
expressions, a suffix of its host's labels and a prefix of its path, of just those shapes (number of labels,
length of path) that some rule has, so that no rule is missed and long URLs make no more expressions than short
ones. Expressions meet the rules by the first 32 bits of their digests, full digests confirm, and of the rules
that fit the longest one wins.

Defined results
    null url        no ``://``: host and path are empty
    other texts     whatever stands there is cut as the rules say; nothing is decoded, ports stay with the host
    ties            of fitting rules of one length the one with the longer host wins; of several verdicts for one
                    rule the last in code-point order, so block goes before allow
    null rules      a rule without host or verdict fits nothing; a null path is the empty one, which all paths start with
    no rule fits    ``rule`` is null and the verdict is ``default``
    repeated rows   each row of the input is one row of the result
    empty tables    no pages, no rows; no rules, every URL has the default verdict
    other columns   are not read
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.runtime import materialize

RULES = "host string, path string, verdict string"
#: Rules of up to so many bytes go to every task; more of them meet the expressions in a shuffle.
BROADCAST_BYTES = 32 << 20
#: In that shuffle, expressions that at least this share of the URLs have are joined apart.
HOT_SHARE = 1 / 1000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased over A-Z, and path; both empty where the URL is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def _digest(host: Column, path: Column) -> Column:
    """Of an expression; the length of the host keeps ``a`` + ``b/`` and ``ab`` + ``/`` apart."""
    return F.sha2(F.concat(F.length(host), F.lit(":"), host, path), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _prepared(rules: DataFrame) -> DataFrame:
    """``short, digest, labels, length, rule, n_host, verdict``, one row for each host and path."""
    rows = rules.where("host IS NOT NULL AND verdict IS NOT NULL").select(
        F.translate("host", string.ascii_uppercase, string.ascii_lowercase).alias("h"),
        F.coalesce("path", F.lit("")).alias("p"), "verdict",
    )
    rows = rows.groupBy("h", "p").agg(F.max("verdict").alias("verdict"))
    digest = _digest(F.col("h"), F.col("p"))
    return rows.select(
        _short(digest).alias("short"), digest.alias("digest"), _labels(F.col("h")).alias("labels"), F.length("p").alias("length"),
        F.concat("h", "p").alias("rule"), F.length("h").alias("n_host"), "verdict",
    )


def _expressions(urls: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """A row for each URL and shape with ``short, digest``; both null where the URL is too small for the shape."""
    shape = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in shapes))).alias("shape")
    rows = urls.select("*", shape)
    fits = (F.col("shape.k") <= _labels(F.col("host"))) & (F.col("shape.n") <= F.length("path"))
    digest = _digest(F.expr("substring_index(host, '.', -shape.k)"), F.substr("path", F.lit(1), F.col("shape.n")))
    return rows.withColumn("digest", F.when(fits, digest)).drop("shape").withColumn("short", _short(F.col("digest")))


def _met(urls: DataFrame, rules: DataFrame, shapes: list[tuple[int, int]], broadcast_bytes: int) -> DataFrame:
    """The URLs with the rules that fit them, at least one row each: equal short prefixes first, then equal digests.

    Beyond the size that may be broadcast, rules that a large share of the expressions meet are told by a count
    and joined apart: there are at most ``1 / HOT_SHARE`` for each shape, so they can go to every task.
    """
    expressions = _expressions(urls, shapes)
    rules = rules.select(F.col("short").alias("s"), F.col("digest").alias("full"), "rule", "n_host", "verdict")
    size = rules.agg(F.sum(F.octet_length("rule") + 120)).first()[0] or 0
    confirmed = (F.col("short") == F.col("s")) & (F.col("digest") == F.col("full"))
    if size <= broadcast_bytes:
        return expressions.join(F.broadcast(rules), confirmed, "left")
    expressions = expressions.where("digest IS NOT NULL")
    counts = expressions.groupBy("short", "digest").agg(F.count(F.lit(1)).alias("uses"))
    used = materialize(counts.join(rules, confirmed).drop("short", "s", "full"), "used-rules")
    total = used.agg(F.sum("uses")).first()[0] or 0
    used = used.withColumn("hot", F.col("uses") >= max(2, total * HOT_SHARE)).drop("uses")
    hot, rest = used.where("hot").drop("hot"), used.where("NOT hot").drop("hot")
    found = expressions.join(F.broadcast(hot), "digest").unionByName(expressions.join(rest.hint("merge"), "digest"))
    return found.unionByName(urls, allowMissingColumns=True)


def _repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column ``times`` says, by arrays of bounded size."""
    block = 1 << 16
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / block))))
    left = F.least(F.lit(block), F.col(times) - F.col("block") * block)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), left.cast("int")))).drop("block", "copy")


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row; ``rules`` has columns host, path and verdict.

    Equal rows are judged once. They are dealt by id and URL one time; choosing the longest rule needs no other
    exchange when the rules are broadcast.
    """
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    urls = urls.groupBy("id", "url").agg(F.count(F.lit(1)).alias("copies")).withColumns({"host": host, "path": path})
    prepared = materialize(_prepared(rules), "url-rules")
    shapes = [tuple(r) for r in prepared.select("labels", "length").distinct().collect()]  # at most labels x path lengths
    fitting = F.struct(F.length("rule").alias("n"), "n_host", "rule", F.col("verdict").alias("said"))
    if shapes:
        met = _met(urls, prepared, shapes, broadcast_bytes)
        best = F.max(F.when(F.col("rule").isNotNull(), fitting)).alias("best")
        judged = met.groupBy("id", "url").agg(best, *(F.first(c).alias(c) for c in ("host", "path", "copies")))
    else:
        judged = urls.withColumn("best", F.lit(None).cast("struct<rule:string,said:string>"))
    return _repeated(judged, "copies").select(
        F.col("id").alias("page_id"), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.said", F.lit(default)).alias("verdict"),
    )


def example_rules(spark: SparkSession) -> DataFrame:
    """The rules of the query: block net/, allow example.net/en/, block example.com/de/, allow org/fr/."""
    rows = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    return spark.createDataFrame(rows, RULES)

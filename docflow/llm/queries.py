"""The operators as named queries over the standard tables, with the SQL that states their rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm import (
    decontamination, exact_dedup, jaccard_join, line_dedup, packing, pii, quality, spelling, substring_dedup, suffix_dedup,
    toxicity, url_filters, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers  # only packing needs it, the other queries work without

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op2_packing")
def op2(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


# DuckDB's lower() folds more than A-Z, so the letters are translated.
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op5_exact_dedup",
    f"""
    WITH hashed AS (SELECT doc_id, sha256({ASCII_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents),
    groups AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM hashed GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM hashed JOIN groups USING (text_sha256)
    """,
)
def op5(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


@query("op7_quality")
def op7(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_toxicity")
def op10(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_substring_dedup")
def op6(spark, sf_dir):
    rows = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_suffix_dedup")
def op8(spark, sf_dir):
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# Words and distinct five-word shingles of every text, as rows.
SHINGLES = f"""
    words AS (SELECT {{key}}, list_filter(regexp_split_to_array({ASCII_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {{table}}),
    {{name}} AS (
        SELECT DISTINCT {{key}}, array_to_string(w[i:i+4], ' ') AS s
        FROM (SELECT {{key}}, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
    )"""


@query(
    "op1_jaccard_join",
    f"""
    WITH RECURSIVE {SHINGLES.format(key="doc_id", table="documents", name="shingles")},
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
    reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(other) AS component_id
    FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach ON d.doc_id = reach.id GROUP BY ALL
    """,
)
def op1(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


@query(
    "op9_decontamination",
    f"""
    WITH {SHINGLES.format(key="doc_id", table="documents", name="d")},
    {SHINGLES.format(key="item_id", table="benchmark", name="i").replace("words", "item_words")},
    sizes AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
    hits AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
    SELECT doc_id, item_id, n_item, n_shared FROM hits JOIN sizes USING (item_id) WHERE 10 * n_shared >= 8 * n_item
    """,
)
def op9(spark, sf_dir):
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_pii")
def op4(spark, sf_dir):
    rows = pii.find_personal_data(table(spark, sf_dir, "documents"))
    joined = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.BASE]
    return rows.select(
        "doc_id", *counts, F.sha2(F.expr(joined.format("base")), 256).alias("base_sha256"),
        F.expr(joined.format("concat(base, added)")).alias("spans"),
    )


@query(
    "op3_line_dedup",
    f"""
    WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
    lines AS (SELECT doc_id, unnest(parts) AS content, unnest(range(len(parts))) AS line FROM cut),
    sets AS (
        SELECT doc_id, line, list_sort(list_distinct(list_filter(regexp_split_to_array({ASCII_LOWER.format("content")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS w
        FROM lines
    ),
    nodes AS (SELECT w, min((doc_id, line)) AS place FROM sets WHERE len(w) >= 1 GROUP BY w),
    named AS (SELECT row_number() OVER (ORDER BY place) AS node, w, place FROM nodes),
    tokens AS (SELECT node, len(w) AS n, unnest(w) AS token FROM named),
    counts AS (SELECT token, count(*) AS df FROM tokens GROUP BY token),
    placed AS (SELECT node, n, token, row_number() OVER (PARTITION BY node ORDER BY df, token) AS pos FROM tokens JOIN counts USING (token)),
    prefixes AS (SELECT * FROM placed WHERE pos <= n - (4 * n + 4) // 5 + 1),
    pairs AS (SELECT DISTINCT a.node AS a, b.node AS b FROM prefixes a JOIN prefixes b USING (token) WHERE a.node < b.node AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
    near AS (
        SELECT DISTINCT b FROM pairs JOIN named x ON a = x.node JOIN named y ON b = y.node
        WHERE 9 * len(list_intersect(x.w, y.w)) >= 4 * (len(x.w) + len(y.w))
    ),
    gone AS (
        SELECT doc_id, line FROM sets JOIN named USING (w)
        WHERE (doc_id, line) <> place OR node IN (SELECT b FROM near)
    )
    SELECT cut.doc_id, len(parts) AS n_lines, coalesce(n, 0) AS n_removed,
        sha256(coalesce(array_to_string(list_filter(parts, lambda x, i: NOT list_contains(coalesce(out, []), i - 1)), chr(10)), '')) AS kept_sha256
    FROM cut LEFT JOIN (SELECT doc_id, count(*) AS n, list(line) AS out FROM gone GROUP BY doc_id) USING (doc_id)
    """,
)
def op3(spark, sf_dir):
    rows = line_dedup.remove_matching_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_whitening")
def op11(spark, sf_dir):
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("bigint"))


@query(
    "op12_url_filters",
    f"""
    WITH rules AS (
        SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(rule_host, rule_path, verdict)
    ),
    rests AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    hosts AS (SELECT k, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rests),
    urls AS (SELECT k, page_id, {ASCII_LOWER.format("raw")} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
    fits AS (
        SELECT k, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
        FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        GROUP BY k
    )
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN fits USING (k)
    """,
)
def op12(spark, sf_dir):
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), url_filters.example_rules(spark))


# One bit of a CRC-32.
CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"


@query(
    "op13_spelling_variants",
    f"""
    WITH RECURSIVE crc AS (
        SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, k: {CRC_STEP})) AS tab
    ),
    runs AS (SELECT doc_id, unnest(regexp_extract_all({ASCII_LOWER.format("text")}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
    pairs AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
    bytes AS (
        SELECT doc_id, run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END)) AS b
        FROM pairs
    ),
    hashed AS (SELECT run, n, xor(list_reduce([4294967295::BIGINT] || b, lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM bytes, crc),
    spelt AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
    words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    holes AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
    near AS (
        SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b USING (i, rest) WHERE a.word <> b.word AND length(a.word) = length(b.word)
        UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON rest = w.word
        UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON rest = w.word
    ),
    ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM near),
    forms AS (
        SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
        FROM words w LEFT JOIN ranked k ON w.word = k.word AND r = 1
    ),
    walk(word, last) AS (SELECT word, word FROM words UNION ALL SELECT walk.word, form FROM walk JOIN forms ON last = forms.word WHERE form IS NOT NULL)
    SELECT f.word, form, last AS root, n, n_near, form_n
    FROM forms f JOIN walk USING (word) WHERE last IN (SELECT word FROM forms WHERE form IS NULL)
    """,
)
def op13(spark, sf_dir):
    rows = spelling.group_variants(table(spark, sf_dir, "documents"))
    return rows.select("word", "form", "root", "n", "n_near", "form_n")

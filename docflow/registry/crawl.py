"""Link graph, crawl rules, change detection and index audits."""

from pyspark.sql import functions as F

from docflow.functions import urls as ux
from docflow.operators import changes, docs, graph, pages, stats
from docflow.registry.base import query, s_domain, s_part, table
from docflow.registry.structure import (
    DOCX_CHUNKS_SQL, LINKS_SQL, WEB_CHUNKS_SQL, _s_pack, chunks_docx, parsed_pages, web_chunks,
)
from docflow.runtime import explode_rows


@query(
    "src_seeds",
    f"""SELECT page_id::VARCHAR AS site, base AS base_url, 200 AS max_pages, 1 AS max_depth, unnest([url, url || '/2']) AS seed_url
       FROM (SELECT page_id, url, {s_part('url', 1)} || '://' || {s_part('url', 2)} AS base FROM pages) WHERE starts_with(base, 'https')""",
)
def src_seeds(spark, sf):
    base = F.concat(ux.scheme("url"), F.lit("://"), ux.netloc("url"))
    sites = table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("name"),
        F.when(ux.scheme("url") == "https", base).alias("base_url"),
        F.array(F.col("url"), F.concat("url", F.lit("/2"))).alias("start_urls"),
    )
    return graph.seed_urls(sites).drop("allow_path_regex", "deny_query_regex", "seed_no")


@query("link_edges", f"SELECT url AS src, target AS dst FROM ({LINKS_SQL})")
def link_edges(spark, sf):
    links = pages.outlinks(parsed_pages(spark, sf))
    return links.select(F.col("url").alias("src"), F.col("target").alias("dst"))


EDGES_SQL = """SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
 UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
 UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders
 UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier"""


def key_edges(spark, sf):
    def edge(name, a, b, x, y):
        return table(spark, sf, name).select(
            F.concat(F.lit(a), F.col(x).cast("string")).alias("src"),
            F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"),
        )

    return (
        edge("nation", "r", "n", "n_regionkey", "n_nationkey")
        .unionByName(edge("customer", "n", "c", "c_nationkey", "c_custkey"))
        .unionByName(edge("orders", "c", "o", "o_custkey", "o_orderkey"))
        .unionByName(edge("supplier", "n", "s", "s_nationkey", "s_suppkey"))
    )


@query(
    "bounded_frontier",
    f"""WITH RECURSIVE e AS ({EDGES_SQL}), f AS (SELECT 'r' || r_regionkey AS node, 0 AS depth FROM region
       UNION SELECT e.dst, f.depth + 1 FROM f JOIN e ON e.src = f.node WHERE f.depth < 3)
       SELECT node, min(depth) AS depth FROM f GROUP BY node""",
)
def bounded_frontier(spark, sf):
    seeds = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.bounded_frontier(key_edges(spark, sf), seeds, max_depth=3)


# Crawl rules of the sample sites: by top-level domain, an allow-list for .org and .net, a deny-list for .net.
S_ALLOW = "CASE WHEN ends_with(base_netloc, '.org') THEN '^/[a-m]' WHEN ends_with(base_netloc, '.net') THEN '^/[A-Za-z]' END"
S_DENY = "CASE WHEN ends_with(base_netloc, '.net') THEN 'page=|utm_' END"


def _site_links(spark, sf):
    """Page links plus the page itself as a seed, with the site's rules."""
    parsed = parsed_pages(spark, sf)
    seeds = table(spark, sf, "pages").select("page_id", "url", F.col("url").alias("target"), F.lit(0).alias("depth"))
    links = pages.outlinks(parsed).withColumn("depth", F.lit(1))
    allow = (
        F.when(F.col("base_netloc").endswith(".org"), "^/[a-m]").when(F.col("base_netloc").endswith(".net"), "^/[A-Za-z]")
    )
    deny = F.when(F.col("base_netloc").endswith(".net"), "page=|utm_")
    return (
        seeds.unionByName(links)
        .withColumn("base_netloc", ux.netloc("url"))
        .withColumn("allow", allow)
        .withColumn("deny", deny)
    )


SITE_LINKS_SQL = f"""SELECT *, {S_ALLOW} AS allow, {S_DENY} AS deny FROM (
  SELECT page_id, url, target, depth, {s_part('url', 2)} AS base_netloc FROM (
    SELECT page_id, url, url AS target, 0 AS depth FROM pages UNION ALL SELECT page_id, url, target, 1 FROM ({LINKS_SQL})))"""


def _s_traverse(default):
    return f"""(depth = 0 OR NOT coalesce(regexp_matches({s_part('target', 4)}, deny), FALSE))
      AND (depth = 0 OR coalesce(regexp_matches({s_part('target', 3)}, allow), {default}))"""


@query(
    "traverse_filter",
    f"""SELECT page_id, target, depth, {_s_traverse('TRUE')} AS follow, {_s_traverse('FALSE')} AS follow_strict,
       coalesce(regexp_matches({s_part('target', 3)}, allow), TRUE) AS save FROM ({SITE_LINKS_SQL})""",
)
def traverse_filter(spark, sf):
    rows = _site_links(spark, sf)

    def follow(strict):
        return graph.may_traverse(
            F.col("target"), F.col("base_netloc"), F.col("allow"), F.col("deny"), F.col("depth"),
            F.col("depth") == 0, F.lit(1), strict_compat=strict,
        )

    return rows.select(
        "page_id", "target", "depth",
        follow(False).alias("follow"),
        follow(True).alias("follow_strict"),
        graph.may_save(F.col("target"), F.col("allow")).alias("save"),
    )


@query(
    "site_page_cap",
    f"""SELECT site, url, page_rank FROM (SELECT {s_domain('url')} AS site, url, row_number() OVER (PARTITION BY {s_domain('url')} ORDER BY url) AS page_rank
       FROM pages) WHERE page_rank <= 10""",
)
def site_page_cap(spark, sf):
    rows = table(spark, sf, "pages").select(ux.url_domain("url").alias("site"), "url")
    return graph.site_page_cap(rows, "site", ["url"], max_pages=10)


def _flagged(spark, sf):
    rows = _site_links(spark, sf).where(F.col("depth") == 1)
    known = table(spark, sf, "pages").select(F.col("url").alias("target"), F.lit(True).alias("seen"))
    flagged = rows.join(known, "target", "left")
    return flagged.select(
        "page_id", "base_netloc",
        F.coalesce("seen", F.lit(False)).alias("known"),
        ux.same_site("target", "url", exact=True).alias("same_host"),
        F.coalesce(F.rlike(ux.query("target"), F.col("deny")), F.lit(False)).alias("denied_query"),
        F.coalesce(F.rlike(ux.path("target"), F.col("allow")), F.lit(True)).alias("allowed_path"),
    )


def _s_counters(by):
    path_ok = f"coalesce(regexp_matches({s_part('target', 3)}, allow), TRUE)"
    return f"""SELECT {by}, count(*) AS total, count(*) FILTER (NOT known) AS same_host,
      count(*) FILTER (NOT known AND den) AS deny_q, count(*) FILTER (NOT known AND NOT den AND NOT {path_ok}) AS deny_path,
      count(*) FILTER (NOT known AND NOT den AND {path_ok}) AS enqueued
      FROM (SELECT *, target IN (SELECT url FROM pages) AS known, coalesce(regexp_matches({s_part('target', 4)}, deny), FALSE) AS den
            FROM ({SITE_LINKS_SQL}) WHERE depth = 1) GROUP BY {by}"""


@query("crawl_counters", _s_counters("page_id"))
def crawl_counters(spark, sf):
    return graph.crawl_counters(_flagged(spark, sf), ["page_id"])


@query("crawl_counters_by_site", _s_counters("base_netloc"))
def crawl_counters_by_site(spark, sf):
    return graph.crawl_counters(_flagged(spark, sf), ["base_netloc"])


# ------------------------------------------------------------ change detection

@query("content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", changes.content_hash("text").alias("sha256"))


# Before: no German documents yet; low-quality ones had another ending. Now: toxic ones are gone.
BEFORE_SQL = """SELECT doc_id, CASE WHEN quality = 0 THEN text || ' (v1)' ELSE text END AS text, lang FROM documents LEFT JOIN labels USING (doc_id) WHERE lang <> 'de'"""
NOW_SQL = "SELECT doc_id, text, lang FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0"
S_KIND = "CASE WHEN lang = 'en' THEN 'web' ELSE 'docx' END"


def versions(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    kind = F.when(F.col("lang") == "en", "web").otherwise("docx").alias("kind")
    name = F.col("doc_id").cast("string").alias("name")
    old_text = F.when(F.col("quality") == 0, F.concat("text", F.lit(" (v1)"))).otherwise(F.col("text"))
    before = d.where(F.col("lang") != "de").select(kind, name, old_text.alias("text"))
    now = d.where(F.coalesce("toxic", F.lit(0)) == 0).select(kind, name, "text")
    return before, now


def snapshot(df):
    return df.select("kind", "name", changes.content_hash("text").alias("sha256"))


DIFF_SQL = f"""SELECT coalesce(b.kind, n.kind) AS kind, coalesce(b.name, n.name) AS name, b.h AS old_hash, n.h AS new_hash,
  CASE WHEN n.h IS NULL THEN 'deleted' WHEN b.h IS NULL THEN 'added' WHEN b.h <> n.h THEN 'modified' ELSE 'unchanged' END AS status
  FROM (SELECT {S_KIND} AS kind, doc_id::VARCHAR AS name, sha256(text) AS h FROM ({BEFORE_SQL})) b
  FULL JOIN (SELECT {S_KIND} AS kind, doc_id::VARCHAR AS name, sha256(text) AS h FROM ({NOW_SQL})) n ON b.kind = n.kind AND b.name = n.name"""


def diff(spark, sf):
    before, now = versions(spark, sf)
    return changes.snapshot_diff(snapshot(before), snapshot(now))


@query("snapshot_diff", DIFF_SQL)
def snapshot_diff(spark, sf):
    return diff(spark, sf)


@query(
    "snapshot_diff_rebuild",
    f"SELECT kind, name, CASE WHEN kind = 'docx' AND status = 'unchanged' THEN 'modified' ELSE status END AS status FROM ({DIFF_SQL})",
)
def snapshot_diff_rebuild(spark, sf):
    before, now = versions(spark, sf)
    return changes.snapshot_diff(snapshot(before), snapshot(now), rebuild_kinds=("docx",)).select("kind", "name", "status")


@query(
    "orphan_purge",
    f"SELECT source_doc, fiche_id FROM (SELECT source AS source_doc, lpad(split_part(title, ' ', 2), 3, '0') AS fiche_id, source FROM ({DOCX_CHUNKS_SQL})) WHERE source_doc IN (SELECT 'guide_' || doc_id || '.docx' FROM labels)",
)
def orphan_purge(spark, sf):
    derived = chunks_docx(spark, sf).select(
        F.col("source").alias("source_doc"), F.lpad(F.split_part("title", F.lit(" "), F.lit(2)), 3, "0").alias("fiche_id")
    )
    live = table(spark, sf, "labels").select(
        F.concat(F.lit("guide_"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("source_doc")
    )
    return changes.orphan_purge(derived, live, "source_doc")


@query(
    "reindex_decision",
    f"""SELECT kind, count(*) FILTER (status IN ('added', 'modified')) AS n_changed, count(*) FILTER (status = 'deleted') AS n_deleted,
       bool_or(status <> 'unchanged') AS reindex FROM ({DIFF_SQL}) GROUP BY kind""",
)
def reindex_decision(spark, sf):
    return changes.reindex_decision(diff(spark, sf))


def passages(df):
    return explode_rows(df, ["name"], docs.pack_1k(docs.paragraphs("text")), "passage_no", "passage")


@query(
    "incremental_chunks",
    "SELECT doc_id::VARCHAR AS name, passage_no, passage FROM (" + _s_pack(False).replace("FROM documents)", f"FROM ({NOW_SQL}))") + ")",
)
def incremental_chunks(spark, sf):
    before, now = versions(spark, sf)
    delta = diff(spark, sf)
    changed = now.join(delta.where(F.col("status").isin("added", "modified")).select("name"), "name", "left_semi")
    return changes.incremental_chunks(passages(before), delta, passages(changed))


S_DEBOUNCE = """SELECT user_id, min(ts)::VARCHAR AS burst_start, max(ts)::VARCHAR AS burst_end, count(*) AS n_events FROM (
  SELECT user_id, ts, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (
    SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < {gap} * 1000000::BIGINT THEN 0 ELSE 1 END AS o FROM events))
  GROUP BY user_id, burst"""


def stamp(c):
    """Timestamp text without trailing zeros, as DuckDB prints it."""
    return F.regexp_replace(F.regexp_replace(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), "0+$", ""), r"\.$", "")


@query("debounce_events", S_DEBOUNCE.format(gap=7200))
def debounce_events(spark, sf):
    bursts = changes.debounce_events(table(spark, sf, "events"), "user_id", "ts", 7200)
    return bursts.select("user_id", stamp("burst_start").alias("burst_start"), stamp("burst_end").alias("burst_end"), "n_events")


@query(
    "watched_names",
    """SELECT event_type, count(*) AS n, count(*) FILTER (event_type NOT IN ('error', 'view', 'signup')) AS watched FROM events GROUP BY event_type""",
)
def watched_names(spark, sf):
    e = table(spark, sf, "events")
    num = F.col("event_id").cast("string")
    name = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("."), num))
        .when(F.col("event_type") == "view", F.concat(num, F.lit(".docx~")))
        .when(F.col("event_type") == "signup", F.concat(num, F.lit(".tmp")))
        .otherwise(F.concat(num, F.lit(".docx")))
    )
    ok = changes.is_watched_name(F.concat(F.lit("/data/in/"), name))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(ok).alias("watched"))


# ------------------------------------------------------------ index statistics

def all_chunks(spark, sf):
    return chunks_docx(spark, sf).unionByName(web_chunks(spark, sf), allowMissingColumns=True)


STATS_SQL = f"""SELECT 'docx' AS source_type, count(*) AS n_chunks, 0 AS n_pages, 0 AS n_domains, count(DISTINCT source) AS n_files, count(DISTINCT fiche_id) AS n_fiches FROM ({DOCX_CHUNKS_SQL})
  UNION ALL SELECT 'web', count(*), count(DISTINCT url), count(DISTINCT domain), 0, 0 FROM ({WEB_CHUNKS_SQL})"""


@query("index_stats", STATS_SQL)
def index_stats(spark, sf):
    return stats.index_stats(all_chunks(spark, sf))


@query(
    "key_presence",
    f"""WITH c AS (SELECT * FROM (SELECT chunk_id, fiche_id, NULL AS url, source, title FROM ({DOCX_CHUNKS_SQL})
        UNION ALL SELECT chunk_id, NULL, url, source, title FROM ({WEB_CHUNKS_SQL})))
       SELECT 'fiche_id' AS key, count(*) FILTER (coalesce(fiche_id, '') <> '') AS n_present FROM c UNION ALL
       SELECT 'url', count(*) FILTER (coalesce(url, '') <> '') FROM c UNION ALL SELECT 'source', count(*) FILTER (coalesce(source, '') <> '') FROM c
       UNION ALL SELECT '__empty__', 0""",
)
def key_presence(spark, sf):
    return stats.key_presence(all_chunks(spark, sf), ["fiche_id", "url", "source"], "chunk_id")


@query(
    "key_presence_all",
    f"""SELECT 'fiche_id' AS key, (SELECT count(*) FROM ({DOCX_CHUNKS_SQL})) AS n_present
       UNION ALL SELECT 'url', (SELECT count(*) FROM ({WEB_CHUNKS_SQL})) UNION ALL SELECT '__empty__', 0""",
)
def key_presence_all(spark, sf):
    return stats.key_presence(all_chunks(spark, sf), ["fiche_id", "url"], "chunk_id", first=None)


@query(
    "web_json_audit",
    """WITH d AS (SELECT doc_id, CASE WHEN lang = 'de' THEN [] WHEN lang = 'es' THEN ['', ' '] ELSE string_split(text, chr(10)) END AS s FROM documents),
       r AS (SELECT doc_id, len(s) AS n, len(list_filter(s, lambda x: trim(x) <> '')) AS f FROM d)
       SELECT count(*) AS n_docs, count(*) FILTER (f > 0) AS with_sections, count(*) FILTER (n > 0 AND f = 0) AS only_empty,
         count(*) FILTER (n = 0) AS without_sections, sum(f)::BIGINT AS n_filled_sections,
         (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM r WHERE f > 0 ORDER BY doc_id LIMIT 5)) AS examples FROM r""",
)
def web_json_audit(spark, sf):
    none = F.array().cast("array<string>")
    sections = (
        F.when(F.col("lang") == "de", none)
        .when(F.col("lang") == "es", F.array(F.lit(""), F.lit(" ")))
        .otherwise(F.split("text", "\n"))
    )
    return stats.section_audit(table(spark, sf, "documents"), "doc_id", sections)

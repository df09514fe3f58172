"""The crawl plan over a site graph made of the key tables, with the same search as unrolled SQL."""

from pyspark.sql import functions as F

from docflow.operators import graph
from docflow.plans.crawl import crawl
from docflow.registry.base import query, s_part, table

# A nation is a site: its home page, customers and orders; a supplier's page lies at the nation of the supplier, so
# links from orders often leave the site. Some listed start pages don't exist.
HOST = "https://n{}.example"
DEPTHS = 4

SITES_SQL = """SELECT 'https://n' || n_nationkey || '.example' AS site, 3 + 23 * (n_nationkey % 6) AS max_pages, (n_nationkey + 3) % 4 AS max_depth,
    CASE n_regionkey WHEN 0 THEN NULL WHEN 1 THEN '^/[co]/' WHEN 2 THEN '^/(c|s)/' ELSE '^/' END AS allow,
    CASE n_regionkey WHEN 1 THEN 'st=F' WHEN 3 THEN 'st=[OP]' END AS deny FROM nation"""

GRAPH_SQL = """
  c AS (SELECT c_custkey, c_mktsegment, 'https://n' || c_nationkey || '.example' AS home, 'https://n' || c_nationkey || '.example/c/' || c_custkey AS url FROM customer),
  s AS (SELECT s_suppkey, 'https://n' || s_nationkey || '.example/s/' || s_suppkey AS url FROM supplier),
  o AS (SELECT o_orderkey, o_orderpriority, c.url AS owner, c.home || '/o/' || o_orderkey || '?st=' || o_orderstatus AS url FROM orders JOIN c ON o_custkey = c_custkey),
  stored AS (SELECT 'https://n' || n_nationkey || '.example/' AS url, n_regionkey <> 4 AS useful FROM nation
    UNION ALL SELECT url, c_mktsegment <> 'MACHINERY' FROM c UNION ALL SELECT url, TRUE FROM s UNION ALL SELECT url, o_orderpriority <> '5-LOW' FROM o),
  links AS (SELECT home || '/' AS src, c_custkey AS pos, url AS dst FROM c UNION ALL SELECT url, 0, home || '/' FROM c
    UNION ALL SELECT owner, o_orderkey, url FROM o UNION ALL SELECT url, 0, owner FROM o
    UNION ALL SELECT DISTINCT o.url, l_suppkey, s.url FROM lineitem JOIN o ON l_orderkey = o_orderkey JOIN s ON l_suppkey = s_suppkey)"""


def _crawl_sql() -> str:
    """All levels, one after the other; a page is visited while pages before it leave some of the budget."""
    steps = [
        f"sites AS ({SITES_SQL})", GRAPH_SQL,
        """f0 AS (SELECT site, url, min(place) AS place, NULL AS src FROM (SELECT site, unnest([site || '/', site || '/c/1', site || '/c/7']) AS url, unnest([[0::BIGINT], [1], [2]]) AS place FROM sites) GROUP BY site, url)""",
        "met0 AS (SELECT site, url FROM f0)", "b0 AS (SELECT site, max_pages AS budget FROM sites)",
    ]
    for d in range(DEPTHS):
        steps += [
            f"""l{d} AS (SELECT f.site, f.url, place, max_depth, allow, deny, budget, useful IS NOT NULL AS stored,
                  coalesce(useful, FALSE) AND coalesce(regexp_matches({s_part('f.url', 3)}, allow), TRUE) AS saved
                FROM f{d} f JOIN sites USING (site) JOIN b{d} USING (site) LEFT JOIN stored ON f.url = stored.url WHERE max_depth >= {d} AND budget > 0)""",
            f"""v{d} AS (SELECT * FROM (SELECT *, coalesce(sum(saved::INT) OVER (PARTITION BY site ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l{d}) WHERE before < budget)""",
            f"b{d + 1} AS (SELECT site, budget - coalesce((SELECT sum(saved::INT) FROM v{d} WHERE v{d}.site = b{d}.site), 0) AS budget FROM b{d})",
            f"""k{d} AS (SELECT site, src, dst, place, new AND den AS deny_q, new AND NOT den AND NOT ok AS deny_path, new AND NOT den AND ok AS passes FROM (
                SELECT v.site, src, dst, list_append(place, pos) AS place, starts_with(dst, v.site || '/') AND (v.site, dst) NOT IN (SELECT (site, url) FROM f0) AS new,
                  coalesce(regexp_matches({s_part('dst', 4)}, deny), FALSE) AS den, coalesce(regexp_matches({s_part('dst', 3)}, allow), TRUE) AS ok
                FROM v{d} v JOIN links ON src = url WHERE stored AND max_depth > {d}))""",
            f"""f{d + 1} AS (SELECT site, dst AS url, min(place) AS place, arg_min(src, place) AS src FROM k{d} WHERE passes AND (site, dst) NOT IN (SELECT (site, url) FROM met{d}) GROUP BY site, dst)""",
            f"met{d + 1} AS (SELECT * FROM met{d} UNION ALL SELECT site, url FROM f{d + 1})",
            f"""n{d} AS (SELECT k.site, src AS url, count(*) AS total, count(*) FILTER (deny_q) AS deny_q, count(*) FILTER (deny_path) AS deny_path,
                  (SELECT count(*) FROM f{d + 1} f WHERE f.site = k.site AND f.src = k.src) AS enqueued FROM k{d} k GROUP BY k.site, k.src)""",
        ]
    return "WITH " + ",\n".join(steps)


CRAWL_SQL = _crawl_sql()
VISITS_SQL = " UNION ALL ".join(f"SELECT site, url, {d} AS depth, array_to_string(place, '.') AS place, stored, saved FROM v{d}" for d in range(DEPTHS))
COUNTERS_SQL = " UNION ALL ".join(
    f"SELECT site, url, total, deny_q + deny_path + enqueued AS same_host, deny_q, deny_path, enqueued FROM n{d}" for d in range(DEPTHS)
)


def _host(key: str):
    return F.concat(F.lit("https://n"), F.col(key).cast("string"), F.lit(".example"))


def _seeds(spark, sf):
    home, region = _host("n_nationkey"), F.col("n_regionkey")
    allow = F.when(region == 1, "^/[co]/").when(region == 2, "^/(c|s)/").when(region > 2, "^/")
    return graph.seed_urls(
        table(spark, sf, "nation").select(
            home.alias("name"), home.alias("base_url"), (3 + 23 * (F.col("n_nationkey") % 6)).cast("int").alias("max_pages"),
            ((F.col("n_nationkey") + 3) % 4).cast("int").alias("max_depth"), allow.alias("allow_path_regex"),
            F.when(region == 1, "st=F").when(region == 3, "st=[OP]").alias("deny_query_regex"),
            F.array(*(F.concat(home, F.lit(p)) for p in ("/", "/c/1", "/c/7"))).alias("start_pages"),
        )
    )


def _graph(spark, sf):
    """``pages(url, useful)`` and ``links(src, pos, dst)``."""

    def page(home, kind: str, key: str):
        return F.concat(home, F.lit(f"/{kind}/"), F.col(key).cast("string"))

    home = F.concat(_host("n_nationkey"), F.lit("/"))
    nations = table(spark, sf, "nation").select(home.alias("url"), (F.col("n_regionkey") != 4).alias("useful"))
    owner = _host("c_nationkey")
    customers = table(spark, sf, "customer").select("c_custkey", owner.alias("home"), page(owner, "c", "c_custkey").alias("owner"), "c_mktsegment")
    suppliers = table(spark, sf, "supplier").select("s_suppkey", page(_host("s_nationkey"), "s", "s_suppkey").alias("dst"))
    order_url = F.concat(page(F.col("home"), "o", "o_orderkey"), F.lit("?st="), F.col("o_orderstatus"))
    orders = table(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.select("o_orderkey", "o_orderpriority", "owner", order_url.alias("url"))
    stored = (
        nations.unionByName(customers.select(F.col("owner").alias("url"), (F.col("c_mktsegment") != "MACHINERY").alias("useful")))
        .unionByName(suppliers.select(F.col("dst").alias("url"), F.lit(True).alias("useful")))
        .unionByName(orders.select("url", (F.col("o_orderpriority") != "5-LOW").alias("useful")))
    )

    def edge(rows, src, pos, dst):
        return rows.select(src.alias("src"), pos.cast("bigint").alias("pos"), dst.alias("dst"))

    slash = F.concat("home", F.lit("/"))
    supplied = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    supplied = supplied.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    links = (
        edge(customers, slash, F.col("c_custkey"), F.col("owner"))
        .unionByName(edge(customers, F.col("owner"), F.lit(0), slash))
        .unionByName(edge(orders, F.col("owner"), F.col("o_orderkey"), F.col("url")))
        .unionByName(edge(orders, F.col("url"), F.lit(0), F.col("owner")))
        .unionByName(edge(supplied, F.col("url"), F.col("l_suppkey"), F.col("dst")))
    )
    return stored, links


@query("crawl_plan", f"{CRAWL_SQL}\n{VISITS_SQL}")
def crawl_plan(spark, sf):
    """The pages that every site's crawl visits, in the order of its queue."""
    visits = crawl(_seeds(spark, sf), *_graph(spark, sf)).visits
    return visits.select("site", "url", "depth", F.array_join(F.col("place").cast("array<string>"), ".").alias("place"), "stored", "saved")


@query("crawl_plan_counters", f"{CRAWL_SQL}\n{COUNTERS_SQL}")
def crawl_plan_counters(spark, sf):
    return crawl(_seeds(spark, sf), *_graph(spark, sf)).counters.drop("key")


@query(
    "crawl_plan_sites",
    f"""{CRAWL_SQL}, v AS ({VISITS_SQL})
    SELECT site, count(*) FILTER (saved) AS written, count(url) AS seen FROM sites LEFT JOIN v USING (site) GROUP BY site""",
)
def crawl_plan_sites(spark, sf):
    return crawl(_seeds(spark, sf), *_graph(spark, sf)).sites.drop("key")

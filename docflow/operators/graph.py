"""Crawl rules as joins over a stored link graph. Fetching pages is not part of this library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions import urls as ux
from docflow.runtime import cut_lineage

DEFAULT_MAX_PAGES = 200
DEFAULT_MAX_DEPTH = 1


def seed_urls(sites: DataFrame) -> DataFrame:
    """One row per start page, numbered from 0 in ``seed_no``. Accepts ``base_url|domain`` and ``start_pages|start_urls``.

    Sites without a base URL or start pages are dropped; missing limits get the defaults.
    """

    def optional(name: str, kind: str) -> Column:
        return F.col(name) if name in sites.columns else F.lit(None).cast(kind)

    base = F.coalesce(F.nullif(optional("base_url", "string"), F.lit("")), optional("domain", "string"))
    pages = F.coalesce(optional("start_pages", "array<string>"), optional("start_urls", "array<string>"))
    return (
        sites.select(
            F.coalesce(optional("name", "string"), F.lit("unknown")).alias("site"),
            base.alias("base_url"),
            F.coalesce(optional("max_pages", "int"), F.lit(DEFAULT_MAX_PAGES)).alias("max_pages"),
            F.coalesce(optional("max_depth", "int"), F.lit(DEFAULT_MAX_DEPTH)).alias("max_depth"),
            optional("allow_path_regex", "string").alias("allow_path_regex"),
            optional("deny_query_regex", "string").alias("deny_query_regex"),
            F.posexplode(pages).alias("seed_no", "seed_url"),
        )
        .where(F.coalesce(F.col("base_url"), F.lit("")) != "")
    )


def bounded_frontier(edges: DataFrame, seeds: DataFrame, max_depth: int = 2) -> DataFrame:
    """``node, depth``: everything reachable from ``seeds(node)`` over ``edges(src, dst)``.

    Level by level: join the new nodes to the edges, keep unseen targets, repeat. Targets are
    de-duplicated with map-side combine, the frontier side of each join has unique keys, so adaptive
    execution can split an edge-heavy source. Each level is checkpointed; the driver only sees
    whether it is empty.
    """
    visited = cut_lineage(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = visited
    for depth in range(1, max_depth + 1):
        reached = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node"))
        fresh = reached.distinct().join(visited, "node", "left_anti").withColumn("depth", F.lit(depth))
        frontier = cut_lineage(fresh)
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def may_traverse(url: Column, base_netloc: Column, allow: Column, deny: Column, depth: Column, seed: Column,
                 max_depth: Column, strict_compat: bool = False) -> Column:
    """Follow a link? Depth cap, same host, query deny-list (seeds exempt), path allow-list below seeds.

    ``strict_compat=True`` follows nothing on sites that have no allow-list.
    """
    denied = F.coalesce(F.rlike(ux.query(url), deny), F.lit(False))
    allowed = F.coalesce(F.rlike(ux.path(url), allow), F.lit(not strict_compat))
    host = ux.netloc(url)
    same = (host == "") | (host == base_netloc)
    return (depth <= max_depth) & same & (seed | ~denied) & ((depth == 0) | allowed)


def may_save(url: Column, allow: Column) -> Column:
    return F.coalesce(F.rlike(ux.path(url), allow), F.lit(True))


def site_page_cap(pages: DataFrame, site: str, order: list, max_pages: int = DEFAULT_MAX_PAGES) -> DataFrame:
    """First ``max_pages`` pages per site. Each task keeps its own top rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(site).orderBy(*order))
    return pages.withColumn("page_rank", rank).where(F.col("page_rank") <= max_pages)


def crawl_counters(links: DataFrame, by: list[str]) -> DataFrame:
    """Outlink counters per page or per site.

    Needs ``known, same_host, denied_query, allowed_path`` flags per link. Already known targets
    count only in ``total``; each later counter sees what the earlier rules let through.
    """
    new_here = ~F.col("known") & F.col("same_host")
    passed = new_here & ~F.col("denied_query")
    return links.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(new_here).alias("same_host"),
        F.count_if(new_here & F.col("denied_query")).alias("deny_q"),
        F.count_if(passed & ~F.col("allowed_path")).alias("deny_path"),
        F.count_if(passed & F.col("allowed_path")).alias("enqueued"),
    )

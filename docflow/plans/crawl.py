"""A whole crawl over stored pages: which pages each site's crawl visits and saves, and what its links came to.

The search goes level by level for all sites at once. A link enters the next level only after its site's rules;
inside a level pages keep the order of a queue, written as the list of link positions that leads to them, so the
order needs no ranks and no gathered site. A site's page budget is spent in that order: its last affordable page is
found by a two-step selection over bounded groups, and everything behind it is not visited.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions import urls as ux
from docflow.operators import graph
from docflow.runtime import materialize

_RULES = ("site", "base_url", "max_pages", "max_depth", "allow_path_regex", "deny_query_regex")
#: Parts in which the savable pages of one site are ranked before the best of all parts are.
PARTS = 64


@dataclass(frozen=True)
class Crawl:
    """Results by ``site``; rows of sites that share name and base URL but differ in a rule are separate crawls."""

    visits: DataFrame  # key, site, url, depth, place array<bigint>, stored, saved
    counters: DataFrame  # key, site, url, total, same_host, deny_q, deny_path, enqueued
    sites: DataFrame  # key, site, written, seen


def _last_affordable(savable: DataFrame, most: int) -> DataFrame:
    """``key, last``: the place of the savable page that uses up the budget ``left``; none where it lasts.

    Each of a site's parts gives its first ``most`` pages, so one large site is ranked by many tasks and what
    meets in one is bounded by its budget.
    """
    part = F.pmod(F.xxhash64("url"), F.lit(PARTS))
    rows = savable.select("key", "left", "place", part.alias("part"))
    firsts = rows.withColumn("r", F.row_number().over(Window.partitionBy("key", "part").orderBy("place")))
    firsts = firsts.where((F.col("r") <= most) & (F.col("r") <= F.col("left")))
    ranked = firsts.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("place")))
    return ranked.where((F.col("r") <= most) & (F.col("r") == F.col("left"))).select("key", F.col("place").alias("last"))


def _flagged(links: DataFrame, sources: DataFrame, rules: DataFrame, seeds: DataFrame, strict_compat: bool) -> DataFrame:
    """The links of visited pages with what each rule says; start pages are known from the beginning."""
    known = seeds.select("key", F.col("url").alias("dst"), F.lit(True).alias("seed"))
    rows = links.join(sources, "src").join(rules, "key").join(known, ["key", "dst"], "left")
    netloc = ux.netloc("dst")
    same = (netloc == "") | (ux.url_domain("dst") == F.regexp_replace(F.lower("netloc"), r"^www\.", ""))
    denied = F.coalesce(F.rlike(ux.query("dst"), F.col("deny_query_regex")), F.lit(False))
    allowed = F.coalesce(F.rlike(ux.path("dst"), F.col("allow_path_regex")), F.lit(not strict_compat))
    new = F.col("seed").isNull() & same
    return rows.select(
        "key", "src", "dst", F.concat("place", F.array(F.col("pos").cast("bigint"))).alias("place"),
        (new & denied).alias("deny_q"), (new & ~denied & ~allowed).alias("deny_path"), (new & ~denied & allowed).alias("passes"),
    )


def _page_counts(flagged: DataFrame, fresh: DataFrame) -> DataFrame:
    """Counters per visited page that has links. A target met at several pages of a level counts at the first one."""
    counts = flagged.groupBy("key", "src").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("deny_q").alias("deny_q"), F.count_if("deny_path").alias("deny_path")
    )
    taken = fresh.groupBy("key", "src").agg(F.count(F.lit(1)).alias("enqueued"))
    enqueued = F.coalesce("enqueued", F.lit(0))
    return counts.join(taken, ["key", "src"], "left").select(
        "key", F.col("src").alias("url"), "total", (F.col("deny_q") + F.col("deny_path") + enqueued).alias("same_host"),
        "deny_q", "deny_path", enqueued.alias("enqueued"),
    )


def crawl(seeds: DataFrame, pages: DataFrame, links: DataFrame, strict_compat: bool = False) -> Crawl:
    """Crawl ``links(src, pos, dst)`` from the start pages of ``graph.seed_urls``.

    ``pages(url, useful)`` are the pages that can be read, and whether they have content to save; others are
    visited without result. Start pages are visited whatever the rules say. A page is saved if it is useful and its
    path allowed; a site stops after ``max_pages`` saved pages. ``strict_compat`` follows no link on sites without
    an allow-list.
    """
    named = seeds.withColumn("key", F.sha2(F.to_json(F.struct(*_RULES)), 256))
    rules = named.select("key", *_RULES).dropDuplicates(["key"]).withColumn("netloc", ux.netloc("base_url"))
    rules = materialize(rules, "crawl-rules")
    most = rules.agg(F.max("max_pages"), F.max("max_depth")).first()
    readable = pages.groupBy("url").agg(F.bool_or("useful").alias("useful"))
    place = F.min(F.array(F.col("seed_no").cast("bigint"))).alias("place")
    starts = materialize(named.groupBy("key", F.col("seed_url").alias("url")).agg(place), "crawl-starts")
    frontier, met = starts, starts.select("key", "url")
    budget = rules.select("key", F.col("max_pages").alias("left"))
    visits, counters = [], []
    for depth in range((most[1] if most[1] is not None else -1) + 1):
        level = frontier.join(rules, "key").join(budget.where("left > 0"), "key").where(F.col("max_depth") >= depth)
        level = level.join(readable, "url", "left")
        savable = F.coalesce("useful", F.lit(False)) & graph.may_save(F.col("url"), F.col("allow_path_regex"))
        level = level.select("key", "site", "url", F.lit(depth).alias("depth"), "place", "left", "max_depth",
                             F.col("useful").isNotNull().alias("stored"), savable.alias("saved"))
        level = materialize(level, "crawl-level")
        last = _last_affordable(level.where("saved"), most[0])
        visited = level.join(last, "key", "left").where(F.col("last").isNull() | (F.col("place") <= F.col("last"))).drop("last")
        visited = materialize(visited, "crawl-visited")
        visits.append(visited.drop("left", "max_depth"))
        spent = visited.groupBy("key").agg(F.count_if("saved").alias("spent"))
        budget = budget.join(spent, "key", "left").select("key", (F.col("left") - F.coalesce("spent", F.lit(0))).alias("left"))
        budget = materialize(budget, "crawl-budget")
        sources = visited.where(F.col("stored") & (F.col("max_depth") > depth)).select("key", F.col("url").alias("src"), "place")
        flagged = materialize(_flagged(links, sources, rules, starts, strict_compat), "crawl-links")
        passing = flagged.where("passes").groupBy("key", "dst").agg(F.min(F.struct("place", "src")).alias("first"))
        fresh = passing.join(met, (passing["key"] == met["key"]) & (passing["dst"] == met["url"]), "left_anti")
        fresh = fresh.select("key", F.col("dst").alias("url"), F.col("first.place").alias("place"), F.col("first.src").alias("src"))
        fresh = materialize(fresh, "crawl-fresh")
        counters.append(_page_counts(flagged, fresh))
        frontier = fresh.drop("src")
        if frontier.isEmpty():
            break
        met = met.unionByName(frontier.select("key", "url"))
    return _results(rules, visits, counters)


def _results(rules: DataFrame, visits: list[DataFrame], counters: list[DataFrame]) -> Crawl:
    spark = rules.sparkSession
    seen = spark.createDataFrame([], "key string, site string, url string, depth int, place array<bigint>, stored boolean, saved boolean")
    counted = spark.createDataFrame([], "key string, url string, total bigint, same_host bigint, deny_q bigint, deny_path bigint, enqueued bigint")
    for part in visits:
        seen = seen.unionByName(part)
    for part in counters:
        counted = counted.unionByName(part)
    by_site = seen.groupBy("key").agg(F.count_if("saved").alias("written"), F.count(F.lit(1)).alias("seen"))
    sites = rules.select("key", "site").join(by_site, "key", "left")
    return Crawl(
        seen, counted.join(rules.select("key", "site"), "key"),
        sites.select("key", "site", F.coalesce("written", F.lit(0)).alias("written"), F.coalesce("seen", F.lit(0)).alias("seen")),
    )

"""Connected components of a link table by alternating stars, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.runtime import forget, materialize


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable) for every id that a link ``a, b`` names.

    Large stars hang every larger neighbour on the smallest one, small stars every smaller one; the rounds
    end when the links no longer change, after about the logarithm of the longest path. A hub with many
    neighbours is one key of a join that Spark may split, and its minimum is aggregated before the shuffle.
    """
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialize(edges, "links")
    state = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = materialize(large, "large-star")
        forget(edges)
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        small = small.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(low.select(F.col("m").alias("a"), "b"))
        edges = materialize(small.where("a <> b").distinct(), "small-star")
        forget(large)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    stars = edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return stars.unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())

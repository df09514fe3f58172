"""Exact nearest chunks for query tables of any size, over inverted lists.

Every chunk belongs to the list of its nearest centroid, and a list knows how far its chunks lie from it. A query
first reads the nearest lists that hold enough chunks; its k-th distance there bounds what a better chunk can have,
and by the triangle inequality only lists that reach into that bound are read in a second step. Centroids decide how
many lists that are, never the result. Chunks are dealt to their lists once; what moves after that are queries, to the
lists they need. Lists are cut into parts and their queries into slices, so no group grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docflow.operators.retrieval import _stack, _TopK
from docflow.runtime import materialize

#: Centroids at most, the vectors they are fitted on, and rounds of fitting. They affect time alone.
LISTS, SAMPLE, ROUNDS = 256, 20_000, 6
#: Chunks of a part and queries of a slice.
PART, SLICE = 4096, 4096
#: Relative rounding that bounds allow for.
_SLACK = 1e-6


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    squares = (x**2).sum(1)[:, None] + (centroids**2).sum(1)[None, :] - 2 * x @ centroids.T
    return np.sqrt(np.maximum(squares, 0))


def fit_centroids(corpus: DataFrame, lists: int = LISTS) -> np.ndarray:
    """Centroids of at most ``SAMPLE`` vectors, taken by the hash of their id."""
    sample = corpus.where(F.col("vector").isNotNull()).orderBy(F.xxhash64("chunk_id")).limit(SAMPLE).select("vector").toPandas()
    if sample.empty:
        return np.zeros((0, 1))
    x = _stack(sample["vector"])
    centroids = x[: max(1, min(lists, len(x) // 16))].copy()
    for _ in range(ROUNDS):
        near = _distances(x, centroids).argmin(1)
        counts = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


@dataclass(frozen=True)
class ListIndex:
    centroids: np.ndarray
    rows: DataFrame  # source_type, list, chunk_id, vector
    lists: pd.DataFrame  # source_type, list, n, near, far: one row for each list of a collection


def build_index(corpus: DataFrame, lists: int = LISTS) -> ListIndex:
    """Deal ``corpus(chunk_id, source_type, vector)`` to the lists of its centroids; one pass, no shuffle."""
    centroids = fit_centroids(corpus, lists)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = _distances(_stack(b["vector"]), centroids)
                yield b.assign(list=d.argmin(1).astype("int32"), radius=d.min(1))

    source = corpus.where(F.col("vector").isNotNull()).select("source_type", "chunk_id", F.col("vector").cast("array<double>").alias("vector"))
    schema = f"source_type string, chunk_id {dict(corpus.dtypes)['chunk_id']}, vector array<double>, list int, radius double"
    rows = materialize(source.mapInPandas(nearest, schema), "list-index")
    stats = rows.groupBy("source_type", "list").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("near"), F.max("radius").alias("far"))
    return ListIndex(centroids, rows.drop("radius"), stats.toPandas())  # at most lists x collections rows


def _reached(held: pd.DataFrame, ks: dict[str, int], d: np.ndarray, bounds: dict[str, float] | None) -> list[tuple[str, int]]:
    """Lists that one query reads: without bounds the nearest that hold k chunks, with them all others in reach."""
    out = []
    for kind, lists in held.groupby("source_type"):
        k = ks.get(kind, 0)
        if k <= 0:
            continue
        lists = lists.iloc[np.argsort(d[lists["list"].to_numpy()], kind="stable")]
        at = d[lists["list"].to_numpy()]
        first = int(np.searchsorted(np.cumsum(lists["n"].to_numpy()), k)) + 1
        if bounds is None:
            chosen = lists["list"].to_numpy()[:first]
        elif kind in bounds:
            least = np.maximum(at - lists["far"].to_numpy(), lists["near"].to_numpy() - at)
            within = least <= np.sqrt(bounds[kind]) + _SLACK * (1 + at + lists["far"].to_numpy())
            within[:first] = False
            chosen = lists["list"].to_numpy()[within]
        else:
            continue
        out += [(kind, int(x)) for x in chosen]
    return out


def _probes(index: ListIndex, queries: DataFrame, ks: dict[str, int], id_type: str) -> DataFrame:
    """``query_id, vector, places``; queries with a column ``bounds`` name the lists of the second step."""
    second, centroids, held = "bounds" in queries.columns, index.centroids, index.lists

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            d = _distances(_stack(b["vector"]), centroids)
            bounds = [dict(x) for x in b["bounds"]] if second else [None] * len(b)
            places = [[{"source_type": s, "list": x} for s, x in _reached(held, ks, *pair)] for pair in zip(d, bounds, strict=True)]
            yield pd.DataFrame({"query_id": b["query_id"], "vector": b["vector"], "places": places})

    schema = f"query_id {id_type}, vector array<double>, places array<struct<source_type:string,list:int>>"
    return materialize(queries.mapInPandas(run, schema), "probes")


def _scan(index: ListIndex, probes: DataFrame, ks: dict[str, int], schema: str) -> DataFrame:
    """Best rows of every query in each part of the lists that it reads."""
    asked = probes.select("query_id", "vector", F.explode("places").alias("p")).select("query_id", "vector", "p.*")
    load = asked.groupBy("source_type", "list").agg(F.count(F.lit(1)).alias("asking")).toPandas()
    plan = load.merge(index.lists[["source_type", "list", "n"]], on=["source_type", "list"])
    spark = probes.sparkSession
    if plan.empty:
        return spark.createDataFrame([], schema)
    plan["parts"], plan["slices"] = -(-plan["n"] // PART), -(-plan["asking"] // SLICE)
    few = F.broadcast(spark.createDataFrame(plan[["source_type", "list", "parts", "slices"]]))  # lists x collections rows

    def spread(rows: DataFrame, key: str, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        rows = rows.join(few, ["source_type", "list"]).withColumn(own, F.pmod(F.xxhash64(key), F.col(n_own)))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n_other) - 1))).drop("parts", "slices")

    left = spread(asked, "query_id", "slice", "slices", "part", "parts")
    right = spread(index.rows, "chunk_id", "part", "parts", "slice", "slices")

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        top = _TopK(ks, "l2")
        if len(q) and len(c):
            ids, groups = c["chunk_id"].to_numpy(), c["source_type"].to_numpy(dtype=str)
            top.add(q["query_id"].tolist(), _stack(q["vector"]), ids, groups, _stack(c["vector"]))
        return top.frame()

    cell = ("source_type", "list", "part", "slice")
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(run, schema)


def _first(rows: DataFrame, ks: dict[str, int]) -> DataFrame:
    best = Window.partitionBy("query_id", "source_type").orderBy("distance", "chunk_id")
    limit = F.create_map(*[x for g, k in ks.items() for x in (F.lit(g), F.lit(k))])
    ranked = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(ks.values()))
    return ranked.where(F.col("rank") <= limit[F.col("source_type")])


def search_lists(index: ListIndex, queries: DataFrame, ks: dict[str, int]) -> DataFrame:
    """``query_id, source_type, rank, chunk_id, distance, similarity`` of ``queries(query_id, vector)``, exact.

    Distances are squared, as in ``retrieval.search`` with its default metric.
    """
    ids = dict(queries.dtypes)["query_id"]
    schema = f"query_id {ids}, source_type string, chunk_id {dict(index.rows.dtypes)['chunk_id']}, distance double, similarity double"
    result = ("query_id", "source_type", "rank", "chunk_id", "distance", "similarity")
    if index.lists.empty:
        return _first(queries.sparkSession.createDataFrame([], schema), ks).select(*result)
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where(F.col("vector").isNotNull())
    nearest = materialize(_first(_scan(index, _probes(index, asked, ks, ids), ks, schema), ks), "nearest-lists")
    kth = nearest.groupBy("query_id", "source_type").agg(F.max("distance").alias("bound"))
    kth = kth.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("source_type", "bound"))).alias("bounds"))
    further = _scan(index, _probes(index, asked.join(kth, "query_id"), ks, ids), ks, schema)
    found = _first(nearest.drop("rank").unionByName(further), ks)
    return found.select(*result)

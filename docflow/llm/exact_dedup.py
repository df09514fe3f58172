"""Exact dedup over a persistent digest index.

The index is a table bucketed and sorted by digest. New documents are reduced to one row per digest,
rows whose digest the index holds are found by a sort-merge join that leaves the index where it lies
(only the new side is shuffled), and what is new is appended as one more sorted file per bucket.

Defined results
    null text       counts as the empty text
    null doc_id     sorts below every id, so it stays only if all ids of its group are null
    repeated rows   the same id and text twice are two members of a group; one of them stays
    empty table     no rows, and the index is unchanged
    other columns   are not read
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.runtime import materialize, scratch_path

#: A digest that holds at least this share of all rows is joined apart; there are at most 1/share of them.
HOT_SHARE = 1 / 1000


def normalised(text="text"):
    """Lower case over A-Z alone; null is empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest``: SHA-256 of each normalised text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(text_col), 256).alias("digest"))


class DigestIndex:
    """Digests seen so far: ``digest, keep_id, group_size``, bucketed and sorted by digest.

    ``path`` must be shared by all executors; an index that lies there already is opened, whatever
    session wrote it. ``keep_id`` is the largest id of the batch that brought the digest.
    """

    SCHEMA = "digest string, keep_id bigint, group_size bigint"

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = "digest_index_" + "".join(c if c.isalnum() else "_" for c in path)[-80:].lower()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({self.SCHEMA}) USING parquet OPTIONS (path '{path}') "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, hashed: DataFrame) -> None:
        """Append the digests of ``doc_id, digest, copies`` rows that the index doesn't hold yet."""
        batch = hashed.groupBy("digest").agg(
            F.max("doc_id").cast("bigint").alias("keep_id"), F.sum("copies").cast("bigint").alias("group_size")
        )
        fresh = batch.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        writer = fresh.repartition(self.buckets, "digest").select("digest", "keep_id", "group_size").write
        writer = writer.format("parquet").mode("append").option("path", self.path)
        writer.bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)

    def seen(self, hashed: DataFrame) -> DataFrame:
        """The given rows with ``keep_id, group_size`` of their digest; all digests must be indexed.

        Digests with a large share of the rows have a bounded number and are broadcast, so that no
        task gathers one group; the others meet the index in its buckets.
        """
        index = self.rows()
        total = index.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
        hot = materialize(index.where(F.col("group_size") >= F.lit(max(2, total * HOT_SHARE))), "hot-digests")
        among_hot = hashed.join(F.broadcast(hot), "digest")
        others = hashed.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
        return among_hot.unionByName(others.join(index.hint("merge"), "digest"))


def _indexed(docs: DataFrame, buckets: int, index_path: str | None) -> DataFrame:
    """``doc_id, digest, copies, keep_id, group_size, known`` with equal ids and texts as one row."""
    spark = docs.sparkSession
    hashed = digests(docs).groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    hashed = materialize(hashed, "digests")
    index = DigestIndex(spark, index_path or scratch_path(spark, "digest-index"), buckets)
    known = None
    if index_path:
        held = index.rows().select("digest", F.lit(True).alias("known"))
        known = materialize(held.join(hashed.select("digest"), "digest", "left_semi"), "known-digests")
    index.add(hashed)
    out = index.seen(hashed)
    return out.withColumn("known", F.lit(False)) if known is None else (
        out.join(known, "digest", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    )


def exact_groups(docs: DataFrame, buckets: int = 64, index_path: str | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest`` for every row of ``docs``.

    ``group_size`` counts the rows of equal text, ``keep_id`` is the largest id among them, and exactly
    one row of each group is kept. Without ``index_path`` the index starts empty in the scratch folder;
    with it, texts of earlier batches have the id and size that the index holds, and none of them is kept.
    """
    rows = _indexed(docs, buckets, index_path)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1) & ~F.col("known")
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def drop_copies(docs: DataFrame, buckets: int = 64, index_path: str | None = None) -> DataFrame:
    """The documents themselves, one row of each group of equal texts, with all their columns."""
    winner = F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("known")
    winners = _indexed(docs, buckets, index_path).where(winner)
    winners = materialize(winners.select(F.col("digest").alias("winner"), F.col("doc_id").alias("keep_id"), "copies"), "kept-digests")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # apart from the columns used here
    hashed = docs.select(row, F.col("doc_id").alias("id"), F.sha2(normalised(), 256).alias("digest"))

    def rows_of(some: DataFrame) -> DataFrame:
        same = (F.col("digest") == F.col("winner")) & F.col("id").eqNullSafe(F.col("keep_id"))
        return hashed.join(some, same, "left_semi")

    once, often = rows_of(winners.where("copies = 1")), rows_of(winners.where("copies > 1"))
    return once.unionByName(often.dropDuplicates(["digest"])).select("row.*")

"""Corpus refresh: stored pages and guideline texts to the chunk table, only for what changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions import urls as ux
from docflow.operators import changes, docs, pages
from docflow.runtime import materialize
from docflow.sources import sinks
from docflow.sources.buckets import BucketTable


def web_chunks(stored_pages: DataFrame, keep: tuple[Column, ...] = ()) -> DataFrame:
    """Chunks of a ``page_id, url, html`` table; one Arrow parse, no shuffle."""
    parsed = pages.parse_pages(stored_pages)
    blocks = pages.page_blocks(parsed.withColumn("page_title", pages.page_title()))
    return pages.chunks_web(blocks, F.col("page_title"), F.col("url"), ux.page_file_name("url"), keep)


def docx_chunks(texts: DataFrame, keep: tuple[Column, ...] = ()) -> DataFrame:
    """Chunks of ``file, text`` guideline documents."""
    return docs.chunks_docx(docs.split_fiches(texts, "text", "file"), keep)


def source_snapshot(stored_pages: DataFrame, texts: DataFrame) -> DataFrame:
    """``kind, name, sha256`` of every source."""
    web = stored_pages.select(F.lit("web").alias("kind"), F.col("url").alias("name"), changes.content_hash("html").alias("sha256"))
    docx = texts.select(F.lit("docx").alias("kind"), F.col("file").alias("name"), changes.content_hash("text").alias("sha256"))
    return web.unionByName(docx)


def refresh(stored_pages: DataFrame, texts: DataFrame, previous: DataFrame, chunk_path: str) -> DataFrame:
    """Rewrite the collections whose sources changed; returns the decision per kind.

    Unchanged collections are neither parsed nor written.
    """
    diff = changes.snapshot_diff(previous, source_snapshot(stored_pages, texts))
    decision = changes.reindex_decision(diff)
    stale = {r["kind"] for r in decision.where("reindex").select("kind").collect()}
    made = [build(rows) for kind, build, rows in (("docx", docx_chunks, texts), ("web", web_chunks, stored_pages)) if kind in stale]
    for chunks in made:
        sinks.write_chunks(chunks, chunk_path)
    return decision


_CHUNK = (
    "chunk_id string, source_type string, text string, title string, doc_type string, source string, section_index int, "
    "fiche_id string, url string, domain string, source_path string, origin string"
)
_SOURCE = "kind string, name string, sha256 string, n_chunks bigint"


class ChunkStore:
    """The chunk table in buckets of its sources, the state of every source beside it, and a journal of changes.

    ``origin`` of a chunk is the name of its source: the page's URL or the file. Source and chunks lie in buckets of
    one number, so the counts of a bucket tell whether it is whole.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.chunks = BucketTable(spark, f"{path}/chunks", _CHUNK, "origin", buckets, ("source_type",))
        self.sources = BucketTable(spark, f"{path}/sources", _SOURCE, "name", buckets, ("kind",))
        top = self.sources.rows().agg(F.max("bucket")).first()[0]
        if top is not None and top >= buckets:
            raise ValueError(f"the store at {path} has more than {buckets} buckets")

    def damaged(self) -> list[tuple[str, int]]:
        """Buckets whose chunks aren't as many as their sources made, as an interrupted commit leaves them."""
        have = self.chunks.rows().groupBy(F.col("source_type").alias("kind"), "bucket").agg(F.count(F.lit(1)).alias("have"))
        want = self.sources.rows().groupBy("kind", "bucket").agg(F.sum("n_chunks").alias("want"))
        both = have.join(want, ["kind", "bucket"], "full")
        differ = both.where(F.coalesce("have", F.lit(0)) != F.coalesce("want", F.lit(0)))
        return sorted((r.kind, r.bucket) for r in differ.select("kind", "bucket").collect())  # at most all buckets


@dataclass(frozen=True)
class Refresh:
    decision: DataFrame  # kind, n_added, n_modified, n_deleted, n_unchanged, n_chunks
    touched: list[tuple[str, int]]  # buckets of the chunk table that were written


def distinct_sources(snapshot: DataFrame) -> DataFrame:
    """One row per source; several rows of one name have a hash of all of them, in whatever order they come."""
    many = F.concat_ws(
        "|", F.count(F.lit(1)), F.min("sha256"), F.max("sha256"), F.sum(F.xxhash64("sha256").cast("decimal(38,0)"))
    )
    hashed = F.when(F.count(F.lit(1)) == 1, F.max("sha256")).otherwise(F.sha2(many, 256))
    return snapshot.groupBy("kind", "name").agg(hashed.alias("sha256"))


def merge_refresh(stored_pages: DataFrame, texts: DataFrame, store: ChunkStore, as_of: Column | str) -> Refresh:
    """Bring the store to what the sources are now, in one merge.

    Chunks of added and modified sources are built, those of modified and deleted ones go, and only buckets with such
    a source are read or written. Buckets that an earlier failure left incomplete are built anew from their sources.
    Chunks are merged first, then the changes are added to the journal, then the sources' state: a refresh that stops
    in between finds the same differences again and repeats the merge (the journal may have them twice).
    """
    damaged = store.damaged()
    now = distinct_sources(source_snapshot(stored_pages, texts)).withColumn("bucket", store.sources.bucket())
    diff = changes.snapshot_diff(store.sources.rows(), now.drop("bucket"))
    broken = F.lit(False)
    for kind, bucket in damaged:
        broken |= (F.col("kind") == kind) & (store.sources.bucket() == bucket)
    again = (F.col("status") == "unchanged") & broken
    diff = materialize(diff.withColumn("status", F.when(again, "modified").otherwise(F.col("status"))), "source-diff")
    changed = diff.where("status <> 'unchanged'")
    build = changed.where("status <> 'deleted'")

    def of_kind(kind: str, column: str) -> DataFrame:
        return build.where(F.col("kind") == kind).select(F.col("name").alias(column))

    web = web_chunks(stored_pages.join(of_kind("web", "url"), "url", "left_semi"), (F.col("url").alias("origin"),))
    docx = docx_chunks(texts.join(of_kind("docx", "file"), "file", "left_semi"), (F.col("file").alias("origin"),))
    made = materialize(web.unionByName(docx, allowMissingColumns=True), "rebuilt-chunks")
    gone = changed.select(F.col("kind").alias("source_type"), F.col("name").alias("origin"))
    touched = store.chunks.merge(gone, made, damaged)
    sinks.append_changes(changed, F.lit(as_of), f"{store.path}/journal")
    counts = made.groupBy(F.col("source_type").alias("kind"), F.col("origin").alias("name")).agg(F.count(F.lit(1)).alias("n_chunks"))
    state = build.join(counts, ["kind", "name"], "left").select(
        "kind", "name", F.col("new_hash").alias("sha256"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks")
    )
    store.sources.merge(changed.select("kind", "name"), state)
    status = F.col("status")
    decision = diff.groupBy("kind").agg(*(F.count_if(status == s).alias(f"n_{s}") for s in ("added", "modified", "deleted", "unchanged")))
    built = made.groupBy(F.col("source_type").alias("kind")).agg(F.count(F.lit(1)).alias("n_chunks"))
    decision = decision.join(built, "kind", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    return Refresh(decision, touched)

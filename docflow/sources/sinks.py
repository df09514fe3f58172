"""Writers. Every write commits as a whole; a failed one leaves the previous data in place."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.operators.ordered import with_last_before
from docflow.runtime import materialize
from docflow.sources.buckets import BucketTable

FILE_NAME = r"^[A-Za-z0-9_\-\.]+\.json$"


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Replace the collections present in ``chunks``; other collections stay."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_type").parquet(path)


def _upsert(rows: DataFrame, path: str, key: str, form: str) -> None:
    """Replace the stored rows whose key ``rows`` holds, keep the others.

    The merged table is complete in the scratch folder before the stored one is replaced.
    """
    spark = rows.sparkSession
    try:
        stored = spark.read.format(form).schema(rows.schema).load(path)
    except AnalysisException as e:  # nothing is stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        rows = materialize(stored.join(rows.select(key), key, "left_anti").select(*rows.columns).unionByName(rows), "upsert")
    rows.write.mode("overwrite").format(form).save(path)


def upsert_chunks(chunks: DataFrame, path: str) -> None:
    """Replace chunks by ``chunk_id``; other chunks stay, of the same collection too."""
    _upsert(chunks, path, "chunk_id", "parquet")


def write_pages(pages: DataFrame, path: str) -> None:
    """Page records as JSON rows, replaced by URL. Pages that differ in the query all stay."""
    _upsert(pages, path, "url", "json")


def key_collisions(pages: DataFrame, key: str = "page_key") -> DataFrame:
    """File-name keys shared by several pages, where a file per key would lose data."""
    return pages.groupBy(key).agg(F.count("*").alias("n_pages")).where(F.col("n_pages") > 1)


def winning_fiches(fiches: DataFrame) -> DataFrame:
    """One sheet per id: the last file by name wins, then the last sheet in it.

    Sheet numbers repeat in every file, so this is an aggregation with map-side combine.
    """
    rest = F.struct(*[c for c in fiches.columns if c != "fiche_id"])
    best = fiches.groupBy("fiche_id").agg(F.max_by(rest, F.struct("source_doc", "idx")).alias("r"))
    return best.select("fiche_id", "r.*").withColumn("file", F.concat(F.lit("fiche_"), "fiche_id", F.lit(".json")))


def write_fiches(fiches: DataFrame, path: str) -> None:
    """Winning sheets as JSON rows, replaced by id; sheets of earlier files stay."""
    _upsert(winning_fiches(fiches), path, "fiche_id", "json")


def append_snapshot(snapshot: DataFrame, as_of: Column, path: str) -> None:
    """Add ``kind, name, sha256`` rows to the journal under one snapshot time."""
    snapshot.select("kind", "name", "sha256", as_of.cast("timestamp").alias("snapshot_ts")).write.mode("append").parquet(path)


def append_changes(diff: DataFrame, as_of: Column, path: str) -> None:
    """Add the changed sources ``kind, name, new_hash, status`` to the journal under one snapshot time."""
    rows = diff.select("kind", "name", F.col("new_hash").alias("sha256"), "status", as_of.cast("timestamp").alias("snapshot_ts"))
    rows.write.mode("append").parquet(path)


def _export_table(spark: SparkSession, path: str, buckets: int) -> BucketTable:
    return BucketTable(spark, path, "day string, patient string, nameless boolean, markdown string", "patient", buckets, ("day",))


def write_chat_exports(exports: DataFrame, day: str, path: str, buckets: int | None = None) -> None:
    """Markdown exports below ``patient=.../day=...``; other patients and days stay.

    A folder and a file per patient are too many for large tables: with ``buckets`` the exports are rows below
    ``day=.../bucket=...`` instead, replaced by patient and read by ``read_chat_exports``.
    """
    if buckets is not None:
        named = exports.select(
            F.lit(day).alias("day"), F.coalesce("patient", F.lit("")).alias("patient"), F.col("patient").isNull().alias("nameless"), "markdown"
        )
        named = materialize(named, "exports")
        _export_table(exports.sparkSession, path, buckets).merge(named.select("day", "patient"), named)
        return
    rows = exports.select("patient", F.lit(day).alias("day"), F.col("markdown").alias("value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("patient", "day").text(path, lineSep="\n\n")


def read_chat_exports(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """``day, patient, markdown`` of exports that were written in buckets."""
    rows = _export_table(spark, path, buckets).rows()
    return rows.select("day", F.when(~F.col("nameless"), F.col("patient")).alias("patient"), "markdown")


def change_status(base: DataFrame, changes: DataFrame, bucket: Column) -> DataFrame:
    """Outcome of every change ``seq, name, op, content`` against ``base(name, content)``.

    Applied in ``seq`` order per file: a create leaves the file present and a delete leaves it absent
    whatever their outcome, so presence before a change follows from the last such change alone.
    """
    here = base.select("name", F.lit(True).alias("_base"))
    valid = F.col("name").rlike(FILE_NAME)
    sets = F.when(valid, F.when(F.col("op") == "create", True).when(F.col("op") == "delete", False))
    told = with_last_before(changes, ["name"], "seq", sets, bucket, into="_set")
    present = F.coalesce("_set", "_base", F.lit(False))
    op = F.col("op")
    status = (
        F.when(~F.coalesce(valid, F.lit(False)), "400 invalid name")
        .when(~F.coalesce(op.isin("create", "update", "delete"), F.lit(False)), "400 invalid operation")
        .when((op == "create") & present, "409 exists")
        .when((op != "create") & ~present, "404 missing")
        .when(op == "create", "created")
        .when(op == "update", "updated")
        .otherwise("deleted")
    )
    return told.join(here, "name", "left").withColumn("status", status).select(*changes.columns, "status")


def apply_changes(base: DataFrame, changes: DataFrame, bucket: Column) -> DataFrame:
    """``name, content`` after all successful changes."""
    done = change_status(base, changes, bucket).where(F.col("status").isin("created", "updated", "deleted"))
    last = done.groupBy("name").agg(F.max_by(F.struct("status", "content"), "seq").alias("c"))
    merged = base.join(last, "name", "full")
    content = F.when(F.col("c").isNull(), F.col("content")).otherwise(F.col("c.content"))
    return merged.where(F.col("c").isNull() | (F.col("c.status") != "deleted")).select("name", content.alias("content"))

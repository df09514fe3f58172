"""Change detection by content hash, and maintenance of what was derived from changed sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.operators.ordered import with_last_before, with_previous

#: Windows of a burst gap that one task orders.
STRETCH = 1024


def content_hash(content: Column | str) -> Column:
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)


def snapshot_diff(before: DataFrame, now: DataFrame, rebuild_kinds: tuple[str, ...] = ()) -> DataFrame:
    """``kind, name, status`` for two ``(kind, name, sha256)`` snapshots.

    Status is added, modified, deleted or unchanged. Kinds in ``rebuild_kinds`` (derived output is
    missing) report every present source as modified. Presence is a row's own; a source without
    content has a null hash and is still there.
    """
    old = before.select("kind", "name", F.col("sha256").alias("old_hash"), F.lit(True).alias("_was"))
    new = now.select("kind", "name", F.col("sha256").alias("new_hash"), F.lit(True).alias("_is"))
    forced = F.col("kind").isin(*rebuild_kinds) if rebuild_kinds else F.lit(False)
    status = (
        F.when(F.col("_is").isNull(), "deleted")
        .when(F.col("_was").isNull(), "added")
        .when(~F.col("old_hash").eqNullSafe(F.col("new_hash")) | forced, "modified")
        .otherwise("unchanged")
    )
    return old.join(new, ["kind", "name"], "full").withColumn("status", status).drop("_was", "_is")


def latest_snapshot(journal: DataFrame) -> DataFrame:
    """Rows of the newest snapshot of each kind in an append-only journal."""
    newest = journal.groupBy("kind").agg(F.max("snapshot_ts").alias("snapshot_ts"))
    return journal.join(newest, ["kind", "snapshot_ts"], "left_semi")


def orphan_purge(derived: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Derived rows whose source still exists; rows of removed sources are gone."""
    return derived.join(live.select(key), key, "left_semi")


def reindex_decision(diff: DataFrame) -> DataFrame:
    """One row per kind: counts and whether its derived data must be rebuilt."""
    status = F.col("status")
    return diff.groupBy("kind").agg(
        F.count_if(status.isin("added", "modified")).alias("n_changed"),
        F.count_if(status == "deleted").alias("n_deleted"),
        F.bool_or(status != "unchanged").alias("reindex"),
    )


def incremental_chunks(chunks: DataFrame, diff: DataFrame, rebuilt: DataFrame, key: str = "name") -> DataFrame:
    """Keep chunks of unchanged sources and take those of changed sources from ``rebuilt``."""
    touched = diff.where(F.col("status") != "unchanged").select(key)
    return chunks.join(touched, key, "left_anti").unionByName(rebuilt)


def is_watched_name(path: Column) -> Column:
    """False for hidden and temporary files."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return ~(name.startswith(".") | name.endswith("~") | name.endswith(".tmp"))


def debounce_events(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Bursts of events less than ``gap_seconds`` apart: ``key, burst_start, burst_end, n_events``.

    Events inside one tumbling window as wide as the gap always belong together, so they are
    combined with a plain aggregation first. Occupied windows are ordered inside stretches of ``STRETCH`` of
    them; what crosses a border, the last event and the open burst, is carried by one row per stretch, so a key with
    most events is spread over many tasks.
    """
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = gap_seconds * 1_000_000
    windows = events.groupBy(key, (t - F.pmod(t, F.lit(gap))).alias("w")).agg(
        F.min(t).alias("s"), F.max(t).alias("e"), F.count("*").alias("n")
    )
    stretch = F.floor(F.col("w") / (gap * STRETCH))
    told = with_previous(windows, [key], "w", ["e"], stretch)
    opens = F.coalesce(F.col("s") - F.col("prev.e") >= gap, F.lit(True))
    told = told.withColumn("start", F.when(opens, F.col("s"))).drop("prev")
    told = with_last_before(told, [key], "w", F.col("start"), stretch, into="open")
    return (
        told.groupBy(key, F.coalesce("start", "open").alias("burst"))
        .agg(F.max("e").alias("e"), F.sum("n").alias("n_events"))
        .select(key, F.timestamp_micros("burst").alias("burst_start"), F.timestamp_micros("e").alias("burst_end"), "n_events")
    )

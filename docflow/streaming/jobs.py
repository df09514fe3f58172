"""Streaming forms of debouncing, indexing, vitals checks and the confirmation dialogue."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docflow.functions.wordlists import VITAL_RANGES
from docflow.operators import changes, chat
from docflow.runtime import materialize
from docflow.operators import vitals as vt


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything there is, append to a Parquet folder, and stop."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start().awaitTermination()


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def run_closed(stream: DataFrame, path: str, checkpoint: str) -> int:
    """Append what the watermark has closed to a Parquet folder and stop; returns how many rows came too late.

    Runs that share a checkpoint go on from the watermark of the one before.
    """
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    seen = query.recentProgress
    if seen and seen[-1]["batchId"] - seen[0]["batchId"] + 1 > len({p["batchId"] for p in seen}):
        raise ValueError("more batches than spark.sql.streaming.numRecentProgressUpdates keeps: late rows can't be counted")
    return sum(op["numRowsDroppedByWatermark"] for p in seen for op in p["stateOperators"])


# ------------------------------------------------------------------ debounce

def debounce_stream(events: DataFrame, key: str, ts: str, gap: str, delay: str, event_id: str | None = None) -> DataFrame:
    """Bursts of events closer than ``gap``; the watermark ``delay`` bounds the open sessions kept.

    In append mode each burst comes out once, when nothing on time can join it any more; later rows are dropped and
    counted by ``run_closed``. With ``event_id`` an event that is delivered again within ``delay`` counts once.
    """
    w = F.session_window("_t", gap)
    timed = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", delay)
    if event_id is not None:
        timed = timed.dropDuplicatesWithinWatermark([event_id])
    bursts = timed.groupBy(key, w.alias("w")).agg(
        F.min("_t").alias("burst_start"), F.max("_t").alias("burst_end"), F.count("*").alias("n_events")
    )
    return bursts.select(key, "burst_start", "burst_end", "n_events")


# ------------------------------------------------------------------ indexing

def index_batch(batch: DataFrame, batch_id: int, journal: str, chunks: str, make_chunks: Callable[[DataFrame], DataFrame],
                order: str | None = None) -> None:
    """Index one micro-batch of document versions ``name, text`` (null text means removed).

    Of several versions of a name the one with the largest ``order`` counts; without that column, the
    one with the largest content hash, so that a repeated batch decides alike.

    Only documents whose content hash changed are cut into chunks. Both tables are written per batch
    version, so a repeated batch replaces its own output and nothing else.
    """
    spark = batch.sparkSession
    hashed = batch.withColumn("sha256", changes.content_hash("text"))
    newest = F.struct("sha256") if order is None else F.struct(order, "sha256")
    hashed = hashed.groupBy("name").agg(F.max_by(F.struct("text", "sha256"), newest).alias("v")).select("name", "v.text", "v.sha256")
    try:
        seen = spark.read.parquet(journal).where(F.col("version") < batch_id)
        known = current_journal(seen.join(batch.select("name"), "name", "left_semi"))
    except Exception as e:  # the first batch finds no journal yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    if known is not None:
        before = known.select("name", F.col("sha256").alias("old"))
        hashed = hashed.join(before, "name", "left").where(~F.col("sha256").eqNullSafe(F.col("old"))).drop("old")
    hashed = materialize(hashed, "batch")  # feeds the chunks and the journal
    # the journal is written last: a batch counts only when its chunks are complete
    made = make_chunks(hashed.where(F.col("text").isNotNull()).select("name", "text"))
    version = F.lit(batch_id).alias("version")
    _replace_version(made.select("*", version), chunks)
    _replace_version(hashed.select("name", "sha256", version), journal)


def _replace_version(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def current_journal(journal: DataFrame) -> DataFrame:
    """Latest version and hash of every document."""
    latest = journal.groupBy("name").agg(F.max_by(F.struct("version", "sha256"), "version").alias("j"))
    return latest.select("name", "j.version", "j.sha256")


def current_chunks(chunks: DataFrame, journal: DataFrame) -> DataFrame:
    """Chunks of the latest version of every document that still exists."""
    live = current_journal(journal).where(F.col("sha256").isNotNull()).select("name", "version")
    return chunks.join(live, ["name", "version"], "left_semi").drop("version")


# ------------------------------------------------------------------ vitals

def vitals_stream(vitals: DataFrame, ranges: dict = VITAL_RANGES) -> DataFrame:
    """Flagged values of a stream of raw vitals; the same rules as the batch operators."""
    return vt.with_flags(vt.long_values(vt.parse_dates(vitals)), ranges)


def anomaly_windows(flagged: DataFrame, ts: str, window: str, delay: str) -> DataFrame:
    """Abnormal values per metric and tumbling window; late rows beyond ``delay`` are not waited for."""
    timed = flagged.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", delay)
    return timed.groupBy("metric", F.window("_t", window).alias("w")).agg(F.count_if("abnormal").alias("n_abnormal"))


# ------------------------------------------------------------------ dialogue

DIALOGUE_OUT = "session bigint, turn bigint, action string, intent string, patient string, switched boolean"
DIALOGUE_STATE = "pending boolean, intent string, name string, patient string"
#: A session without messages for so long starts anew.
IDLE_SECONDS = 24 * 3600


def _steps(rows: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
    """Actions for the messages of one session in order of turn, and the state after them.

    Requests and answers alternate, so what a message is follows from its place and the pending request alone, and
    the patient in charge is the last one that a confirmed request named.
    """
    pending, intent, name, patient = state
    asks = (np.arange(len(rows)) % 2 == 0) != bool(pending)
    out = pd.DataFrame({"turn": rows["turn"].to_numpy(), "asks": asks})
    for column, before in (("intent", intent), ("name", name)):
        asked = pd.Series([before, *rows[column].where(rows[column].notna(), None)], dtype=object)
        places = pd.Series(np.where(asks, np.arange(1, len(rows) + 1), np.nan)).ffill().fillna(0).astype(int)
        out[column] = asked.iloc[places].to_numpy()
    runs = ~asks & rows["is_yes"].fillna(False).to_numpy(dtype=bool)
    names = runs & out["name"].notna().to_numpy() & (out["intent"] != chat.UNKNOWN).to_numpy()
    in_charge = pd.Series([patient, *out["name"].where(pd.Series(names), None)], dtype=object)
    last = pd.Series(np.where(names, np.arange(1, len(rows) + 1), np.nan)).ffill().fillna(0).astype(int)
    before = in_charge.iloc[[0, *last[:-1]]].to_numpy()
    out["action"] = np.where(asks, "ask", np.where(runs, "execute", "reset"))
    out["switched"] = names & (out["name"].to_numpy() != before)
    end = out.iloc[-1]
    after = (bool(end["asks"]), end["intent"], end["name"], in_charge.iloc[last.iloc[-1]])
    return out.rename(columns={"name": "patient"}), after


def _dialogue(idle_seconds: int | None):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get if state.exists else (False, None, None, None)
        out, after = _steps(pd.concat(list(frames)).sort_values("turn", ignore_index=True), before)
        state.update(after)
        if idle_seconds is not None:
            state.setTimeoutDuration(idle_seconds * 1000)
        out["session"] = key[0]
        yield out[["session", "turn", "action", "intent", "patient", "switched"]]

    return run


def dialogue_stream(requests: DataFrame, idle_seconds: int | None = IDLE_SECONDS) -> DataFrame:
    """Confirmation dialogue over a stream of user messages ``session, turn, text, intent, name``.

    Messages of a session are ordered by turn inside a micro-batch. A session's state is dropped once it had no
    message for ``idle_seconds``. Spark then runs batches for ever to see the time pass, so a job that ends with its
    input (``run_available``) takes None, which keeps the state.
    """
    timeout = GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.ProcessingTimeTimeout
    told = requests.select("session", "turn", "intent", "name", chat.is_yes(F.col("text")).alias("is_yes"))
    return told.groupBy("session").applyInPandasWithState(_dialogue(idle_seconds), DIALOGUE_OUT, DIALOGUE_STATE, "append", timeout)

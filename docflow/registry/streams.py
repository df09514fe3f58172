"""Streaming jobs run to completion over the standard tables; results equal the batch operators."""

from pyspark.sql import functions as F

from docflow.registry.base import query, table
from docflow.registry.chat import DIALOGUE_SQL, requests
from docflow.registry.crawl import NOW_SQL, S_DEBOUNCE, passages, stamp, versions
from docflow.registry.structure import _s_pack
from docflow.registry.vitals import _s_flags, _s_told, raw_vitals, told
from docflow.runtime import scratch_path
from docflow.streaming import jobs


def stream(spark, sf, name):
    """A standard table as a stream, whether it is one file or a folder of part files.

    A pattern for the path makes Spark take both; a plain path to a file is refused as a base path.
    """
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


@query("debounce_events_stream", S_DEBOUNCE.format(gap=7200))
def debounce_events_stream(spark, sf):
    """Complete mode, because a finite input never moves the watermark past its last session."""
    path = scratch_path(spark, "bursts")
    bursts = jobs.debounce_stream(stream(spark, sf, "events"), "user_id", "ts", "7200 seconds", "1 day")
    jobs.run_batches(bursts, lambda df, n: df.write.mode("overwrite").parquet(path), path + "-state", "complete")
    return spark.read.parquet(path).select(
        "user_id", stamp("burst_start").alias("burst_start"), stamp("burst_end").alias("burst_end"), "n_events"
    )


# Three deliveries in order of time. Some events of the first are kept back to the last, which is too late; some of
# each delivery are delivered twice.
LATE_SQL = """WITH ends AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
  spans AS (SELECT events.*, 1 + (epoch_us(ts) - lo) * 3 // (hi - lo + 1) AS part FROM events, ends),
  told AS (SELECT *, part = 1 AND event_id % 37 = 0 AS late FROM spans)"""


def _delivered(spark, sf):
    """Runs the bursts in append mode; the folder of closed bursts and how many rows came too late."""
    root = scratch_path(spark, "closed-bursts")
    e = table(spark, sf, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = e.agg(F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    part = 1 + F.floor((t - F.lit(ends.lo)) * 3 / F.lit((ends.hi or 0) - (ends.lo or 0) + 1))
    late = (part == 1) & (F.col("event_id") % 37 == 0)
    told = e.withColumn("delivery", F.when(late, 3).otherwise(part))
    dropped = 0
    for n in (1, 2, 3):
        rows = told.where(F.col("delivery") == n).drop("delivery")
        again = rows.where(F.col("event_id") % 50 == 1)
        rows.unionByName(again).coalesce(1).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(e.schema).parquet(f"{root}/in")
        bursts = jobs.debounce_stream(source, "user_id", "ts", "7200 seconds", "1 day", event_id="event_id")
        dropped += jobs.run_closed(bursts, f"{root}/out", f"{root}/state")
    return f"{root}/out", dropped


@query(
    "debounce_events_closed",
    f"""{LATE_SQL}, e AS (SELECT * FROM told WHERE NOT late),
  marked AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 7200 * 1000000::BIGINT THEN 0 ELSE 1 END AS o FROM e),
  bursts AS (SELECT user_id, min(ts) AS s, max(ts) AS t, count(*) AS n_events FROM (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM marked) GROUP BY user_id, burst)
  SELECT user_id, s::VARCHAR AS burst_start, t::VARCHAR AS burst_end, n_events FROM bursts
  WHERE t + INTERVAL 7200 SECOND <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
)
def debounce_events_closed(spark, sf):
    """Append mode: every burst that can't change any more, once, without repeated or late events."""
    rows = spark.read.parquet(_delivered(spark, sf)[0])
    return rows.select("user_id", stamp("burst_start").alias("burst_start"), stamp("burst_end").alias("burst_end"), "n_events")


@query("debounce_events_late", f"{LATE_SQL} SELECT sum(CASE WHEN event_id % 50 = 1 THEN 2 ELSE 1 END)::BIGINT AS n_late FROM told WHERE late")
def debounce_events_late(spark, sf):
    """How many deliveries came behind the watermark."""
    late = _delivered(spark, sf)[1]
    return spark.range(1).select(F.lit(late).cast("bigint").alias("n_late"))


@query(
    "stream_index",
    "SELECT doc_id::VARCHAR AS name, passage_no, passage FROM (" + _s_pack(False).replace("FROM documents)", f"FROM ({NOW_SQL}))") + ")",
)
def stream_index(spark, sf):
    """Two deliveries of document versions; the second has changed, new and removed documents."""
    root = scratch_path(spark, "index")
    before, now = versions(spark, sf)
    removed = before.join(now.select("name"), "name", "left_anti").select("name", F.lit(None).cast("string").alias("text"))
    for delivery in (before.select("name", "text"), now.select("name", "text").unionByName(removed)):
        delivery.write.mode("append").parquet(f"{root}/in")
        versions_in = spark.readStream.schema("name string, text string").parquet(f"{root}/in")
        jobs.run_batches(
            versions_in,
            lambda df, n: jobs.index_batch(df, n, f"{root}/journal", f"{root}/chunks", passages),
            f"{root}/state",
        )
    return jobs.current_chunks(spark.read.parquet(f"{root}/chunks"), spark.read.parquet(f"{root}/journal")).select(
        "name", "passage_no", "passage"
    )


@query("vitals_stream", _s_told(_s_flags(False)))
def vitals_stream(spark, sf):
    path = scratch_path(spark, "vitals")
    jobs.run_available(jobs.vitals_stream(raw_vitals(stream(spark, sf, "events"))), path, path + "-state")
    return told(spark.read.parquet(path))


@query(
    "vitals_window_stream",
    f"SELECT metric, strftime(time_bucket(INTERVAL 7 DAY, date::DATE, DATE '1970-01-01'), '%Y-%m-%d') AS week, count(*) FILTER (abnormal) AS n_abnormal FROM ({_s_flags(False)}) GROUP BY ALL",
)
def vitals_window_stream(spark, sf):
    path = scratch_path(spark, "windows")
    flagged = jobs.vitals_stream(raw_vitals(stream(spark, sf, "events"))).withColumn("ts", F.col("date").cast("timestamp"))
    counts = jobs.anomaly_windows(flagged, "ts", "7 days", "30 days")
    jobs.run_batches(counts, lambda df, n: df.write.mode("overwrite").parquet(path), path + "-state", "complete")
    return spark.read.parquet(path).select("metric", F.date_format("w.start", "yyyy-MM-dd").alias("week"), "n_abnormal")


@query(
    "vitals_window_closed",
    f"""WITH f AS (SELECT metric, date::DATE AS d, abnormal FROM ({_s_flags(False)})),
  w AS (SELECT metric, time_bucket(INTERVAL 7 DAY, d, DATE '1970-01-01') AS week, count(*) FILTER (abnormal) AS n_abnormal FROM f GROUP BY ALL)
  SELECT metric, strftime(week, '%Y-%m-%d') AS week, n_abnormal FROM w WHERE week + INTERVAL 7 DAY <= (SELECT max(d) FROM f) - INTERVAL 5 DAY""",
)
def vitals_window_closed(spark, sf):
    """Append mode: the weeks that lie behind the watermark, each once."""
    path = scratch_path(spark, "closed-windows")
    flagged = jobs.vitals_stream(raw_vitals(stream(spark, sf, "events"))).withColumn("ts", F.col("date").cast("timestamp"))
    jobs.run_closed(jobs.anomaly_windows(flagged, "ts", "7 days", "5 days"), path, path + "-state")
    return spark.read.parquet(path).select("metric", F.date_format("w.start", "yyyy-MM-dd").alias("week"), "n_abnormal")


@query("confirm_dialogue_stream", DIALOGUE_SQL)
def confirm_dialogue_stream(spark, sf):
    path = scratch_path(spark, "dialogue")
    turns = stream(spark, sf, "conversations").where(F.col("role") == "user")
    jobs.run_available(jobs.dialogue_stream(requests(turns), idle_seconds=None), path, path + "-state")
    return spark.read.schema(jobs.DIALOGUE_OUT).parquet(path)

"""Event-time operators that work alike on streams and on tables.

State is bounded by the watermark in every one of them.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clipwright.sources.tables import shared_dir
from clipwright.streaming.frames import frame_windows, timed_state

log = logging.getLogger(__name__)


def event_stream(spark: SparkSession, folder: str, files: str = "events.parquet", per_trigger: int = 16) -> DataFrame:
    """A file stream with ``ts`` as an instant; the schema is read from the files there."""
    schema = spark.read.parquet(f"{folder}/{files}").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def hopping(events: DataFrame, size: str, hop: str, late: str, *by: str) -> DataFrame:
    """``(start, *by, n, total)`` of windows; those older than the watermark are closed."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, hop).alias("w"), *by)
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, late: str, *by: str) -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(*by, F.session_window("ts", gap).alias("w"))
    return s.agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, late: str, *keys: str) -> DataFrame:
    """The first row of each key among those within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def joined(left: DataFrame, right: DataFrame, key: str, within: str, late: str) -> DataFrame:
    """Rows of ``right (key, ts, right_id)`` at or up to ``within`` after those of ``left (key,
    ts, left_id)``. Both sides' state goes once the watermark has passed."""
    a = left.withWatermark("ts", late).select(F.col(key), F.col("ts").alias("left_ts"), "left_id")
    b = right.withWatermark("ts", late).select(F.col(key).alias("_key"), F.col("ts").alias("right_ts"), "right_id")
    near = F.expr(f"{key} = _key AND right_ts >= left_ts AND right_ts <= left_ts + INTERVAL {within}")
    return a.join(b, near).select(key, "left_id", "right_id", "right_ts")


def emitting(stream: DataFrame, emit: Callable[[DataFrame, int], None], state: str) -> StreamingQuery:
    """Hands every micro-batch to ``emit``; what it raises is logged and the stream goes on."""

    def guarded(batch: DataFrame, number: int) -> None:
        try:
            emit(batch, number)
        except Exception:  # noqa: BLE001 - a listener does not stop the stream
            log.exception("listener failed on batch %d", number)

    return stream.writeStream.foreachBatch(guarded).option("checkpointLocation", state).trigger(availableNow=True).start()


def polled(stream: DataFrame, name: str) -> StreamingQuery:
    """Runs a stream into a table in memory that can be read by ``name`` meanwhile: for small
    results, such as a demonstration's windows."""
    return stream.writeStream.format("memory").queryName(name).outputMode("append").start()


def window_by_id(windows: DataFrame, **ids: int) -> dict:
    """One window of those that were kept; KeyError without it."""
    found = windows
    for column, value in ids.items():
        found = found.filter(F.col(column) == value)
    row = found.first()
    if row is None:
        raise KeyError(ids)
    return row.asDict()


def history(windows: DataFrame, *order: Column, n: int = 10) -> DataFrame:
    """The last ``n`` windows, the latest first."""
    return windows.orderBy(*order).limit(n)


def drained(stream: DataFrame, tag: str) -> DataFrame:
    """Runs a stream over all that is there and reads what its file sink holds."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with timed_state(spark):
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def stream_hopping_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = drained(hopping(event_stream(spark, sf_dir), "1 hour", "30 minutes", "10 minutes", "event_type"), "hopping")
    return closed.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = drained(sessions(event_stream(spark, sf_dir), "6 hours", "10 minutes", "user_id"), "sessions")
    return closed.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def _latency_stream(spark: SparkSession, sf_dir: str, late: str = "0 seconds") -> DataFrame:
    e = event_stream(spark, sf_dir).select(F.col("user_id").alias("clip_id"), "ts", "event_id", (F.col("event_id") % 11 * 80.0).alias("latency"))
    return frame_windows(e, 8, 3, 600.0, late)


def stream_frame_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(_latency_stream(spark, sf_dir), "frame-windows")


def stream_late_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows when frames may be a day late: those that the watermark has passed."""
    return drained(_latency_stream(spark, sf_dir, "1 day"), "late-frames")


def window_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten windows of the kept ones."""
    kept = drained(_latency_stream(spark, sf_dir), "window-history")
    return history(kept, F.desc("window_id"), F.desc("clip_id")).select("window_id", "clip_id", "last_id")


def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases up to six hours after a click of the same user."""
    side = lambda kind, name: event_stream(spark, sf_dir).filter(F.col("event_type") == kind).select("user_id", "ts", F.col("event_id").alias(name))
    return drained(joined(side("click", "left_id"), side("purchase", "right_id"), "user_id", "6 HOURS", "1 hour"), "joined").select("user_id", "left_id", "right_id")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's types, once; the watermark is longer than the data."""
    return drained(once(event_stream(spark, sf_dir), "60 days", "user_id", "event_type"), "once").select("user_id", "event_type")


LAST = "(SELECT max(ts) - INTERVAL '10 minutes' FROM events)"
_FRAMES = """WITH RECURSIVE f AS (SELECT user_id AS clip_id, event_id, event_id % 11 * 80.0::DOUBLE AS latency, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events{where}),
w(clip_id, e, number) AS (SELECT DISTINCT clip_id, 8::BIGINT, 0::BIGINT FROM f UNION ALL SELECT w.clip_id, w.e + CASE WHEN f.latency > 600 THEN 8 ELSE 3 END, w.number + CASE WHEN f.latency > 600 THEN 0 ELSE 1 END FROM w JOIN f ON f.clip_id = w.clip_id AND f.i = w.e),
k AS (SELECT w.clip_id, w.number AS window_id, a.event_id AS first_id, b.event_id AS last_id, b.latency FROM w JOIN f AS b ON b.clip_id = w.clip_id AND b.i = w.e JOIN f AS a ON a.clip_id = w.clip_id AND a.i = w.e - 7 WHERE b.latency <= 600)
"""
QUERIES = {
    "stream_frame_windows": (stream_frame_windows, _FRAMES.format(where="") + "SELECT * FROM k"),
    "stream_late_frames": (stream_late_frames, _FRAMES.format(where=" WHERE ts <= (SELECT max(ts) - INTERVAL '1 day' FROM events)") + "SELECT * FROM k"),
    "window_history": (window_history, _FRAMES.format(where="") + "SELECT window_id, clip_id, last_id FROM k ORDER BY window_id DESC, clip_id DESC LIMIT 10"),
    "stream_join": (stream_join, "SELECT a.user_id, a.event_id AS left_id, b.event_id AS right_id FROM events AS a JOIN events AS b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL '6 hours'"),
    "stream_dedup": (stream_dedup, "SELECT DISTINCT user_id, event_type FROM events"),
    "stream_hopping_windows": (stream_hopping_windows, f"SELECT * FROM (SELECT time_bucket(INTERVAL '30 minutes', ts) - t.k * INTERVAL '30 minutes' AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events, range(2) AS t(k) GROUP BY 1, 2) AS x WHERE start + INTERVAL '1 hour' <= {LAST}"),
    "stream_sessions": (stream_sessions, f"WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT * FROM (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS \"end\", count(*) AS n FROM s GROUP BY user_id, k) AS x WHERE \"end\" <= {LAST}"),
}

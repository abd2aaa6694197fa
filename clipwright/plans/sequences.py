"""Sequence queries: events of a user stand for the frames of a clip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipwright.functions import arrays as A
from clipwright.operators import series as S
from clipwright.plans.evaluation import r6
from clipwright.sources.tables import table

ORDER = ["ts", "event_id"]
#: Least confidence over three frames for an acceleration to count as an impact.
GATE = 0.3


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("clip_id"), "ts", "event_type", "value")


def confidence() -> Column:
    """A stand-in confidence in [0.1, 1] that any engine computes alike."""
    return (F.col("event_id") % 7 + 1) / 7.0


def velocity_accel_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = S.kinematics(frames(spark, sf_dir), "clip_id", ORDER, "value", confidence())
    return k.select("event_id", "clip_id", r6("velocity"), r6("acceleration"), r6("gate"))


def motion_energy_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact counts a frame fully or not at all, as the least confidence of three reaches GATE."""
    k = S.kinematics(frames(spark, sf_dir), "clip_id", ORDER, "value", confidence())
    return k.groupBy("clip_id").agg(r6(F.avg(F.pow("velocity", F.lit(2))), "motion_energy"), r6(F.max(F.abs(F.col("acceleration") * (F.col("gate") >= GATE).cast("double"))), "impact"))


def periodicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the energy of each frame, the square of its velocity."""
    k = S.kinematics(frames(spark, sf_dir), "clip_id", ORDER, "value", confidence())
    energy = k.withColumn("energy", F.pow("velocity", F.lit(2)))
    return S.periodicity(energy, "clip_id", ORDER, "energy").select("clip_id", "n", r6("periodicity"))


def shoulder_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values over the median of those of confidence above 0.3, where there are three."""
    rows = frames(spark, sf_dir).withColumn("conf", confidence())
    good = rows.filter("conf > 0.3").groupBy("clip_id").agg(F.median("value").alias("width"), F.count("*").alias("n")).filter("n >= 3 and width > 0")
    return rows.join(good, "clip_id", "left").select("event_id", r6(F.col("value") / F.coalesce("width", F.lit(1.0)), "scaled"))


def au_frame_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intensity summed over types for each clip and hour."""
    return frames(spark, sf_dir).groupBy("clip_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("frame")).agg(r6(F.sum("value"), "score"))


def peak_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.peak(frames(spark, sf_dir), "clip_id", "event_id", "value").select("clip_id", "event_id", r6("value"))


def peak_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The peak frame of each clip by every method."""
    rows = frames(spark, sf_dir)
    made = [S.peak_by(rows, "clip_id", "event_id", "value", m).withColumn("method", F.lit(m)) for m in ("max_au_intensity", "middle", "attention_pool")]
    return made[0].unionByName(made[1]).unionByName(made[2]).select("clip_id", "method", "frame", r6("score"))


def created_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of creation in UTC as ISO-8601 text with the offset, and read back from it."""
    at = F.col("ts").cast("timestamp")
    text = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    text = F.when(text.contains(".000000+"), F.replace(text, F.lit(".000000"), F.lit(""))).otherwise(text)
    made = table(spark, sf_dir, "events").select("event_id", "ts", text.alias("created_at"))
    return made.select("event_id", "created_at", (F.to_timestamp("created_at").cast("timestamp_ntz") == F.col("ts")).alias("same"))


def middle_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = S.ordered(frames(spark, sf_dir), "clip_id", ORDER)
    return seq.filter(F.col("i") == F.floor(F.col("n") / 2)).select("clip_id", "event_id", "i")


def peak_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).withColumn("k", confidence())
    scored = rows.withColumn("z", F.round(S.z_score("value", "clip_id") + S.z_score("k", "clip_id"), 9))
    return S.peak(scored, "clip_id", "event_id", "z").select("clip_id", "event_id", r6("z"))


def top_aus(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = frames(spark, sf_dir).groupBy("clip_id", "event_type").agg(F.max("value").alias("top"))
    rank = F.row_number().over(Window.partitionBy("clip_id").orderBy(F.desc("top"), "event_type"))
    kept = best.withColumn("rank", rank).filter("rank <= 5")
    return kept.groupBy("clip_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_type"))), lambda x: x["event_type"]), ",").alias("types"))


def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.uniform_sample(frames(spark, sf_dir), "clip_id", ORDER, 16).select("clip_id", "slot", "event_id")


def every_third_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = S.ordered(frames(spark, sf_dir), "clip_id", ORDER)
    return seq.filter("i % 3 = 0").select("clip_id", "event_id", (F.col("i") / 3).cast("int").alias("frame"))


def frame_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of clips of several rates at four a second."""
    rate = F.col("clip_id") % 7 * 3 + 2.0
    return S.thinned(frames(spark, sf_dir), "clip_id", ORDER, rate, 4.0).select("clip_id", "event_id", "frame")


def trimmed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with a head and a tail cut off, four at most, by name, with their metadata."""
    d = table(spark, sf_dir, "orders").select("o_orderkey", (F.floor("o_totalprice") % 3000 / 100).alias("duration"))
    parts = d.select("o_orderkey", F.posexplode(S.segments(F.col("duration"), 5.0, 4.5, 5.5, 1.5, 0.5, 4)).alias("k", "x"))
    return parts.select(F.format_string("%d_seg_%03d", "o_orderkey", F.col("k") + 1).alias("clip_id"), F.round("x.start", 3).alias("start_sec"), F.round("x.size", 3).alias("duration_sec"))


def segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select("o_orderkey", (F.floor("o_totalprice") % 3000 / 100).alias("duration"))
    parts = d.select("o_orderkey", F.explode(S.segments(F.col("duration"), 5.0, 4.5, 5.5)).alias("x"))
    return parts.select("o_orderkey", r6("x.start", "start"), r6("x.size", "size"))


def adaptive_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = A.doubles(F.col("embedding"))
    pooled = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(S.adaptive_pool(v, 10)).alias("bucket", "x"))
    return pooled.select("vec_id", "bucket", r6("x"))


def _resample(n: int, align: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = A.doubles(F.col("embedding"))
        made = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(S.linear_resample(v, n, align)).alias("i", "x"))
        return made.select("vec_id", "i", r6("x"))

    return query


def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = frames(spark, sf_dir).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 9).alias("metric"))
    return S.early_stopping(days, "event_type", "day", "metric", 5).select("event_type", "day", r6("metric"), "improved", "waited", "stopped")


def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(200).select(F.col("id").cast("int").alias("step"), r6(S.warmup_cosine(F.col("id"), 20, 200), "factor"))


def hopping_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of an hour every twenty minutes, over each type."""
    w = frames(spark, sf_dir).groupBy(F.window("ts", "1 hour", "20 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), r6(F.sum("value"), "total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = frames(spark, sf_dir).groupBy("clip_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("clip_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def complete_frame_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 25 frames every 5, once they are full."""
    seq = S.ordered(frames(spark, sf_dir), "clip_id", ORDER)
    w = Window.partitionBy("clip_id").orderBy("i").rowsBetween(-24, 0)
    full = seq.withColumn("mean", F.avg("value").over(w)).filter("i >= 24 and (i - 24) % 5 = 0")
    return full.select("clip_id", F.floor((F.col("i") - 24) / 5).cast("int").alias("window_id"), r6("mean"))


SEQ = "WITH f AS (SELECT event_id, user_id AS clip_id, ts, event_type, value, (event_id % 7 + 1) / 7.0::DOUBLE AS conf, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
KIN = SEQ + """, v AS (SELECT *, coalesce((value - lag(value) OVER w) * conf * lag(conf) OVER w, 0) AS velocity FROM f WINDOW w AS (PARTITION BY clip_id ORDER BY i)),
k AS (SELECT *, CASE WHEN i >= 2 THEN (velocity - lag(velocity) OVER w) * conf * lag(conf) OVER w * lag(conf, 2) OVER w ELSE 0 END AS acceleration, CASE WHEN i >= 2 THEN min(conf) OVER (PARTITION BY clip_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) ELSE 0 END AS gate FROM v WINDOW w AS (PARTITION BY clip_id ORDER BY i))
"""
RESAMPLE = "WITH p AS (SELECT vec_id, embedding, t.i, {place} AS place FROM embeddings, range({n}) AS t(i)) SELECT vec_id, i::INTEGER AS i, round(embedding[least(floor(place)::INTEGER, 63) + 1]::DOUBLE * (1 - (place - least(floor(place)::INTEGER, 63))) + embedding[least(least(floor(place)::INTEGER, 63) + 1, 63) + 1]::DOUBLE * (place - least(floor(place)::INTEGER, 63)), 6) AS x FROM p"

QUERIES = {
    "velocity_accel_gate": (velocity_accel_gate, KIN + "SELECT event_id, clip_id, round(velocity, 6) AS velocity, round(acceleration, 6) AS acceleration, round(gate, 6) AS gate FROM k"),
    "motion_energy_impact": (motion_energy_impact, KIN + "SELECT clip_id, round(avg(velocity ** 2), 6) AS motion_energy, round(max(abs(acceleration * (gate >= 0.3)::INTEGER)), 6) AS impact FROM k GROUP BY clip_id"),
    "periodicity": (periodicity, KIN + ", d AS (SELECT clip_id, i, n, velocity ** 2 - avg(velocity ** 2) OVER (PARTITION BY clip_id) AS d FROM k WHERE n >= 4), l AS (SELECT a.clip_id, b.i - a.i AS lag, sum(a.d * b.d) AS s FROM d AS a JOIN d AS b ON a.clip_id = b.clip_id AND b.i >= a.i GROUP BY 1, 2), m AS (SELECT clip_id, any_value(n) AS n FROM d GROUP BY clip_id) SELECT m.clip_id, m.n, round(coalesce(max(l.s) FILTER (l.lag >= 1 AND l.lag <= m.n // 2 - 1) / nullif(max(l.s) FILTER (l.lag = 0), 0), 0), 6) AS periodicity FROM m JOIN l USING (clip_id) GROUP BY m.clip_id, m.n"),
    "shoulder_norm": (shoulder_norm, SEQ + ", g AS (SELECT clip_id, median(value) AS width, count(*) AS n FROM f WHERE conf > 0.3 GROUP BY clip_id) SELECT event_id, round(value / coalesce(CASE WHEN g.n >= 3 AND width > 0 THEN width END, 1), 6) AS scaled FROM f LEFT JOIN g USING (clip_id)"),
    "au_frame_sum": (au_frame_sum, "SELECT user_id AS clip_id, date_trunc('hour', ts) AS frame, round(sum(value), 6) AS score FROM events GROUP BY 1, 2"),
    "peak_methods": (peak_methods, "WITH f AS (SELECT user_id AS clip_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), p AS (SELECT clip_id, i, value FROM f QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY value DESC, i) = 1) SELECT clip_id, 'max_au_intensity' AS method, i::INTEGER AS frame, round(value, 6) AS score FROM p UNION ALL SELECT clip_id, m.m, i::INTEGER, 0.0 FROM f, (VALUES ('middle'), ('attention_pool')) AS m(m) WHERE i = n // 2"),
    "created_at": (created_at, "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS created_at, true AS same FROM events"),
    "peak_frame": (peak_frame, "SELECT clip_id, event_id, round(value, 6) AS value FROM (SELECT user_id AS clip_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) AS x WHERE r = 1"),
    "middle_frame": (middle_frame, SEQ + "SELECT clip_id, event_id, i FROM f WHERE i = n // 2"),
    "peak_zscore": (peak_zscore, SEQ + ", z AS (SELECT clip_id, event_id, round(CASE WHEN stddev_pop(value) OVER w > 1e-8 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0 END + CASE WHEN stddev_pop(conf) OVER w > 1e-8 THEN (conf - avg(conf) OVER w) / stddev_pop(conf) OVER w ELSE 0 END, 9) AS z FROM f WINDOW w AS (PARTITION BY clip_id)) SELECT clip_id, event_id, round(z, 6) AS z FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY z DESC, event_id) AS r FROM z) AS x WHERE r = 1"),
    "top_aus": (top_aus, "WITH b AS (SELECT user_id AS clip_id, event_type, max(value) AS top FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY top DESC, event_type) AS rank FROM b) SELECT clip_id, string_agg(event_type, ',' ORDER BY rank) AS types FROM r WHERE rank <= 5 GROUP BY clip_id"),
    "uniform_sample": (uniform_sample, SEQ + ", s AS (SELECT DISTINCT clip_id, n, t.slot FROM f, range(16) AS t(slot)) SELECT s.clip_id, s.slot::INTEGER AS slot, f.event_id FROM s JOIN f ON f.clip_id = s.clip_id AND f.i = CASE WHEN s.n < 16 THEN least(s.slot, s.n - 1) ELSE (s.slot * (s.n - 1)) // 15 END"),
    "every_third_frame": (every_third_frame, SEQ + "SELECT clip_id, event_id, (i // 3)::INTEGER AS frame FROM f WHERE i % 3 = 0"),
    "segmentation": (segmentation, "WITH d AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT % 3000 / 100.0::DOUBLE AS duration FROM orders), f AS (SELECT *, floor(duration / 5)::INTEGER AS k FROM d) SELECT o_orderkey, (t.i * 5)::DOUBLE AS start, 5.0::DOUBLE AS size FROM f, range(6) AS t(i) WHERE t.i < k UNION ALL SELECT o_orderkey, (k * 5)::DOUBLE, round(duration - k * 5, 6) FROM f WHERE duration - k * 5 BETWEEN 4.5 AND 5.5"),
    "frame_sampling": (frame_sampling, SEQ + ", k AS (SELECT *, greatest(1, CASE WHEN abs((clip_id % 7 * 3 + 2) % 4) = 2 THEN 2 * round((clip_id % 7 * 3 + 2) / 8.0) ELSE round((clip_id % 7 * 3 + 2) / 4.0) END)::INTEGER AS step FROM f) SELECT clip_id, event_id, (i // step)::INTEGER AS frame FROM k WHERE i % step = 0"),
    "trimmed_segments": (trimmed_segments, "WITH d AS (SELECT o_orderkey, greatest(floor(o_totalprice)::BIGINT % 3000 / 100.0::DOUBLE - 0.5, 1.5) - 1.5 AS d FROM orders), f AS (SELECT *, floor(d / 5)::INTEGER AS k FROM d), s AS (SELECT o_orderkey, t.i AS i, 5.0::DOUBLE AS size FROM f, range(4) AS t(i) WHERE t.i < k UNION ALL SELECT o_orderkey, k, d - k * 5 FROM f WHERE d - k * 5 BETWEEN 4.5 AND 5.5 AND k < 4) SELECT printf('%d_seg_%03d', o_orderkey, i + 1) AS clip_id, round(1.5 + i * 5, 3)::DOUBLE AS start_sec, round(size, 3) AS duration_sec FROM s"),
    "adaptive_pool": (adaptive_pool, "SELECT vec_id, t.i::INTEGER AS bucket, round(list_avg(embedding[floor(t.i * 64 / 10.0)::INTEGER + 1 : ceil((t.i + 1) * 64 / 10.0)::INTEGER]::DOUBLE[]), 6) AS x FROM embeddings, range(10) AS t(i)"),
    "linear_resample": (_resample(96, False), RESAMPLE.format(n=96, place="greatest((t.i + 0.5::DOUBLE) * 64 / 96 - 0.5::DOUBLE, 0)")),
    "interp_envelope": (_resample(20, True), RESAMPLE.format(n=20, place="t.i * 63 / 19::DOUBLE")),
    "early_stopping": (early_stopping, "WITH d AS (SELECT event_type, ts::DATE AS day, round(avg(value), 9) AS metric FROM events GROUP BY 1, 2), b AS (SELECT *, max(metric) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM d), m AS (SELECT *, best IS NULL OR metric > best AS improved FROM b), w AS (SELECT *, i - max(CASE WHEN improved THEN i END) OVER (PARTITION BY event_type ORDER BY day) AS waited FROM m) SELECT event_type, day, round(metric, 6) AS metric, improved, waited, waited >= 5 AS stopped FROM w"),
    "lr_schedule": (lr_schedule, "SELECT i::INTEGER AS step, round(CASE WHEN i < 20 THEN i / 20.0::DOUBLE ELSE greatest(0, 0.5 * (1 + cos(pi() * (i - 20) / 180))) END, 6) AS factor FROM range(200) AS t(i)"),
    "hopping_windows": (hopping_windows, "SELECT time_bucket(INTERVAL '20 minutes', ts) - t.k * INTERVAL '20 minutes' AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events, range(3) AS t(k) GROUP BY 1, 2"),
    "sessions": (sessions, "WITH g AS (SELECT user_id AS clip_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT clip_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS \"end\", count(*) AS n FROM s GROUP BY clip_id, k"),
    "complete_frame_windows": (complete_frame_windows, SEQ + ", w AS (SELECT clip_id, i, avg(value) OVER (PARTITION BY clip_id ORDER BY i ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS mean FROM f) SELECT clip_id, ((i - 24) // 5)::INTEGER AS window_id, round(mean, 6) AS mean FROM w WHERE i >= 24 AND (i - 24) % 5 = 0"),
}

import datetime as dt

from pyspark.sql import Row
from pyspark.sql import functions as F

from clipwright.streaming import windows as W


def _folder(spark, tmp_path, rows):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").coalesce(1).write.parquet(path)
    return path


def test_repeats_within_the_watermark_go(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(i % 5, at + dt.timedelta(seconds=i), 1, 1.0) for i in range(20)]
    stream = W.event_stream(spark, _folder(spark, tmp_path, rows), "*.parquet")
    assert sorted(r.event_id for r in W.drained(W.once(stream, "1 hour", "event_id"), "once").collect()) == [0, 1, 2, 3, 4]


def test_open_windows_wait(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(minutes=10 * i), 1, 1.0) for i in range(12)]
    stream = W.event_stream(spark, _folder(spark, tmp_path, rows), "*.parquet")
    out = W.drained(W.hopping(stream, "1 hour", "1 hour", "0 minutes", "user_id"), "open").select("n", F.col("total")).collect()
    assert [tuple(r) for r in out] == [(6, 6.0)]


def test_empty_table(spark, tmp_path):
    path = _folder(spark, tmp_path, [])
    assert W.drained(W.sessions(W.event_stream(spark, path, "*.parquet"), "1 hour", "0 minutes", "user_id"), "none").count() == 0


def test_slow_windows_clear_the_buffer(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(seconds=i), 1, 1.0) for i in range(20)]
    frames = W.event_stream(spark, _folder(spark, tmp_path, rows), "*.parquet")
    frames = frames.select(F.col("user_id").alias("clip_id"), "ts", "event_id", F.when(F.col("event_id") == 6, 900.0).otherwise(5.0).alias("latency"))
    got = sorted(tuple(r)[1:4] for r in W.drained(W.frame_windows(frames, 5, 2, 600.0), "slow").collect())
    # The window that ends at 6 is dropped with the buffer; the next one ends five frames later.
    assert got == [(0, 0, 4), (1, 7, 11), (2, 9, 13), (3, 11, 15), (4, 13, 17), (5, 15, 19)]


def test_a_failing_listener_does_not_stop_the_stream(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    stream = W.event_stream(spark, _folder(spark, tmp_path, [(i, at, 1, 1.0) for i in range(4)]), "*.parquet")
    seen = []

    def emit(batch, number):
        seen.append(batch.count())
        raise ValueError("no")

    query = W.emitting(stream, emit, str(tmp_path / "state"))
    query.awaitTermination()
    assert seen == [4] and query.exception() is None


def test_polled_results_and_look_up(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    stream = W.event_stream(spark, _folder(spark, tmp_path, [(i, at, 1, 1.0) for i in range(4)]), "*.parquet")
    query = W.polled(stream, "polled")
    query.processAllAvailable()
    query.stop()
    assert W.window_by_id(spark.table("polled"), event_id=2)["user_id"] == 1
    try:
        W.window_by_id(spark.table("polled"), event_id=9)
    except KeyError:
        return
    raise AssertionError("a window that is not there was found")


def _frames(spark, path, files, late, idle="30 days", **start):
    """One micro-batch for each list of (second, event_id) in ``files``."""
    at = dt.datetime(2024, 1, 1)
    for rows in files:
        data = [(i, at + dt.timedelta(seconds=s), c, 5.0) for s, i, c in rows]
        spark.createDataFrame(data, "event_id long, ts timestamp_ntz, clip_id long, latency double").coalesce(1).write.mode("append").parquet(path)
    stream = W.event_stream(spark, path, "*.parquet", per_trigger=1)
    return W.frame_windows(stream, 3, 2, 600.0, late, idle)


def test_frames_out_of_order_over_micro_batches(spark, tmp_path):
    order = [5, 1, 9, 3, 0, 7, 12, 4, 2, 14, 8, 6, 10, 13, 11]
    files = [[(s, s, 1) for s in order[k : k + 5]] for k in (0, 5, 10)] + [[(1000, 1000, 2)]]
    got = W.drained(_frames(spark, str(tmp_path / "in"), files, "20 seconds"), "order").filter("clip_id = 1")
    want = [(1, k, 2 * k, 2 * k + 2, 5.0) for k in range(7)]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_state_of_idle_clips_goes(spark, tmp_path):
    path = str(tmp_path / "in")
    files = [[(s, s, 1) for s in range(5)], [(60, 60, 2)], [(120, 120, 3)], [(180, 180, 1), (181, 181, 1), (182, 182, 1)], [(400, 400, 4)], [(900, 900, 9)]]
    stream = _frames(spark, path, files, "1 second", "20 seconds")
    with W.timed_state(spark):
        query = stream.writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = sorted((r.clip_id, r.window_id, r.first_id, r.last_id) for r in spark.table("idle").collect())
    # A clip that comes back after the idle time starts anew, with number 0.
    assert rows == [(1, 0, 0, 2), (1, 0, 180, 182), (1, 1, 2, 4)]
    kept = spark.read.format("statestore").option("stateVarName", "clip").load(str(tmp_path / "state")).count()
    held = spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "state")).count()
    # Only the last clip's one frame is held; no other clip has a row left.
    assert kept == 1 and held == 1


def test_one_micro_batch_or_many_give_the_same(spark, tmp_path):
    rows = [(s * 7 % 100 + (200 if s % 3 == 0 else 0), s, s % 2) for s in range(100)]
    rows.sort(key=lambda r: r[0] + (r[1] * 13 % 9))
    end = [(10_000, 10_000, 5)]
    results = []
    for name, parts in (("one", [rows]), ("many", [rows[:40], rows[40:60], rows[60:]])):
        got = W.drained(_frames(spark, str(tmp_path / name), [*parts, end], "30 seconds", "60 seconds"), name)
        results.append(sorted(tuple(r) for r in got.collect()))
    assert results[0] == results[1] and {r[1] for r in results[0]} > {0, 1}


def test_no_row_and_no_data_frame_without_a_window(spark):
    """A clip costs no data frame: what has nothing to tell yields nothing, and state is asked once."""
    from clipwright.streaming.frames import FrameWindows

    calls = []

    class State:
        def __init__(self, name):
            self.name, self.value = name, None

        def __getattr__(self, verb):
            def call(*args):
                calls.append(f"{self.name}.{verb}")
                return self.value if verb == "get" else None

            return call

    class Handle:
        def __getattr__(self, verb):
            return lambda *args: State(args[0]) if verb.startswith("get") else calls.append(verb)

    windows = FrameWindows(3, 2, 600.0, 10)
    windows.init(Handle())
    row = Row
    assert list(windows.handleInputRows((1,), iter([row(us=5000, event_id=1, latency=5.0)]), None)) == []
    assert calls == ["clip.get", "held.appendList", "registerTimer", "clip.update"]

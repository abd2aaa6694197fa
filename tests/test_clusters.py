"""Density clusters against all pairs of points, and groups that no task could hold."""

import uuid

import numpy as np
import pytest
from clipwright.operators import boxes as operators
from clipwright.operators.clusters import density_clusters, least_reachable
from clipwright.plans import boxes
from pyspark.sql import functions as F

SCHEMA = "key long, id long, x double, y double"


def density_labels(x: np.ndarray, y: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Density clusters of points, -1 for noise: a core has ``least`` points within ``eps``,
    itself included; clusters are numbered by their first core, and a point at the border
    goes to the first cluster that reaches it."""
    near = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= eps * eps
    core = near.sum(axis=1) >= least
    labels, number = np.full(len(x), -1), 0
    for first in np.flatnonzero(core):
        if labels[first] >= 0:
            continue
        found, front = np.zeros(len(x), bool), np.zeros(len(x), bool)
        found[first] = front[first] = True
        while front.any():
            front = near[front].any(axis=0) & ~found
            found |= front
            front &= core
        labels[found & (labels < 0)] = number
        number += 1
    return labels


def expected(rows, eps, least):
    out = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        x, y = (np.array([r[c] for r in mine]) for c in (2, 3))
        labels = density_labels(x, y, eps, least)
        near = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= eps * eps
        core = near.sum(axis=1) >= least
        for label in range(labels.max() + 1):
            # A cluster is named by its least core; its border may belong to another one.
            name = min(mine[i][1] for i in np.flatnonzero(core & (labels == label)))
            out |= {mine[i][1]: name for i in np.flatnonzero(labels == label)}
    return {r[1]: out.get(r[1]) for r in rows}


@pytest.mark.parametrize(("seed", "spread", "least"), [(1, 1.0, 3), (2, 0.3, 3), (3, 0.1, 5), (4, 3.0, 2)])
def test_clusters_equal_all_pairs(spark, seed, spread, least):
    r = np.random.default_rng(seed)
    rows = []
    for key in (1, 2):
        centres = r.random((5, 2))
        points = centres[r.integers(0, 5, 250)] + r.normal(size=(250, 2)) * 0.03 * spread
        points = np.concatenate([points, r.random((50, 2)), np.repeat(r.random((2, 2)), 20, axis=0)])
        rows += [(key, key * 1000 + i, float(x), float(y)) for i, (x, y) in enumerate(points[r.permutation(len(points))])]
    got = density_clusters(spark.createDataFrame(rows, SCHEMA), 0.05, least).collect()
    assert len(got) == len(rows)
    assert {x.id: x.cluster for x in got} == expected(rows, 0.05, least)


def test_dense_cells_that_just_touch_or_do_not(spark):
    """Two clouds whose nearest points lie just within eps, and two just beyond it."""
    r = np.random.default_rng(7)
    rows = []
    for key, gap in ((1, 0.0499999), (2, 0.0500001)):
        left = np.column_stack([0.5 - r.random(300) * 0.02, r.random(300) * 0.02])
        right = np.column_stack([0.5 + gap + r.random(300) * 0.02, r.random(300) * 0.02])
        ends = np.array([[0.5, 0.01], [0.5 + gap, 0.01]])
        rows += [(key, key * 10_000 + i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([ends, left, right]))]
    got = density_clusters(spark.createDataFrame(rows, SCHEMA), 0.05, 5)
    assert {r.key: r.n for r in got.groupBy("key").agg(F.countDistinct("cluster").alias("n")).collect()} == {1: 1, 2: 2}
    assert {x.id: x.cluster for x in got.collect()} == expected(rows, 0.05, 5)


def test_a_million_detections_of_one_clip(spark):
    """All pairs of them would be 10^12."""
    n = 1_000_000
    place = F.when(F.col("id") % 2 == 0, 0.2).otherwise(0.8)
    points = spark.range(n, numPartitions=8).select(F.lit(1).alias("key"), "id", (place + F.rand(1) * 0.1).alias("x"), (F.lit(0.5) + F.rand(2) * 0.1).alias("y"))
    got = density_clusters(points, 0.05, 5)
    assert {(r.cluster, r["count"]) for r in got.groupBy("cluster").count().collect()} == {(0, n // 2), (1, n // 2)}


def test_no_points_and_points_without_a_place(spark):
    assert density_clusters(spark.createDataFrame([], SCHEMA), 0.1, 2).count() == 0
    rows = [(1, 1, None, 0.5), (1, 2, 0.5, 0.5), (1, 3, 0.5, 0.5), (None, 4, 0.5, 0.5), (1, 5, 0.5, None)]
    got = density_clusters(spark.createDataFrame(rows, SCHEMA), 0.1, 2).collect()
    assert {x.id: x.cluster for x in got} == {1: None, 2: 2, 3: 2, 4: None, 5: None}


def test_least_reachable_on_a_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(900, 901), (5000, 5000)]
    got = {r.node: r.least for r in least_reachable(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 900: 900, 901: 900, 5000: 5000}


@pytest.mark.parametrize("whole", [0, 300, 1000])
def test_whole_keys_and_dealt_ones_equal_all_pairs(spark, whole):
    """Keys below, at and above the bound, in batches that cut them, with other columns kept."""
    r = np.random.default_rng(11)
    sizes = [1, 2, 40, 300, 301, 700]
    rows = []
    for key, n in enumerate(sizes):
        centres = r.random((4, 2))
        points = np.where(r.random((n, 1)) < 0.5, centres[r.integers(0, 4, n)] + r.normal(size=(n, 2)) * 0.02, r.random((n, 2)) * 2 - 1)
        rows += [(key, key * 1000 + i, float(x), float(y)) for i, (x, y) in enumerate(points)]
    points = spark.createDataFrame([rows[i] for i in r.permutation(len(rows))], SCHEMA).withColumn("other", F.concat(F.lit("p"), "id"))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = density_clusters(points, 0.05, 4, whole).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted((x.key, x.id, x.other) for x in got) == sorted((k, i, f"p{i}") for k, i, _, _ in rows)
    assert {x.id: x.cluster for x in got} == expected(rows, 0.05, 4)


def test_places_that_are_not_finite_are_noise(spark):
    rows = [(1, 1, float("nan"), 0.5), (1, 2, float("nan"), 0.5), (1, 3, float("inf"), 0.5), (1, 4, float("inf"), 0.5), (1, 5, 0.5, 0.5), (1, 6, 0.5, 0.5)]
    for whole in (0, 1000):
        got = density_clusters(spark.createDataFrame(rows, SCHEMA), 0.1, 2, whole).collect()
        assert {x.id: x.cluster for x in got} == {1: None, 2: None, 3: None, 4: None, 5: 5, 6: 5}


def jobs_of(spark, run):
    """Ids of the jobs that ``run`` starts, and of their stages, with tables as if too large to broadcast."""
    context, group, limit = spark.sparkContext, uuid.uuid4().hex, "spark.sql.autoBroadcastJoinThreshold"
    context.setJobGroup(group, "counted")
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        run()
    finally:
        spark.conf.set(limit, before)
        context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty()
    told = context.statusTracker()
    jobs = told.getJobIdsForGroup(group)
    return jobs, {s for j in jobs for s in told.getJobInfo(j).stageIds}


def shuffled_rows(spark, run):
    """Rows that all stages of ``run`` write into shuffles, by Spark's own status."""
    store = spark.sparkContext._jsc.sc().statusStore()
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in jobs_of(spark, run)[1])


@pytest.mark.parametrize(("keys", "most"), [(300, 3), (1, 25)])
def test_scattered_points_are_shuffled_a_few_times(spark, keys, most):
    """Points with few in any cell: once for keys that are few points, some times for a large
    one, where each had gone to 25 cells."""
    n = 18_000
    r = np.random.default_rng(3)
    wide = 9 / keys**0.5
    rows = [(int(i % keys), int(i), float(x), float(y)) for i, (x, y) in enumerate(r.random((n, 2)) * wide)]
    points = spark.createDataFrame(rows, SCHEMA)
    moved = shuffled_rows(spark, lambda: density_clusters(points, 0.05, 5).write.format("noop").mode("overwrite").save())
    assert moved < most * n


def test_clips_of_few_detections_take_few_jobs(spark, sf):
    """They are clustered where they lie, without rounds of joins."""
    run = lambda: boxes.webcam_region(spark, sf).write.format("noop").mode("overwrite").save()
    assert len(jobs_of(spark, run)[0]) <= 25


def copied(r, key, places, copies):
    """Rows of a key that lie on few places, some of them alone."""
    at = np.concatenate([r.random((places // 2, 2)) * 0.4, r.random((places - places // 2, 2)) * 3])
    which = np.concatenate([np.arange(places), r.integers(0, places - places // 4, copies)])
    return [(key, key * 100_000 + i, float(at[p][0]), float(at[p][1])) for i, p in enumerate(r.permutation(which))]


@pytest.mark.parametrize("whole", [0, 50, 100])
def test_equal_points_count_as_often_as_they_are(spark, whole):
    """Keys of few places and of many, above the bound by their copies or by their places."""
    r = np.random.default_rng(5)
    rows = [*copied(r, 1, 40, 500), *copied(r, 2, 90, 500), *copied(r, 3, 200, 500), *copied(r, 4, 60, 5)]
    for least in (4, 9):
        got = density_clusters(spark.createDataFrame(rows, SCHEMA), 0.05, least, whole).collect()
        assert len(got) == len(rows)
        assert {x.id: x.cluster for x in got} == expected(rows, 0.05, least)


def test_a_large_clip_of_few_places_takes_few_jobs(spark):
    """They are clustered in one task by their numbers, without rounds of joins over all points."""
    rows = copied(np.random.default_rng(6), 1, 120, 5000)
    points = spark.createDataFrame(rows, SCHEMA)
    run = lambda: density_clusters(points, 0.05, 5).write.format("noop").mode("overwrite").save()
    assert len(jobs_of(spark, run)[0]) <= 25


def test_two_boxes_count_only_where_a_clip_has_no_more(spark):
    """Two boxes of noise beside a cluster, or of five, are not a clip of two boxes; one is none."""
    at = {1: [0.1, 0.9], 2: [0.5, 0.5, 0.5, 0.1, 0.9], 3: [0.05, 0.25, 0.45, 0.65, 0.85], 4: [0.1], 5: [0.1] * 3 + [0.9, 0.8]}
    rows = [(clip, clip * 10 + i, x, x, 0.02, 0.02, len(xs)) for clip, xs in at.items() for i, x in enumerate(xs)]
    found = spark.createDataFrame(rows, "clip long, id long, xmin double, ymin double, width double, height double, n_sampled long")
    got = {r.clip: (r.n_in, round(r.xmin, 6)) for r in operators.stable_region(found, "clip", "id").collect()}
    assert got == {1: (2, 0.5), 2: (3, 0.5), 5: (3, 0.1)}


def test_two_events_without_a_user_are_a_clip(spark, sf, tmp_path):
    without = F.when(~F.col("event_id").isin(8, 16), F.col("user_id"))
    spark.read.parquet(f"{sf}/events.parquet").withColumn("user_id", without).write.parquet(f"{tmp_path}/events.parquet")
    assert [r.stability for r in boxes.webcam_region(spark, str(tmp_path)).filter("clip_id IS NULL").collect()] == [1.0]

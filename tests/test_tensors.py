"""Tensor files: round trips, ranges, rejects, broken jobs, hashes."""

import json
import urllib.parse
from pathlib import Path

import numpy as np
import pytest
from clipwright.sources import tensors as T
from pyspark.sql import functions as F

SCHEMA = "clip_id string, modality string, row long, values array<double>"


def read(spark, path, **options):
    return sorted((tuple(r) for r in T.read_tensors(spark, path, **options).collect()), key=repr)


def test_embeddings_and_keypoints_round_trip(spark, sf, tmp_path):
    path = f"file://{tmp_path}/cache"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("clip_id"), F.lit("text").alias("modality"), F.lit(0).alias("row"), F.col("embedding").cast("array<double>").alias("values"))
    T.write_tensors(e, path, dtype="float32", config_hash="c1")
    k = spark.read.parquet(f"{sf}/events.parquet").selectExpr("CAST(user_id AS STRING) AS clip_id", "'pose' AS modality", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row", "transform(sequence(0, 23), i -> value * i) AS values")
    T.write_tensors(k, path, tail="6,4")
    for want, modality, tail in ((e, "text", [64]), (k, "pose", [6, 4])):
        got = T.read_tensors(spark, path, modality=modality)
        assert got.filter("problem IS NOT NULL").count() == 0
        assert {tuple(r.shape[1:]) for r in got.select("shape").distinct().collect()} == {tuple(tail)}
        same = want.join(got.select("clip_id", "row", F.col("values").alias("back")), ["clip_id", "row"], "full").filter(~F.col("values").eqNullSafe(F.col("back")))
        assert same.count() == 0
    meta = T.read_meta(spark, path)
    assert meta.count() == e.count() + k.select("clip_id").distinct().count()
    assert {tuple(r) for r in T.widths(meta).collect()} == {("text", 64), ("pose", 4)}


def test_one_file_in_many_tasks(spark, tmp_path):
    big = np.random.default_rng(1).normal(size=(5000, 7))
    np.save(tmp_path / "a.b%20c.npy", big)
    np.save(tmp_path / "z.npy", np.arange(3, dtype="<i2"))
    df = T.read_tensors(spark, f"file://{tmp_path}", part_bytes=10_000)
    assert df.rdd.getNumPartitions() >= 28
    parts = df.filter("modality = 'b c'").withColumn("p", F.spark_partition_id()).orderBy("row").collect()
    assert len({r.p for r in parts}) >= 28 and [r.row for r in parts] == list(range(5000))
    assert np.array_equal(np.array([r["values"] for r in parts]), big)
    assert [(r.clip_id, r.modality, r["values"]) for r in df.filter("clip_id = 'z'").orderBy("row").collect()] == [("z", None, [float(i)]) for i in range(3)]


@pytest.mark.parametrize("part_bytes", [1, 50, 129, 1 << 20])
def test_every_row_once_whatever_the_ranges(tmp_path, part_bytes):
    np.save(tmp_path / "a.npy", np.arange(60).reshape(20, 3))
    np.save(tmp_path / "b.npy", np.asfortranarray(np.arange(60.0).reshape(5, 3, 4)))
    np.save(tmp_path / "c.npy", np.float64(4.5))
    np.save(tmp_path / "d.npy", np.zeros((0, 4)))
    np.save(tmp_path / "e.npy", np.zeros((4, 0)))
    reader = T.TensorReader({"path": f"file://{tmp_path}", "part_bytes": part_bytes})
    rows = {}
    for part in reader.partitions():
        for batch in reader.read(part):
            for r in batch.to_pylist():
                assert r["problem"] is None and (r["clip_id"], r["row"]) not in rows
                rows[r["clip_id"], r["row"]] = r["values"]
    assert [rows["a", i] for i in range(20)] == np.arange(60.0).reshape(20, 3).tolist()
    assert [rows["b", i] for i in range(5)] == np.arange(60.0).reshape(5, 12).tolist()
    assert rows["c", 0] == [4.5] and [rows["e", i] for i in range(4)] == [[]] * 4 and len(rows) == 30


def test_what_cannot_be_read_is_a_row(spark, tmp_path):
    np.save(tmp_path / "ok.audio.npy", np.ones((4, 2)))
    whole = (tmp_path / "ok.audio.npy").read_bytes()
    (tmp_path / "short.audio.npy").write_bytes(whole[:-1])
    (tmp_path / "empty.audio.npy").write_bytes(b"")
    (tmp_path / "text.audio.npy").write_bytes(b"not an array, " * 40)
    (tmp_path / "head.audio.npy").write_bytes(whole[:40])
    np.save(tmp_path / "object.audio.npy", np.array([{"a": 1}], dtype=object), allow_pickle=True)
    np.save(tmp_path / "names.audio.npy", np.array(["x", "y"]))
    for part_bytes in (60, 1 << 20):
        rows = T.read_tensors(spark, f"file://{tmp_path}", part_bytes=part_bytes).collect()
        bad = sorted(r.clip_id for r in rows if r.problem)
        assert bad == ["empty", "head", "names", "object", "short", "text"]
        assert [r["values"] for r in rows if not r.problem] == [[1.0, 1.0]] * 4
    assert T.read_tensors(spark, f"file://{tmp_path}/nowhere").count() == 0


def test_a_broken_job_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    T.write_tensors(spark.createDataFrame([("a", "m", 0, [1.0])], SCHEMA), path)
    before = read(spark, path)
    for rows in ([("b", "m", 0, [1.0]), ("b", "m", 2, [1.0])], [("b", "m", 0, [1.0]), ("b", "m", 0, [1.0])], [("b", "m", 0, [1.0]), ("b", "m", 1, [1.0, 2.0])], [("b", "m", 0, [None])]):
        with pytest.raises(Exception, match="b"):
            T.write_tensors(spark.createDataFrame([("a", "m", 0, [5.0]), *rows], SCHEMA), path)
        assert read(spark, path) == before
        assert not list(Path(tmp_path, "cache", "_staging").iterdir())
    T.write_tensors(spark.createDataFrame([], SCHEMA), path)
    assert read(spark, path) == before


def test_present_tensors_are_skipped_by_hash(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    clips = spark.createDataFrame([("a", "m", "h1"), ("b/é.x", "m", "h1"), ("c", "m", None)], "clip_id string, modality string, clip_hash string")
    rows = lambda df, v: df.selectExpr("clip_id", "modality", "explode(sequence(0, 1)) AS row", f"array({v}D, 2D) AS values", "clip_hash")
    assert T.to_compute(clips, path, "c1").count() == 3
    T.write_tensors(rows(clips, 1), path, config_hash="c1")
    assert T.to_compute(clips, path, "c1").count() == 0 and T.to_compute(clips, path, "c2").count() == 3
    changed = clips.withColumn("clip_hash", F.when(F.col("clip_id") == "a", "h2").otherwise(F.col("clip_hash")))
    left = T.to_compute(changed, path, "c1")
    assert [r.clip_id for r in left.collect()] == ["a"]
    T.write_tensors(rows(left, 7), path, config_hash="c1")
    assert {(r.clip_id, r["values"][0]) for r in T.read_tensors(spark, path).collect()} == {("a", 7.0), ("b/é.x", 1.0), ("c", 1.0)}
    assert T.to_compute(changed, path, "c1").count() == 0
    T.write_tensors(rows(clips.limit(1), 9), path, mode="overwrite")
    assert len(read(spark, path)) == 2
    line = json.loads(next(Path(tmp_path, "cache").glob("*/*/meta.jsonl")).read_text().splitlines()[0])
    assert line["shape"] == [2, 2] and len(line["sha256"]) == 64 and urllib.parse.unquote(line["file"]) == f"{line['clip_id']}.m.npy"


def test_small_ranges_do_not_make_a_task_each(tmp_path):
    for i in range(30):
        np.save(tmp_path / f"{i}.npy", np.arange(600.0).reshape(200, 3) + i)
    reader = T.TensorReader({"path": f"file://{tmp_path}", "part_bytes": 64})
    parts = reader.partitions()
    assert len(parts) <= T.TASKS + 1
    rows = [(r["clip_id"], r["row"], r["values"][0]) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(rows) == sorted((str(i), k, 3.0 * k + i) for i in range(30) for k in range(200))
    assert len(T.cut([("a", 10 * T.PART_BYTES * T.TASKS)], T.PART_BYTES)) == 10 * T.TASKS

"""Nulls, ties, empty tables and values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from clipwright.functions import labels as L
from clipwright.functions import text as T
from clipwright.operators import metrics as M
from clipwright.operators import splits as S
from clipwright.operators.running import running
from clipwright.sources import files as R
from clipwright.sources import sinks as W


def test_prefix_sums_of_groups_that_fill_many_ranges(spark):
    rows = [(g, i, 1 + i % 3) for g in ("a", None) for i in range(200)] + [("b", 0, 7)]
    df = spark.createDataFrame(rows, "g string, i int, x long")
    got = {(r.g, r.i): (r.x_before, r.x_all) for r in running(df, ["g"], [F.col("i")], {"x": F.col("x")}).collect()}
    for g, i, _ in rows:
        own = [x for h, j, x in rows if h == g]
        assert got[(g, i)] == (sum(x for h, j, x in rows if h == g and j < i), sum(own))
    assert running(df.limit(0), ["g"], [F.col("i")], {"x": F.col("x")}).count() == 0


def test_ranks_with_ties_and_areas(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, False), (0.8, True), (0.3, False), (0.1, False)], "score double, positive boolean").withColumn("class", F.lit(0))
    assert round(M.roc_auc(df, "class").first().roc_auc, 6) == 0.916667
    assert round(M.average_precision(df, "class").first().average_precision, 6) == 0.833333
    ranked = M.average_rank(df, "score").collect()
    assert sorted(r.score_rank for r in ranked) == [1.0, 2.0, 3.5, 3.5, 5.0]


@pytest.mark.parametrize(("n", "sizes"), [(10, [7, 1, 1, 1]), (20, [14, 3, 2, 1]), (37, [25, 5, 3, 4])])
def test_split_sizes(spark, n, sizes):
    names = ["train", "val", "test", "ood"]
    got = S.proportional(spark.range(n), [S.seeded("id", 1), F.col("id")], names, [0.7, 0.15, 0.1, 0.05]).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == dict(zip(names, sizes, strict=True))


def test_weights_of_absent_classes(spark):
    rows = spark.createDataFrame([(x,) for x in [0, 0, 0, 1, 1, 2]], "label int")
    got = {r["class"]: round(r.weight, 6) for r in M.class_weights(rows, 3, "effective_number").collect()}
    assert got == {0: 0.611426, 1: 0.843026, 2: 1.545548}
    beta, raw = 2 / 3, [1 / 3 / (1 - (2 / 3) ** n) for n in (3, 1, 1)]
    absent = M.class_weights(spark.createDataFrame([(0,)] * 3, "label int"), 3, "effective_number").orderBy("class").collect()
    assert [round(r.weight, 6) for r in absent] == [round(x * 3 / sum(raw), 6) for x in raw] and beta < 1


def test_documents_of_one_file_each(spark, tmp_path):
    whole = {"clip_id": "x", "emotion_label": "hype", "genre": "moba", "face_aus": {"AU6": 3.5}, "peak_frame_idx": 10, "visual_objective_desc": "", "audio_tone_desc": "", "transcript": "GG", "reasoning": "", "annotators": [], "created_at": "2024-01-01T00:00:00Z", "more": 1}
    (tmp_path / "old_clip.json").write_text(json.dumps(whole, indent=1))
    (tmp_path / "bad_box.json").write_text(json.dumps(whole | {"webcam_bbox": {"xmin": -0.1, "ymin": 0, "width": 1, "height": 1, "stability_score": 1}}))
    (tmp_path / "broken.json").write_text('{"clip_id": ')
    (tmp_path / "short.json").write_text(json.dumps({k: v for k, v in whole.items() if k != "transcript"}))
    got = {r.clip_id: r for r in R.read_annotations(spark, str(tmp_path), documents=True).collect()}
    assert {k: r.problems for k, r in got.items()} == {"old_clip": [], "bad_box": ["webcam_bbox"], "broken": ["corrupt"], "short": ["no transcript"]}
    assert (got["old_clip"].source_language, got["old_clip"].language_mismatch) == ("vi", False)


def test_readers_that_refuse(spark, tmp_path):
    (tmp_path / "labels.json").write_text('{"id": 1}')
    with pytest.raises(Exception, match="expected a JSON array"):
        R.read_label_array(spark, str(tmp_path / "labels.json")).collect()
    (tmp_path / "labels.csv").write_text("clip,label\na,b\n")
    with pytest.raises(ValueError, match="clip_id"):
        R.read_labels_csv(spark, str(tmp_path / "labels.csv"))
    with pytest.raises(ValueError, match="merge mode"):
        L.indices("other")
    found = spark.createDataFrame([("a", "p")], "clip_id string, path string")
    with pytest.raises(Exception, match="video not found for b"):
        R.require(spark.createDataFrame([("b",)], "clip_id string"), found, "clip_id", "video").collect()


def test_appends_skip_what_is_there(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    assert [W.append_new(rows.limit(0), path, "id"), W.append_new(rows.filter("id = 1"), path, "id"), W.append_new(rows, path, "id"), W.append_new(rows, path, "id")] == [0, 1, 1, 0]


def test_parser_branches(spark):
    rows = [(1, "Cues: face: eyes=wide. Emotion: hype.", "(face: eyes=wide, hype, True)"), (2, "<think>AU12 cao</think><answer>amused</answer>", "(AU12 cao, amused, True)"), (3, "some random text", "(some random text, neutral, False)"), (4, "<think>only thought</think>", "(only thought, neutral, False)"), (5, "cues: a. emotion: b", "(cues: a. emotion: b, neutral, False)")]
    got = spark.createDataFrame(rows, "id int, raw string, want string").select("want", T.output_parts(F.col("raw"), F.lit("neutral")).alias("x")).collect()
    assert all(f"({r.x.reasoning}, {r.x.answer}, {r.x.valid})" == r.want for r in got)


def test_a_distribution_with_what_is_no_number_counts_as_none(spark):
    told = ['{"hype": 1, "sad": 3}', '{"hype": 1, "sad": "x"}', '{"hype": 1, "odd": null}', '{"hype": "2"}', "{broken}"]
    rows = spark.createDataFrame([(i, f"<answer>sad</answer><distribution>{t}</distribution>") for i, t in enumerate(told)], "i int, raw string")
    got = [r.d for r in rows.orderBy("i").select(T.consolidated(F.col("raw"), F.lit("neutral"))["distribution"].alias("d")).collect()]
    assert got == [{"hype": 0.25, "sad": 0.75}, {}, {}, {"hype": 1.0}, {}]

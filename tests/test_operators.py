"""Early-terminated sampling, folds trained together, file pruning, zips, better-than sinks."""

import json

import numpy as np
import pytest
from clipwright.functions import arrays as A
from clipwright.operators.classify import fold_accuracy, fold_models, stratified
from clipwright.operators.sampling import first_fitting
from clipwright.operators.series import peak_by
from clipwright.operators.splits import positional_zip
from clipwright.sources.files import read_split
from clipwright.sources.sinks import write_if_better
from pyspark.sql import functions as F


@pytest.mark.parametrize("parts", [1, 7, 64, 10_000])
def test_first_fitting_equals_sorting_all(spark, parts):
    rows = spark.range(5000).selectExpr("id * 7919 % 10007 AS k", "id % 3 AS t", "id")
    rows = rows.unionByName(rows.limit(40)).unionByName(spark.createDataFrame([(None, 0, -1)], rows.schema))
    for fits, n in (("id % 5 = 0", 30), ("id % 400 = 1", 30), ("id < 0", 5), ("id >= 0", 0)):
        want = rows.filter(fits).filter("k IS NOT NULL").orderBy("k", "t", "id").limit(n).collect()
        assert first_fitting(rows, "k", F.expr(fits), n, "t", "id", parts=parts).collect() == want


def test_first_fitting_leaves_the_rest_unread(spark):
    seen = spark.sparkContext.accumulator(0)

    def work(part):
        @F.udf("boolean")
        def costly(k):
            seen.add(1)
            return k % 2 == 0

        return part.filter(costly("id"))

    assert [r.id for r in first_fitting(spark.range(100_000), "id", work, 10).collect()] == list(range(0, 20, 2))
    assert seen.value < 10_000
    assert first_fitting(spark.range(0), "id", work, 10).count() == 0


def newton(x, y, c=1.0):
    x = np.hstack([x, np.ones((len(x), 1))])
    w, free = np.zeros(x.shape[1]), np.diag([1.0] * (x.shape[1] - 1) + [0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve(c * (x * (p * (1 - p))[:, None]).T @ x + free, c * x.T @ (p - y) + free @ w)
    return w


def test_folds_trained_together_equal_numpy(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 5))
    y = (x @ [1, -2, 0.5, 0, 1] + r.normal(size=300) > 0.8).astype(float)
    rows = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "k long, v array<double>, label double")
    dealt = stratified(rows, "k", "label", 4, 1).cache()
    weights = fold_models(dealt, 4, 5)
    fold = {q.k: q.fold for q in dealt.collect()}
    of = np.array([fold[i] for i in range(300)])
    for k in range(4):
        assert np.allclose(weights[k], newton(x[of != k], y[of != k]), atol=1e-6)
        assert abs(y[of == k].mean() - y.mean()) < 0.02
    told = {q.fold: (q.n, q.hits) for q in fold_accuracy(rows, "k", 4, 1).collect()}
    for k in range(4):
        mine = of == k
        hits = ((np.hstack([x[mine], np.ones((mine.sum(), 1))]) @ weights[k] > 0) == (y[mine] == 1)).sum()
        assert told[k] == (mine.sum(), hits)


def test_too_little_to_train_on(spark):
    schema = "k long, v array<double>, label double"
    assert fold_accuracy(spark.createDataFrame([], schema), "k").count() == 0
    assert fold_accuracy(spark.createDataFrame([(i, [1.0], 1.0) for i in range(20)], schema), "k").count() == 0
    rows = [(i, [float(i)], float(i > 18)) for i in range(20)] + [(90, None, 1.0), (91, [1.0], None)]
    assert fold_accuracy(spark.createDataFrame(rows, schema), "k").agg(F.sum("n")).first()[0] == 20


def test_files_of_another_split_are_not_opened(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"clip_{i}.json").write_text(json.dumps({"label": i}) if i % 3 else "{broken")
    manifest = spark.createDataFrame([(f"clip_{i}", "train" if i % 3 else "val") for i in range(11)] + [("clip_77", "train")], "clip_id string, split string")
    df = read_split(spark, str(tmp_path), manifest, "train", "label int")
    assert sorted((r.clip_id, r.label) for r in df.collect()) == sorted((f"clip_{i}", i) for i in range(12) if i % 3 and i < 11)
    assert "file_name" in df._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match=r"MALFORMED|Malformed|malformed"):
        read_split(spark, str(tmp_path), manifest, "val", "label int").collect()
    assert read_split(spark, str(tmp_path), manifest, "none", "label int").count() == 0


def test_zip_with_lengths(spark):
    left, right = spark.createDataFrame([(1, 5), (1, 6)], "k int, a int"), spark.createDataFrame([(1, 9)], "k int, b int")
    assert positional_zip(left, right, "a", "b", "k").count() == 2
    with pytest.raises(Exception, match="different length"):
        positional_zip(left, right, "a", "b", "k", strict=True).collect()
    assert positional_zip(left.limit(1), right, "a", "b", "k", strict=True).count() == 1


def test_unknown_peak_methods_are_rejected(spark):
    rows = spark.createDataFrame([(1, i, float(i % 3)) for i in range(7)], "clip_id int, k int, v double")
    assert tuple(peak_by(rows, "clip_id", "k", "v", "max_au_intensity").first()) == (1, 2, 2.0)
    assert tuple(peak_by(rows, "clip_id", "k", "v", "middle").first()) == (1, 3, 0.0)
    with pytest.raises(ValueError, match="unknown method"):
        peak_by(rows, "clip_id", "k", "v", "loudest")


def test_only_better_results_are_written(spark, tmp_path):
    path = str(tmp_path / "wrong")
    rows = lambda *p: spark.createDataFrame([(i, 1, x) for i, x in enumerate(p)], "k int, y_true int, y_pred int")
    best = write_if_better(rows(1, 0), path, -1.0)
    assert best == 0.5 and write_if_better(rows(0, 0), path, best) == 0.5
    assert [r.k for r in spark.read.json(path).collect()] == [1]
    assert write_if_better(rows(1, 1, 0), path, best) == pytest.approx(2 / 3)
    assert [r.k for r in spark.read.json(path).collect()] == [2]


def test_softmax_does_not_recompute_for_each_element(spark):
    n = 400
    row = spark.range(1).select(F.array(*[F.col("id") + i / n for i in range(n)]).alias("v"))
    v = np.arange(n) / n
    e = np.exp(v - v.max())
    assert np.allclose(row.select(A.softmax(F.col("v"))).first()[0], e / e.sum())
    assert np.allclose(row.select(A.log_softmax(F.col("v"))).first()[0], np.log(e / e.sum()))
    present = F.transform(F.col("v"), lambda x: x >= 0.5)
    kept = np.where(v >= 0.5, e, 0)
    assert np.allclose(row.select(A.masked_softmax(F.col("v"), present)).first()[0], kept / kept.sum())
    assert spark.range(1).select(A.softmax(F.expr("CAST(NULL AS array<double>)"))).first()[0] is None

"""Logistic regression on all folds at once.

Each Newton step is one pass: tasks add up gradient and Hessian of every fold's model over
their rows as matrix products, Spark adds these up by entry, and what reaches the driver is
one number for each fold and entry, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipwright.operators.running import running
from clipwright.operators.splits import seeded
from clipwright.sources.tables import stored

STEPS, SETTLED = 50, 1e-10


def stratified(rows: DataFrame, key: str, label: str, folds: int, seed: int) -> DataFrame:
    """Adds ``fold``: rows of each label are dealt out in turn, in a seeded order."""
    placed = running(rows, [label], [seeded(key, seed), F.col(key)], {"place": F.lit(1)})
    return placed.select(*rows.columns, (F.col("place_before") % folds).cast("int").alias("fold"))


def _matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column(0)
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
    return np.hstack([x, np.ones((len(x), 1))]), batch.column(1).to_numpy(), batch.column(2).to_numpy()


def _chance(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x @ weights.T, -500, 500)))


def fold_models(rows: DataFrame, folds: int, width: int, c: float = 1.0, steps: int = STEPS) -> np.ndarray:
    """Weights (fold, width + 1) of models that each learn from all folds but their own.

    ``rows (v array<double>, label double of 0 and 1, fold int)``; half the squared weights
    are added to ``c`` times the losses, the intercept, which is last, goes free.
    """
    entries = width + 1
    free = np.diag([1.0] * width + [0.0])

    def sums(weights: np.ndarray) -> np.ndarray:
        def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((folds, entries + 1, entries))
            for batch in batches:
                if not len(batch):
                    continue
                x, label, fold = _matrices(batch)
                p = _chance(x, weights)
                for k in range(folds):
                    mine = fold != k
                    xk, pk = x[mine], p[mine, k]
                    total[k, 0] += xk.T @ (pk - label[mine])
                    total[k, 1:] += (xk * (pk * (1 - pk))[:, None]).T @ xk
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], ["entry", "s"])

        # folds * (width + 1) * (width + 2) entries: a fixed bound.
        added = rows.select("v", "label", "fold").mapInArrow(each, "entry long, s double").groupBy("entry").agg(F.sum("s").alias("s"))
        out = np.zeros(folds * (entries + 1) * entries)
        for r in added.toLocalIterator():
            out[r.entry] = r.s
        return out.reshape(folds, entries + 1, entries)

    weights = np.zeros((folds, entries))
    for _ in range(steps):
        total = sums(weights)
        # A fold without rows of both labels has a flat intercept: a trace of ridge keeps it solvable.
        step = np.stack([np.linalg.solve(c * t[1:] + free + 1e-12 * np.eye(entries), c * t[0] + free @ w) for t, w in zip(total, weights, strict=True)])
        weights = weights - step
        if np.abs(step).max() < SETTLED:
            break
    return weights


def fold_accuracy(rows: DataFrame, key: str, most_folds: int = 5, seed: int = 42, c: float = 1.0) -> DataFrame:
    """``(fold, n, hits)`` of logistic regressions on ``rows (key, v, label)``, each fold told by a
    model of the others. Folds are stratified: ``most_folds``, or the rows of the rarer label
    if that are fewer, two at least. With one label, or ten rows or fewer, there is no row.
    Rows without a vector or label are left out.
    """
    usable = rows.filter(F.col("v").isNotNull() & F.col("label").isNotNull()).select(key, "v", F.col("label").cast("double").alias("label"))
    sizes = {r.label: r["count"] for r in usable.groupBy("label").count().limit(3).collect()}
    spark = rows.sparkSession
    if len(sizes) != 2 or sum(sizes.values()) <= 10:
        return spark.createDataFrame([], "fold int, n long, hits long")
    folds = max(2, min(most_folds, int(min(sizes.values()))))
    width = usable.select(F.size("v")).first()[0]
    dealt = stored(stratified(usable, key, "label", folds, seed), "folds")
    weights = fold_models(dealt, folds, width, c)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, label, fold = _matrices(batch)
                told = (x * weights[fold]).sum(axis=1) > 0
                yield pa.RecordBatch.from_arrays([pa.array(fold, pa.int32()), pa.array((told == (label == 1)).astype(np.int64))], ["fold", "hit"])

    hits = dealt.select("v", "label", "fold").mapInArrow(each, "fold int, hit long")
    return hits.groupBy("fold").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))

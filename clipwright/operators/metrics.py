"""Classification evaluation as group-bys over ``(y_true, y_pred)`` and a class dimension.

Counts are combined on the map side before they meet the (small) class dimension, so the
only shuffle carries one row for each class pair and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipwright.operators.running import running


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 (the usual zero_division=0)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classes(predictions: DataFrame, n_classes: int, *by: str) -> DataFrame:
    """Every class of every group. ``n_classes`` rows for each group: a fixed bound."""
    dim = predictions.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("class"))
    if not by:
        return dim
    return predictions.select(*by).distinct().crossJoin(F.broadcast(dim))


def confusion_matrix(predictions: DataFrame, n_classes: int, *by: str) -> DataFrame:
    """``(*by, y_true, y_pred, n)`` with zero cells."""
    counts = predictions.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))
    rows = classes(predictions, n_classes, *by).withColumnRenamed("class", "y_true")
    cols = predictions.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("y_pred"))
    grid = rows.crossJoin(F.broadcast(cols))
    return grid.join(counts, [*by, "y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def per_class(predictions: DataFrame, n_classes: int, *by: str, present_only: bool = False) -> DataFrame:
    """``(*by, class, tp, n_true, n_pred, precision, recall, f1)`` for all classes, or only
    for those that occur as truth or prediction."""
    return per_class_of(predictions.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n")), n_classes, *by, present_only=present_only)


def per_class_of(pairs: DataFrame, n_classes: int, *by: str, present_only: bool = False) -> DataFrame:
    """The same from counts ``(*by, y_true, y_pred, n)``."""
    sides = pairs.select(*by, F.explode(F.array(
        F.struct(F.col("y_true").alias("class"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("c")),
        F.struct(F.col("y_pred").alias("class"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("c")),
    )).alias("x")).select(*by, "x.*")
    sums = sides.groupBy(*by, "class").agg(F.sum("c").alias("tp"), F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"))
    if not present_only:
        sums = classes(pairs, n_classes, *by).join(sums, [*by, "class"], "left").fillna(0, ["tp", "n_true", "n_pred"])
    sums = sums.withColumns({"precision": ratio(F.col("tp"), F.col("n_pred")), "recall": ratio(F.col("tp"), F.col("n_true"))})
    return sums.withColumn("f1", ratio(2 * F.col("tp"), F.col("n_true") + F.col("n_pred")))


def summary(predictions: DataFrame, n_classes: int, *by: str, present_only: bool = False) -> DataFrame:
    """``(*by, n_samples, accuracy, macro_f1, weighted_f1, uar)``."""
    each = per_class(predictions, n_classes, *by, present_only=present_only)
    total = F.sum("n_true")
    return each.groupBy(*by).agg(
        total.alias("n_samples"),
        ratio(F.sum("tp"), total).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        ratio(F.sum(F.col("f1") * F.col("n_true")), total).alias("weighted_f1"),
        F.avg("recall").alias("uar"),
    )


def kappa(pairs: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Cohen's kappa of two label columns; 0 where chance agreement is total."""
    counts = pairs.groupBy(*by, a, b).agg(F.count("*").alias("n"))
    marginal = lambda c: counts.groupBy(*by, F.col(c).alias("v")).agg(F.sum("n").alias(f"n_{c}"))
    chance = marginal(a).join(marginal(b), [*by, "v"]).groupBy(*by).agg(F.sum(F.col(f"n_{a}").cast("double") * F.col(f"n_{b}")).alias("pe"))
    seen = counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("agreed"))
    both = seen.join(chance, list(by), "left") if by else seen.crossJoin(F.broadcast(chance))
    po, pe = F.col("agreed") / F.col("n"), F.coalesce("pe", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return both.select(*by, "n", po.alias("agreement"), ratio(po - pe, 1 - pe).alias("kappa"))


def score_steps(scored: DataFrame, *by: str) -> DataFrame:
    """Positives and negatives at each distinct score, and sums over all higher scores.

    ``scored``: ``(*by, score, positive boolean)``. Ties are one step, so the sums run
    over distinct scores and not over rows.
    """
    steps = scored.groupBy(*by, "score").agg(F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg"))
    summed = running(steps, list(by), [F.desc("score")], {"p": F.col("pos"), "f": F.col("neg")})
    return summed.select(*by, "score", "pos", "neg", F.col("p_before").alias("tp_above"), F.col("f_before").alias("fp_above"), F.col("p_all").alias("all_pos"), F.col("f_all").alias("all_neg"))


def roc_auc(scored: DataFrame, *by: str) -> DataFrame:
    """Rank-sum area with ties counted half."""
    area = F.col("neg") * (F.col("tp_above") + 0.5 * F.col("pos"))
    return score_steps(scored, *by).groupBy(*by).agg(F.try_divide(F.sum(area), F.max("all_pos").cast("double") * F.max("all_neg")).alias("roc_auc"))


def average_precision(scored: DataFrame, *by: str) -> DataFrame:
    """Sum over thresholds of recall gained times precision."""
    hit, all_ = F.col("tp_above") + F.col("pos"), F.col("tp_above") + F.col("pos") + F.col("fp_above") + F.col("neg")
    return score_steps(scored, *by).groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * hit / all_), F.max("all_pos").cast("double")).alias("average_precision"))


def class_weights(labels: DataFrame, n_classes: int, method: str) -> DataFrame:
    """``(class, n, weight)`` with weights of mean one; absent classes count as one row."""
    counts = labels.groupBy(F.col("label").cast("int").alias("class")).agg(F.count("*").alias("n"))
    dim = classes(labels, n_classes).join(counts, "class", "left").fillna(0, ["n"])
    # The window is over n_classes rows.
    n, everything = F.greatest(F.col("n"), F.lit(1)).cast("double"), Window.partitionBy()
    total = F.sum("n").over(everything)
    if method == "inverse_freq":
        raw = 1.0 / n
    elif method == "effective_number":
        beta = (total - 1) / total
        raw = (1 - beta) / F.greatest(1 - F.pow(beta, n), F.lit(1e-8))
    else:
        raise ValueError(f"unknown method {method!r}")
    return dim.withColumn("raw", raw).select("class", "n", (F.col("raw") / F.avg("raw").over(everything)).alias("weight"))


def average_rank(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """Adds ``<column>_rank``: ranks with ties averaged. Distinct values are ranked, by
    prefix sums of how often they occur; the ranks are joined on."""
    counts = rows.groupBy(*by, column).agg(F.count("*").alias("_ties"))
    ranked = running(counts, list(by), [F.asc(column)], {"_n": F.col("_ties")})
    rank = F.col("_n_before") + (F.col("_ties") + 1) / 2.0
    return rows.join(ranked.select(*by, column, rank.alias(f"{column}_rank")), [*by, column])

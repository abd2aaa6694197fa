"""A whole evaluation report from one table of counts.

Predictions are counted once by (truth, prediction) and facets such as the language; every
section of the report is a regrouping of that small table, so the rows are scanned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipwright.operators import metrics as M
from clipwright.sources.tables import stored

REPORT = ["section", "position", "name", "measure", "value"]


def counted(predictions: DataFrame, *facets: str) -> DataFrame:
    """``(y_true, y_pred, *facets, n)``, written once: one row for each combination that occurs."""
    return stored(predictions.groupBy("y_true", "y_pred", *facets).agg(F.count("*").alias("n")), "counts")


def _long(rows: DataFrame, section: str, position: Column, name: Column, measures: dict[str, Column]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), c.cast("double").alias("value")) for m, c in measures.items()])
    return rows.select(F.lit(section).alias("section"), position.cast("int").alias("position"), name.alias("name"), F.explode(pairs).alias("x")).select("section", "position", "name", "x.*")


def report(cells: DataFrame, n_classes: int, rare: list[int], gap: tuple[str, str], fragmentation: DataFrame | None = None) -> DataFrame:
    """``(section, position, name, measure, value)``: classes by f1, the five most frequent
    confusions, errors, languages, rare classes, and what is advised.

    ``cells (y_true, y_pred, lang, n)`` is a table of ``counted``; ``gap`` names the two
    languages that are compared; ``fragmentation (silhouette, accuracy)``, one row, tells how
    far embeddings part by language. No cells give the advice that the metrics of none give.
    """
    pairs = cells.groupBy("y_true", "y_pred").agg(F.sum("n").alias("n"))
    each = M.per_class_of(pairs, n_classes)
    # Windows are over one row for each class, pair or language.
    by_f1 = F.row_number().over(Window.orderBy("f1", "class"))
    name = lambda c: F.col(c).cast("string")
    ranked = each.withColumn("position", by_f1)
    classes = _long(ranked, "class", F.col("position"), name("class"), {"precision": F.col("precision"), "recall": F.col("recall"), "f1": F.col("f1"), "support": F.col("n_true")})

    rated = pairs.withColumn("rate", M.ratio(F.col("n"), F.sum("n").over(Window.partitionBy("y_true")))).filter("y_true <> y_pred")
    rated = rated.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "y_true", "y_pred")))
    pair = F.concat_ws(">", name("y_true"), name("y_pred"))
    confusions = _long(rated.filter("position <= 5"), "confusion", F.col("position"), pair, {"count": F.col("n"), "rate": F.col("rate")})

    wrong = F.sum(F.when(F.col("y_true") != F.col("y_pred"), F.col("n")).otherwise(0))
    errors = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(wrong, F.lit(0)).alias("wrong"))
    misses = _long(errors, "errors", F.lit(1), F.lit("all"), {"n": F.col("n"), "errors": F.col("wrong"), "rate": M.ratio(F.col("wrong"), F.col("n"))})

    spoken = cells.groupBy("lang", "y_true", "y_pred").agg(F.sum("n").alias("n"))
    told = M.per_class_of(spoken, n_classes, "lang", present_only=True).groupBy("lang").agg(F.sum("n_true").alias("n"), F.avg("f1").alias("macro_f1"), F.avg("recall").alias("uar"))
    languages = _long(told.withColumn("position", F.row_number().over(Window.orderBy("lang"))), "language", F.col("position"), F.col("lang"), {"n": F.col("n"), "macro_f1": F.col("macro_f1"), "uar": F.col("uar")})

    is_rare = F.col("y_true").isin(rare)
    held = cells.filter(is_rare).groupBy("y_true", "lang").agg(F.sum("n").alias("n"))
    in_languages = held.select(F.lit("rare").alias("section"), F.lit(0).alias("position"), name("y_true").alias("name"), F.concat(F.lit("in "), "lang").alias("measure"), F.col("n").cast("double").alias("value"))
    taken = rated.filter(is_rare).withColumn("k", F.row_number().over(Window.partitionBy("y_true").orderBy(F.desc("n"), "y_pred"))).filter("k <= 3")
    as_others = taken.select(F.lit("rare").alias("section"), F.col("k").cast("int").alias("position"), name("y_true").alias("name"), F.concat(F.lit("as "), name("y_pred")).alias("measure"), F.col("n").cast("double").alias("value"))

    advice = _advice(each, rated, told, rare, gap, fragmentation)
    return classes.unionByName(confusions).unionByName(misses).unionByName(languages).unionByName(in_languages).unionByName(as_others).unionByName(advice)


def _advice(each: DataFrame, rated: DataFrame, told: DataFrame, rare: list[int], gap: tuple[str, str], fragmentation: DataFrame | None) -> DataFrame:
    """Rules in their order; ``measure`` says what a rule is about. If none holds, that is the advice."""
    some = F.col("n_true") > 0
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.col("class")))), lambda x: x.cast("string")), ",")
    seen = each.agg(
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"), listed(some & (F.col("f1") < 0.2)).alias("weak"), listed(some & (F.col("recall") == 0)).alias("never"),
        F.array_sort(F.collect_list(F.when(some & F.col("class").isin(rare) & (F.col("f1") < 0.15), F.struct("class", "f1")))).alias("rare"),
        M.ratio(F.max("n_true"), F.min(F.when(some, F.col("n_true")))).alias("imbalance"),
    )
    first = rated.agg(F.min_by(F.struct(F.concat_ws(">", F.col("y_true").cast("string"), F.col("y_pred").cast("string")).alias("pair"), "rate"), "position").alias("top"))
    between = told.agg(*[F.max(F.when(F.col("lang") == x, F.col("macro_f1"))).alias(k) for x, k in zip(gap, ("one", "other"), strict=True)])
    parted = fragmentation if fragmentation is not None else each.sparkSession.createDataFrame([(None, None)], "silhouette double, accuracy double")
    # Each side is one row.
    row = seen.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(between)).crossJoin(F.broadcast(parted.select("silhouette", "accuracy")))
    f1, apart, none = F.col("macro_f1"), F.col("one") - F.col("other"), F.lit("")
    rule = lambda k, held, name, measure, value: F.when(held, F.array(F.struct(F.lit(k).alias("position"), F.lit(name).alias("name"), measure.alias("measure"), value.cast("double").alias("value"))))
    of_rare = F.transform("rare", lambda x: F.struct(F.lit(4).alias("position"), F.lit("rare_class").alias("name"), x["class"].cast("string").alias("measure"), x["f1"].alias("value")))
    rules = [
        rule(1, f1 < 0.3, "macro_f1_critical", none, f1),
        rule(1, (f1 >= 0.3) & (f1 < 0.5), "macro_f1_low", none, f1),
        rule(2, F.col("weak") != "", "weak_classes", F.col("weak"), F.lit(None)),
        rule(3, F.col("never") != "", "never_predicted", F.col("never"), F.lit(None)),
        of_rare,
        rule(5, F.col("top.rate") > 0.3, "confusion", F.col("top.pair"), F.col("top.rate")),
        rule(6, apart < -0.05, "language_gap", F.lit(gap[0]), -apart),
        rule(6, apart > 0.1, "language_gap", F.lit(gap[1]), apart),
        rule(7, (F.col("silhouette") > 0.2) | (F.col("accuracy") > 0.8), "fragmentation", none, F.col("silhouette")),
        rule(8, F.col("imbalance") > 10, "imbalance", none, F.round("imbalance", 0)),
    ]
    empty = F.expr("CAST(array() AS array<struct<position: int, name: string, measure: string, value: double>>)")
    held = F.concat(*[F.coalesce(r, empty) for r in rules])
    calm = F.array(F.struct(F.lit(0).alias("position"), F.lit("none").alias("name"), none.alias("measure"), F.lit(None).cast("double").alias("value")))
    return row.select(F.lit("advice").alias("section"), F.explode(F.when(F.size(held) > 0, held).otherwise(calm)).alias("x")).select("section", "x.*")

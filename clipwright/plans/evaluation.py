"""Evaluation queries: nearest-centroid predictions on embeddings, agreement on labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipwright.functions import arrays as A
from clipwright.operators import metrics as M
from clipwright.sources.tables import table

N = 10
HEDGED = 0.6
DIMENSIONS = 64
LANGS = ["en", "fr", "de", "es"]


def r6(c: Column | str, name: str | None = None) -> Column:
    out = F.round(c if isinstance(c, Column) else F.col(c), 6)
    return out.alias(name or c) if name or isinstance(c, str) else out


def centroids(vectors: DataFrame) -> DataFrame:
    """``(class, centroid)``: element-wise means of DIMENSIONS values, one aggregate, combined
    on the map side."""
    at = [F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(DIMENSIONS)]
    return vectors.groupBy(F.col("label").alias("class")).agg(F.array(*at).alias("centroid"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, y_true, y_pred, confidence, scores)`` of the nearest centroid by cosine.

    The centroids are one row for each class: a fixed bound, broadcast as one array.
    """
    vectors = table(spark, sf_dir, "embeddings")
    normed = centroids(vectors).withColumn("norm", A.norm(F.col("centroid")))
    dim = normed.agg(F.array_sort(F.collect_list(F.struct("class", "centroid", "norm"))).alias("dim"))
    rows = vectors.withColumn("v", A.doubles(F.col("embedding"))).withColumn("own", A.norm(F.col("v"))).crossJoin(F.broadcast(dim))
    scores = F.transform("dim", lambda c: F.round(F.try_divide(A.dot(F.col("v"), c["centroid"]), F.col("own") * c["norm"]), 9))
    rows = rows.withColumn("scores", scores)
    best = A.argmax(F.col("scores"))
    return rows.select("vec_id", F.col("label").alias("y_true"), F.element_at("dim", best + 1)["class"].alias("y_pred"), F.array_max("scores").alias("confidence"), "scores")


PRED = """
WITH cells AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) AS t(i) GROUP BY label, i),
cent AS (SELECT label AS class, list(m ORDER BY i) AS c FROM cells GROUP BY label),
sims AS (SELECT vec_id, label AS y_true, class,
  round(list_dot_product(embedding::DOUBLE[], c) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(c, c))), 9) AS s
  FROM embeddings, cent),
pred AS (SELECT vec_id, y_true, class AS y_pred, s AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, class) AS rn FROM sims) AS z WHERE rn = 1),
cls AS (SELECT i::INTEGER AS class FROM range(10) AS t(i)),
stat AS (SELECT c.class,
  (SELECT count(*) FROM pred WHERE y_true = c.class AND y_pred = c.class) AS tp,
  (SELECT count(*) FROM pred WHERE y_true = c.class) AS n_true,
  (SELECT count(*) FROM pred WHERE y_pred = c.class) AS n_pred FROM cls AS c),
per AS (SELECT class, tp, n_true, n_pred,
  CASE WHEN n_pred = 0 THEN 0.0 ELSE tp::DOUBLE / n_pred END AS precision,
  CASE WHEN n_true = 0 THEN 0.0 ELSE tp::DOUBLE / n_true END AS recall,
  CASE WHEN n_true + n_pred = 0 THEN 0.0 ELSE 2.0 * tp / (n_true + n_pred) END AS f1 FROM stat)
"""


def metric_confusion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = M.per_class(predictions(spark, sf_dir), N)
    return each.select("class", "tp", "n_true", "n_pred", r6("precision"), r6("recall"), r6("f1"))


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.summary(predictions(spark, sf_dir), N)
    return s.select("n_samples", *[r6(c) for c in ("accuracy", "macro_f1", "weighted_f1", "uar")])


def confusion_matrix_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion_matrix(predictions(spark, sf_dir), N)


def top_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = M.confusion_matrix(predictions(spark, sf_dir), N)
    rated = cells.withColumn("rate", r6(M.ratio(F.col("n"), F.sum("n").over(Window.partitionBy("y_true"))), "rate"))
    return rated.filter("y_true <> y_pred and n > 0").orderBy(F.desc("n"), "y_true", "y_pred").limit(5)


def top3_confusions_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = M.confusion_matrix(predictions(spark, sf_dir), N).filter("y_true <> y_pred and n > 0")
    rank = F.row_number().over(Window.partitionBy("y_true").orderBy(F.desc("n"), "y_pred"))
    return cells.withColumn("rank", rank).filter("rank <= 3")


def per_class_present_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = predictions(spark, sf_dir).filter("y_true < 4")
    s = M.summary(some, N, present_only=True)
    return s.select("n_samples", *[r6(c) for c in ("accuracy", "macro_f1", "weighted_f1", "uar")])


def misclassified_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = predictions(spark, sf_dir).filter("y_true <> y_pred")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.substring("text", 1, 100).alias("excerpt"), "lang")
    both = wrong.select("vec_id", "y_true", "y_pred").join(docs, "vec_id", "left")
    return both.withColumns({"excerpt": F.coalesce("excerpt", F.lit("")), "lang": F.coalesce("lang", F.lit("vi"))})


def class_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-versus-rest scores of every class, long form."""
    long = predictions(spark, sf_dir).select("y_true", F.posexplode("scores").alias("class", "score"))
    return long.select("class", "score", (F.col("y_true") == F.col("class")).alias("positive"))


def roc_auc_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.roc_auc(class_share(spark, sf_dir), "class").select("class", r6("roc_auc"))


def pr_auc_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.average_precision(class_share(spark, sf_dir), "class").select("class", r6("average_precision"))


def _binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y_true"), (1 - F.col("toxic")).alias("y_pred"))


def confusion_matrix_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion_matrix(_binary(spark, sf_dir), 2)


def kappa_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.kappa(_binary(spark, sf_dir), "y_true", "y_pred").select("n", r6("agreement"), r6("kappa"))


def metrics_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("lang"))
    s = M.summary(_binary(spark, sf_dir).join(docs, "doc_id"), 2, "lang")
    return s.select("lang", "n_samples", *[r6(c) for c in ("accuracy", "macro_f1", "weighted_f1", "uar")])


def rare_class_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    each = M.per_class(_binary(spark, sf_dir).join(docs, "doc_id"), 2, "lang")
    wide = each.groupBy("class").pivot("lang", LANGS).agg(F.first("f1"))
    return wide.select("class", *[r6(F.coalesce(c, F.lit(0.0)), f"f1_{c}") for c in LANGS])


def ood_vs_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("source").isin("src0", "src1", "src2"), "ood").otherwise("id").alias("scope"))
    s = M.summary(_binary(spark, sf_dir).join(docs, "doc_id"), 2, "scope")
    tidy = s.unpivot("scope", ["accuracy", "macro_f1", "weighted_f1", "uar"], "metric", "value")
    inside, outside = (tidy.filter(F.col("scope") == x).select("metric", F.col("value").alias(x)) for x in ("id", "ood"))
    both = inside.join(outside, "metric", "full").fillna(0.0, ["id", "ood"])
    delta = F.col("ood") - F.col("id")
    return both.select("metric", r6("id", "id_value"), r6("ood", "ood_value"), r6(delta, "delta"), r6(100 * delta / F.greatest("id", F.lit(1e-8)), "delta_pct"))


def _weights(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return M.class_weights(table(spark, sf_dir, "embeddings"), N, method).select("class", "n", r6("weight"))

    return query


def sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    both = counts.agg(F.max("n").alias("top"), F.min("n").alias("low"))
    return counts.crossJoin(F.broadcast(both)).select("label", "n", r6(1.0 / F.col("n"), "weight"), r6(F.col("top") / F.greatest("low", F.lit(1)), "imbalance"))


def label_distribution_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    share = docs.groupBy("lang").count().withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()))
    target = spark.createDataFrame([("en", 0.5), ("fr", 0.2), ("de", 0.2), ("es", 0.1)], "lang string, target double")
    gap = F.coalesce("share", F.lit(0.0)) - F.col("target")
    return target.join(share, "lang", "left").select("lang", "target", r6(F.coalesce("share", F.lit(0.0)), "share"), r6(gap, "gap"), (F.abs(gap) > 0.05).alias("flagged"))


def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("confidence")
    bins = F.when(value < 0.2, 0).when(value < 0.4, 1).when(value < 0.6, 2).when(value < 0.8, 3).when(value < 1.01, 4)
    counts = predictions(spark, sf_dir).groupBy(bins.alias("bin")).agg(F.count("*").alias("n"))
    dim = spark.range(5).select(F.col("id").cast("int").alias("bin"))
    return dim.join(counts, "bin", "left").fillna(0, ["n"])


def low_confidence_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).filter("confidence < 0.4").select("vec_id", "y_pred", r6("confidence")).orderBy("confidence", "vec_id").limit(20)


def hedge_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's confidence against a stand-in for its explainer's, and the share of the wrong
    rows for which the explainer's is below HEDGED."""
    told = F.col("vec_id") * 37 % 101 / 101.0
    rows = predictions(spark, sf_dir).select((F.col("y_true") != F.col("y_pred")).alias("wrong"), "confidence", told.alias("told"))
    ranked = M.average_rank(M.average_rank(rows, "told"), "confidence")
    spread, n_wrong, hedged = F.stddev_pop("confidence"), F.count_if("wrong"), F.count_if(F.col("wrong") & (F.col("told") < HEDGED))
    return ranked.agg(
        r6(F.corr("confidence", "told"), "pearson"), r6(F.corr("confidence_rank", "told_rank"), "spearman"), F.count("*").alias("n_samples"),
        r6(F.avg("confidence"), "mean_confidence"), r6(spread, "std_confidence"), (spread >= 0.05).alias("reliable"),
        n_wrong.alias("n_wrong"), hedged.alias("n_hedged"), r6(hedged / F.greatest(n_wrong, F.lit(1)), "hedge_rate"),
    )


def paired_t_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired t of two event types' daily means."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view")).groupBy(F.to_date("ts").alias("day"))
    days = e.agg(F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("a"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("b")).dropna()
    d = days.withColumn("d", F.col("a") - F.col("b"))
    return d.agg(F.count("*").alias("n"), r6(F.avg("d"), "mean_diff"), r6(F.try_divide(F.avg("d"), F.stddev_samp("d") / F.sqrt(F.count("*"))), "t"))


def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["text", "lang", "source"]
    made = docs.agg(F.count("*").alias("rows"), *[F.count_if(F.length(c) > 0).alias(f"has_{c}") for c in fields], F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), r6(F.avg("n_chars"), "mean_chars"))
    return made


def split_lang_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("split", F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 9, "val").otherwise("test"))
    wide = docs.rollup("split", "source").agg(F.count("*").alias("total"), *[F.count_if(F.col("lang") == x).alias(x) for x in ("en", "fr", "de", "es")])
    return wide


SUMMARY = "SELECT (SELECT count(*) FROM pred{w}) AS n_samples, (SELECT round(avg((y_true = y_pred)::INTEGER), 6) FROM pred{w}) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * n_true) / sum(n_true), 6) AS weighted_f1, round(avg(recall), 6) AS uar FROM per"
BINARY = "SELECT doc_id, quality AS y_true, 1 - toxic AS y_pred FROM labels"
GROUPED = """WITH p AS ({rows}), g AS (SELECT DISTINCT {by} FROM p), c AS (SELECT * FROM g, (VALUES (0), (1)) AS v(class)),
s AS (SELECT c.{by}, c.class, count(*) FILTER (p.y_true = c.class AND p.y_pred = c.class) AS tp, count(*) FILTER (p.y_true = c.class) AS nt, count(*) FILTER (p.y_pred = c.class) AS np FROM c JOIN p ON p.{by} = c.{by} GROUP BY ALL),
f AS (SELECT {by}, class, tp, nt, CASE WHEN nt = 0 THEN 0.0 ELSE tp::DOUBLE / nt END AS recall, CASE WHEN nt + np = 0 THEN 0.0 ELSE 2.0 * tp / (nt + np) END AS f1 FROM s),
m AS (SELECT {by}, sum(nt)::BIGINT AS n_samples, sum(tp)::DOUBLE / sum(nt) AS accuracy, avg(f1) AS macro_f1, sum(f1 * nt) / sum(nt) AS weighted_f1, avg(recall) AS uar FROM f GROUP BY {by})
"""
BY_LANG = "SELECT l.quality AS y_true, 1 - l.toxic AS y_pred, coalesce(d.lang, 'unknown') AS lang FROM labels AS l JOIN documents AS d USING (doc_id)"
BY_SCOPE = "SELECT l.quality AS y_true, 1 - l.toxic AS y_pred, CASE WHEN d.source IN ('src0', 'src1', 'src2') THEN 'ood' ELSE 'id' END AS scope FROM labels AS l JOIN documents AS d USING (doc_id)"
STEPS = PRED + """, steps AS (SELECT class, s AS score, count(*) FILTER (y_true = class) AS pos, count(*) FILTER (y_true <> class) AS neg FROM sims GROUP BY class, s),
cum AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS tpa, coalesce(sum(neg) OVER w, 0) AS fpa, sum(pos) OVER (PARTITION BY class) AS ap, sum(neg) OVER (PARTITION BY class) AS an FROM steps WINDOW w AS (PARTITION BY class ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""
WEIGHTS = "WITH c AS (SELECT t.i::INTEGER AS class, count(e.label) AS n FROM range(10) AS t(i) LEFT JOIN embeddings AS e ON e.label = t.i GROUP BY t.i), w AS (SELECT class, n, {raw} AS raw FROM c) SELECT class, n, round(raw / avg(raw) OVER (), 6) AS weight FROM w"

QUERIES = {
    "metric_confusion_report": (metric_confusion_report, PRED + "SELECT class, tp, n_true, n_pred, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM per"),
    "metric_summary": (metric_summary, PRED + SUMMARY.format(w="")),
    "confusion_matrix_embeddings": (confusion_matrix_embeddings, PRED + "SELECT a.class AS y_true, b.class AS y_pred, (SELECT count(*) FROM pred WHERE y_true = a.class AND y_pred = b.class) AS n FROM cls AS a, cls AS b"),
    "top_confusions": (top_confusions, PRED + "SELECT y_true, y_pred, count(*) AS n, round(count(*) / (SELECT count(*) FROM pred AS q WHERE q.y_true = p.y_true), 6) AS rate FROM pred AS p WHERE y_true <> y_pred GROUP BY y_true, y_pred ORDER BY n DESC, y_true, y_pred LIMIT 5"),
    "top3_confusions_per_class": (top3_confusions_per_class, PRED + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY n DESC, y_pred) AS rank FROM (SELECT y_true, y_pred, count(*) AS n FROM pred WHERE y_true <> y_pred GROUP BY y_true, y_pred) AS x) AS y WHERE rank <= 3"),
    "per_class_present_labels": (per_class_present_labels, PRED.replace("FROM sims) AS z WHERE rn = 1)", "FROM sims) AS z WHERE rn = 1 AND y_true < 4)") + SUMMARY.format(w="") + " WHERE n_true + n_pred > 0"),
    "misclassified_detail": (misclassified_detail, PRED + "SELECT p.vec_id, y_true, y_pred, coalesce(d.text[1:100], '') AS excerpt, coalesce(d.lang, 'vi') AS lang FROM pred AS p LEFT JOIN documents AS d ON d.doc_id = p.vec_id WHERE y_true <> y_pred"),
    "roc_auc_ovr": (roc_auc_ovr, STEPS + "SELECT class, round(sum(neg * (tpa + 0.5 * pos)) / (max(ap)::DOUBLE * max(an)), 6) AS roc_auc FROM cum GROUP BY class"),
    "pr_auc_ovr": (pr_auc_ovr, STEPS + "SELECT class, round(sum(pos * (tpa + pos)::DOUBLE / (tpa + pos + fpa + neg)) / max(ap)::DOUBLE, 6) AS average_precision FROM cum GROUP BY class"),
    "confusion_matrix_binary": (confusion_matrix_binary, f"WITH p AS ({BINARY}), c AS (SELECT * FROM (VALUES (0), (1)) AS v(k)) SELECT a.k AS y_true, b.k AS y_pred, (SELECT count(*) FROM p WHERE y_true = a.k AND y_pred = b.k) AS n FROM c AS a, c AS b"),
    "kappa_agreement": (kappa_agreement, f"WITH p AS ({BINARY}), s AS (SELECT count(*) AS n, avg((y_true = y_pred)::INTEGER) AS po, avg(y_true) * avg(y_pred) + (1 - avg(y_true)) * (1 - avg(y_pred)) AS pe FROM p) SELECT n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM s"),
    "metrics_by_group": (metrics_by_group, GROUPED.format(rows=BY_LANG, by="lang") + "SELECT lang, n_samples, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1, round(uar, 6) AS uar FROM m"),
    "rare_class_by_language": (rare_class_by_language, GROUPED.format(rows=BY_LANG, by="lang") + "SELECT class, round(coalesce(max(f1) FILTER (lang = 'en'), 0), 6) AS f1_en, round(coalesce(max(f1) FILTER (lang = 'fr'), 0), 6) AS f1_fr, round(coalesce(max(f1) FILTER (lang = 'de'), 0), 6) AS f1_de, round(coalesce(max(f1) FILTER (lang = 'es'), 0), 6) AS f1_es FROM f GROUP BY class"),
    "ood_vs_id": (ood_vs_id, GROUPED.format(rows=BY_SCOPE, by="scope") + ", t AS (UNPIVOT (SELECT scope, accuracy, macro_f1, weighted_f1, uar FROM m) ON accuracy, macro_f1, weighted_f1, uar INTO NAME metric VALUE value), z AS (SELECT metric, coalesce(max(value) FILTER (scope = 'id'), 0) AS i, coalesce(max(value) FILTER (scope = 'ood'), 0) AS o FROM t GROUP BY metric) SELECT metric, round(i, 6) AS id_value, round(o, 6) AS ood_value, round(o - i, 6) AS delta, round(100 * (o - i) / greatest(i, 1e-8), 6) AS delta_pct FROM z"),
    "class_weights_inverse": (_weights("inverse_freq"), WEIGHTS.format(raw="1.0::DOUBLE / greatest(n, 1)")),
    "class_weights_effective": (_weights("effective_number"), WEIGHTS.format(raw="(1 - (sum(n) OVER () - 1)::DOUBLE / sum(n) OVER ()) / greatest(1 - power((sum(n) OVER () - 1)::DOUBLE / sum(n) OVER (), greatest(n, 1)), 1e-8)")),
    "sample_weights": (sample_weights, "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, n, round(1.0::DOUBLE / n, 6) AS weight, round((SELECT max(n) FROM c)::DOUBLE / (SELECT greatest(min(n), 1) FROM c), 6) AS imbalance FROM c"),
    "label_distribution_gap": (label_distribution_gap, "WITH t AS (SELECT * FROM (VALUES ('en', 0.5::DOUBLE), ('fr', 0.2), ('de', 0.2), ('es', 0.1)) AS v(lang, target)), s AS (SELECT lang, count(*)::DOUBLE / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY lang) SELECT t.lang, target, round(coalesce(share, 0), 6) AS share, round(coalesce(share, 0) - target, 6) AS gap, abs(coalesce(share, 0) - target) > 0.05 AS flagged FROM t LEFT JOIN s USING (lang)"),
    "confidence_histogram": (confidence_histogram, PRED + "SELECT t.i::INTEGER AS bin, count(p.vec_id) AS n FROM range(5) AS t(i) LEFT JOIN (SELECT vec_id, CASE WHEN confidence < 0.2 THEN 0 WHEN confidence < 0.4 THEN 1 WHEN confidence < 0.6 THEN 2 WHEN confidence < 0.8 THEN 3 WHEN confidence < 1.01 THEN 4 END AS bin FROM pred) AS p ON p.bin = t.i GROUP BY t.i"),
    "low_confidence_review": (low_confidence_review, PRED + "SELECT vec_id, y_pred, round(confidence, 6) AS confidence FROM pred WHERE confidence < 0.4 ORDER BY round(confidence, 6), vec_id LIMIT 20"),
    "hedge_correlations": (hedge_correlations, PRED + ", r AS (SELECT confidence, y_true <> y_pred AS wrong, vec_id * 37 % 101 / 101.0::DOUBLE AS told FROM pred), k AS (SELECT *, rank() OVER (ORDER BY confidence) + (count(*) OVER (PARTITION BY confidence) - 1) / 2.0 AS a, rank() OVER (ORDER BY told) + (count(*) OVER (PARTITION BY told) - 1) / 2.0 AS b FROM r) SELECT round(corr(confidence, told), 6) AS pearson, round(corr(a, b), 6) AS spearman, count(*) AS n_samples, round(avg(confidence), 6) AS mean_confidence, round(stddev_pop(confidence), 6) AS std_confidence, stddev_pop(confidence) >= 0.05 AS reliable, count(*) FILTER (wrong) AS n_wrong, count(*) FILTER (wrong AND told < 0.6) AS n_hedged, round(count(*) FILTER (wrong AND told < 0.6) / greatest(count(*) FILTER (wrong), 1)::DOUBLE, 6) AS hedge_rate FROM k"),
    "paired_t_statistic": (paired_t_statistic, "WITH d AS (SELECT ts::DATE AS day, avg(value) FILTER (event_type = 'click') - avg(value) FILTER (event_type = 'view') AS d FROM events GROUP BY 1) SELECT count(d) AS n, round(avg(d), 6) AS mean_diff, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) AS t FROM d WHERE d IS NOT NULL"),
    "coverage_counts": (coverage_counts, "SELECT count(*) AS rows, count(*) FILTER (length(text) > 0) AS has_text, count(*) FILTER (length(lang) > 0) AS has_lang, count(*) FILTER (length(source) > 0) AS has_source, min(n_chars) AS shortest, max(n_chars) AS longest, round(avg(n_chars), 6) AS mean_chars FROM documents"),
    "split_lang_pivot": (split_lang_pivot, "WITH d AS (SELECT *, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'val' ELSE 'test' END AS split FROM documents) SELECT split, source, count(*) AS total, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es FROM d GROUP BY ROLLUP (split, source)"),
}

"""Report queries: what an evaluation says about classes, languages and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipwright.functions import arrays as A
from clipwright.functions import text as T
from clipwright.operators import metrics as M
from clipwright.operators.analysis import counted, report
from clipwright.operators.blocks import silhouettes
from clipwright.operators.classify import fold_accuracy
from clipwright.operators.sampling import first_fitting
from clipwright.plans.evaluation import BY_LANG, GROUPED, LANGS, N, PRED, STEPS, SUMMARY, _binary, class_share, predictions, r6
from clipwright.sources.tables import stored, table


def macro_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of one-versus-rest ROC and PR areas over the classes that occur; null below two."""
    areas = M.roc_auc(class_share(spark, sf_dir), "class").join(M.average_precision(class_share(spark, sf_dir), "class"), "class")
    present = areas.filter("average_precision is not null").agg(F.count("*").alias("classes"), F.avg("roc_auc").alias("r"), F.avg("average_precision").alias("p"))
    enough = F.col("classes") >= 2
    return present.select("classes", r6(F.when(enough, F.col("r")), "macro_roc_auc"), r6(F.when(enough, F.col("p")), "macro_pr_auc"))


def class_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes with their support, the worst F1 first."""
    each = M.per_class(predictions(spark, sf_dir), N)
    return each.select(r6("f1"), "class", r6("precision"), r6("recall"), F.col("n_true").alias("support")).orderBy("f1", "class")


def error_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by pair of classes, beside the total and its rate."""
    cells = predictions(spark, sf_dir).groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    both = cells.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("y_true") != F.col("y_pred"), F.col("n")).otherwise(0)).alias("errors"))
    wrong = cells.filter("y_true <> y_pred").crossJoin(F.broadcast(both))
    return wrong.select("y_true", "y_pred", "n", "errors", r6(F.col("errors") / F.greatest("all", F.lit(1)), "error_rate"))


def metrics_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of stated languages over the classes that occur in each; one without rows has zeros."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    found = M.summary(_binary(spark, sf_dir).join(docs, "doc_id"), 2, "lang", present_only=True)
    dim = spark.createDataFrame([(x,) for x in [*LANGS, "vi"]], "lang string")
    return dim.join(found, "lang", "left").select("lang", F.coalesce("n_samples", F.lit(0)).alias("n"), *[r6(F.coalesce(c, F.lit(0.0)), c) for c in ("macro_f1", "uar")])


def language_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language; no row where there are fewer than two languages."""
    counts = table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("vi")).alias("lang")).agg(F.count("*").alias("n"))
    # The window is over one row for each language.
    return counts.withColumn("k", F.count("*").over(Window.partitionBy())).filter("k >= 2").drop("k")


def rare_class_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of stated classes: scores, rows by language, and the three classes they are taken for."""
    rows = predictions(spark, sf_dir).filter(F.col("y_true").isin(RARE) | F.col("y_pred").isin(RARE))
    each = M.per_class(predictions(spark, sf_dir), N).filter(F.col("class").isin(RARE))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    langs = rows.filter(F.col("y_true").isin(RARE)).join(docs, "vec_id", "left").groupBy(F.col("y_true").alias("class")).agg(*[F.count_if(F.coalesce("lang", F.lit("vi")) == x).alias(x) for x in [*LANGS, "vi"]])
    taken = rows.filter("y_true <> y_pred").groupBy(F.col("y_true").alias("class"), "y_pred").agg(F.count("*").alias("n"))
    top = taken.withColumn("k", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("n"), "y_pred"))).filter("k <= 3")
    listed = top.groupBy("class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "y_pred", "n"))), lambda x: F.concat(x["y_pred"].cast("string"), F.lit(":"), x["n"].cast("string"))), ",").alias("confusions"))
    return each.join(langs, "class", "left").join(listed, "class", "left").select("class", r6("f1"), r6("recall"), F.col("n_true").alias("support"), *[F.coalesce(x, F.lit(0)).alias(x) for x in [*LANGS, "vi"]], F.coalesce("confusions", F.lit("")).alias("confusions"))


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report recommends: one row for each rule that holds, in the rules' order."""
    each = M.per_class(predictions(spark, sf_dir), N)
    cells = predictions(spark, sf_dir).groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    rated = cells.withColumn("rate", M.ratio(F.col("n"), F.sum("n").over(Window.partitionBy("y_true")))).filter("y_true <> y_pred")
    listed = lambda held: F.array_join(F.array_sort(F.collect_list(F.when(held, F.col("class")))).cast("array<string>"), ",")
    some = F.col("n_true") > 0
    seen = each.agg(
        F.avg("f1").alias("macro_f1"), listed(some & (F.col("f1") < 0.2)).alias("weak"), listed(some & (F.col("recall") == 0)).alias("never"), listed(some & F.col("class").isin(RARE) & (F.col("f1") < 0.15)).alias("rare"),
        M.ratio(F.max("n_true"), F.min(F.when(some, F.col("n_true")))).alias("imbalance"),
    ).crossJoin(rated.agg(F.max_by(F.struct(F.concat_ws(">", "y_true", "y_pred").alias("pair"), "rate"), F.struct("n", -F.col("y_true"), -F.col("y_pred"))).alias("top")))
    f1, rules = F.col("macro_f1"), []
    rules.append((f1 < 0.3, F.lit("macro_f1_critical"), F.lit("")))
    rules.append(((f1 >= 0.3) & (f1 < 0.5), F.lit("macro_f1_low"), F.lit("")))
    rules += [(F.col(c) != "", F.lit(f"{c}_classes"), F.col(c)) for c in ("weak", "never", "rare")]
    rules.append((F.col("top.rate") > 0.3, F.lit("confusion"), F.col("top.pair")))
    rules.append((F.col("imbalance") > 10, F.lit("imbalance"), F.round("imbalance", 0).cast("long").cast("string")))
    held = F.filter(F.array(*[F.when(c, F.struct(F.lit(i).alias("rule"), n.alias("name"), d.alias("detail"))) for i, (c, n, d) in enumerate(rules, 1)]), lambda x: x.isNotNull())
    none = F.array(F.struct(F.lit(0).alias("rule"), F.lit("none").alias("name"), F.lit("").alias("detail")))
    return seen.select(F.explode(F.when(F.size(held) > 0, held).otherwise(none)).alias("x")).select("x.*")


def attention_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean attention of each modality: over the steps of a clip, then over the clips of a label."""
    v = A.doubles(F.col("embedding"))
    of = lambda m: A.mean(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.get(v, 4 * t + m)))
    steps = table(spark, sf_dir, "embeddings").select("label", *[of(m).alias(f"m{m}") for m in range(4)])
    return steps.groupBy("label").agg(F.count("*").alias("clips"), *[r6(F.avg(f"m{m}"), f"m{m}") for m in range(4)])


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs before and after, and the labels they should and do tell, on documents."""
    cols = {"gold": "doc_id % 8", "model": "CASE WHEN doc_id % 3 = 0 THEN doc_id % 8 ELSE doc_id % 5 END", "before": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 5 END", "after": "CASE WHEN doc_id % 4 = 0 THEN doc_id % 8 ELSE doc_id % 5 END", "cues_before": "doc_id % 6", "cues_after": "doc_id % 9"}
    return table(spark, sf_dir, "documents").selectExpr("doc_id", *[f"{v} AS {k}" for k, v in cols.items()])


def agreement_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An explainer's agreement with its model, its format and both accuracies; ratios are over
    all samples, one at least."""
    share = lambda held: r6(F.count_if(held) / F.greatest(F.count("*"), F.lit(1)))
    c = F.col
    return _told(spark, sf_dir).agg(F.count("*").alias("n_samples"), share(c("before") == c("model")).alias("agreement"), share(c("before").isNotNull()).alias("format_rate"), share(c("model") == c("gold")).alias("model_accuracy"), share(c("before") == c("gold")).alias("told_accuracy"))


def ablation_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the label stays and the cues change when the inputs are taken away."""
    share = lambda held: r6(F.count_if(held) / F.greatest(F.count("*"), F.lit(1)))
    return _told(spark, sf_dir).agg(F.count("*").alias("n"), share(F.col("before").eqNullSafe(F.col("after"))).alias("stability"), share(F.col("cues_before") != F.col("cues_after")).alias("degradation"))


def counterfactual_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first modality whose removal changes the label, and how often the explanation
    follows it. Removal sets a block of the embedding to zero; the label is the greatest
    of the sums of the blocks' tenth parts."""
    v = A.doubles(F.col("embedding"))
    score = lambda keep: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.round(F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0.0), lambda a, b: a + F.when(b != keep, F.get(F.col("v"), 16 * b + k)).otherwise(0.0)), 9))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    rows = rows.select("vec_id", A.argmax(score(F.lit(-1))).alias("own"), F.array(*[A.argmax(score(F.lit(b))) for b in range(4)]).alias("without"))
    first = F.array_position(F.transform("without", lambda x: x != F.col("own")), True)
    rows = rows.select("vec_id", "own", first.alias("first"), F.try_element_at("without", F.when(first > 0, first.cast("int"))).alias("new"))
    told = F.when(F.col("vec_id") % 3 == 0, F.col("own")).otherwise(F.col("new"))
    changed = F.col("first") > 0
    return rows.agg(F.count("*").alias("n_samples"), F.count_if(changed).alias("n_changed"), *[F.count_if(F.col("first") == i).alias(f"by_{m}") for i, m in enumerate(("audio", "face", "context", "text"), 1)], r6(F.count_if(changed & (told == F.col("new"))) / F.greatest(F.count_if(changed), F.lit(1)), "consistency"))


def setup_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and format compliance of each setup, over outputs that can be parsed and all."""
    rows = _told(spark, sf_dir).withColumn("setup", F.concat(F.lit("llm"), (F.col("doc_id") % 4 + 1).cast("string")))
    parsed = F.col("before").isNotNull()
    return rows.groupBy("setup").agg(F.count("*").alias("n"), F.count_if(parsed).alias("n_parsed"), r6(F.count_if(F.col("before") == F.col("gold")) / F.greatest(F.count_if(parsed), F.lit(1)), "accuracy"), r6(F.avg(parsed.cast("double")), "compliance"))


def parsed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics over rows whose label was read and whose gold label is known."""
    rows = _told(spark, sf_dir).select(F.when(F.col("doc_id") % 11 != 0, F.col("gold")).cast("int").alias("y_true"), F.col("before").cast("int").alias("y_pred")).dropna(subset=["y_true", "y_pred"])
    s = M.summary(rows, 8, present_only=True)
    return s.select("n_samples", *[r6(c) for c in ("accuracy", "macro_f1", "weighted_f1", "uar")])


def manual_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual against model labels where the manual one is no placeholder, and its confidence."""
    rows = _told(spark, sf_dir).withColumns({"placeholder": F.col("doc_id") % 6 == 0, "conf": F.col("doc_id") % 10 / 10.0})
    real = ~F.col("placeholder")
    return rows.agg(F.count_if(real).alias("n"), r6(F.coalesce(F.try_divide(F.count_if(real & (F.col("gold") == F.col("model"))), F.count_if(real)), F.lit(0.0)), "agreement"), r6(F.avg("conf"), "mean_confidence"))


def duration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations above zero: the others are rejects."""
    d = table(spark, sf_dir, "orders").select((F.floor("o_totalprice") % 3000 / 100 - 2).alias("d"))
    fine = F.when(F.col("d") > 0, F.col("d"))
    return d.agg(F.count(fine).alias("n"), F.count_if(F.col("d") <= 0).alias("rejected"), *[r6(f(fine), n) for n, f in (("shortest", F.min), ("longest", F.max), ("mean", F.avg))])


def source_split_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document in or out of domain by its source; the first rule that matches wins."""
    side = F.when(F.col("source").isin("src0", "src1"), "test_ood").when(F.col("source").isin("src1", "src2"), "test_id").otherwise("train")
    return table(spark, sf_dir, "documents").select("doc_id", side.alias("split"))


def label_metrics_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of each of five folds and of all but it, and the mean over folds."""
    rows = _told(spark, sf_dir).select((F.col("doc_id") % 5).cast("int").alias("fold"), (F.col("gold") == F.col("model")).cast("int").alias("hit"))
    sums = rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    # The window is over five rows.
    whole = Window.partitionBy()
    return sums.select("fold", "n", r6(F.col("hits") / F.col("n"), "accuracy"), r6((F.sum("hits").over(whole) - F.col("hits")) / (F.sum("n").over(whole) - F.col("n")), "others"), r6(F.avg(F.col("hits") / F.col("n")).over(whole), "mean"))


def _by_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("lang is not null").select(F.col("doc_id").alias("vec_id"), (F.col("lang") == "en").cast("double").alias("label"))
    return table(spark, sf_dir, "embeddings").select("vec_id", A.doubles(F.col("embedding")).alias("v")).join(docs, "vec_id")


def language_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of telling English from the rest by embeddings, over stratified folds; no other
    engine trains alike, so it has no twin: the models are tested against numpy."""
    told = fold_accuracy(_by_english(spark, sf_dir), "vec_id")
    return told.select("fold", "n", r6(F.col("hits") / F.col("n"), "accuracy"))


def analysis_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sections of an evaluation report, with the eight rules of its advice, from one count
    of the predictions by class pair and language."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    rows = predictions(spark, sf_dir).select("vec_id", "y_true", "y_pred").join(docs, "vec_id", "left").withColumn("lang", F.coalesce("lang", F.lit("vi")))
    sides = _by_english(spark, sf_dir).select(F.when(F.col("label") == 1, "en").otherwise("other").alias("by"), F.col("vec_id").alias("id"), "v")
    parted = silhouettes(sides).agg(F.avg("silhouette").alias("silhouette"), F.lit(None).cast("double").alias("accuracy"))
    told = report(counted(rows, "lang"), N, RARE, ("en", "fr"), parted)
    return told.select("section", "position", "name", "measure", r6("value"))


def first_agreeing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty clips, in order, in whose text a label can be read, with that label:
    reading ends when they are found."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    told = lambda part: part.withColumn("said", T.first_contained(F.col("text"), SAID, "")).filter("said <> ''")
    return first_fitting(docs, "doc_id", told, 50).select("doc_id", "said", F.length("text").cast("long").alias("n_chars"))


RARE = [1, 4, 7]
SAID = ["sad", "fear", "rest"]
_RARE = "(1, 4, 7)"
TOLD = "t AS (SELECT doc_id, doc_id % 8 AS gold, CASE WHEN doc_id % 3 = 0 THEN doc_id % 8 ELSE doc_id % 5 END AS model, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 5 END AS before, CASE WHEN doc_id % 4 = 0 THEN doc_id % 8 ELSE doc_id % 5 END AS after, doc_id % 6 AS cb, doc_id % 9 AS ca FROM documents)"
_share = lambda held, name, of="count(*)": f"round(count(*) FILTER ({held}) / greatest({of}, 1)::DOUBLE, 6) AS {name}"
_FLIP = """WITH e AS (SELECT vec_id, b.b, k.k, embedding[16 * b.b + k.k + 1]::DOUBLE AS x FROM embeddings, range(4) AS b(b), range(10) AS k(k)), g AS (SELECT vec_id, r.r, k, round(coalesce(sum(x) FILTER (b <> r.r), 0), 9) AS s FROM e, range(-1, 4) AS r(r) GROUP BY ALL),
l AS (SELECT vec_id, r, k FROM g QUALIFY row_number() OVER (PARTITION BY vec_id, r ORDER BY s DESC, k) = 1), o AS (SELECT a.vec_id, a.k AS own, min(b.r) AS first FROM l AS a LEFT JOIN l AS b ON b.vec_id = a.vec_id AND b.r >= 0 AND b.k <> a.k WHERE a.r = -1 GROUP BY 1, 2),
n AS (SELECT o.*, l.k AS new, CASE WHEN o.vec_id % 3 = 0 THEN own ELSE l.k END AS told FROM o LEFT JOIN l ON l.vec_id = o.vec_id AND l.r = o.first)
SELECT count(*) AS n_samples, count(first) AS n_changed, count(*) FILTER (first = 0) AS by_audio, count(*) FILTER (first = 1) AS by_face, count(*) FILTER (first = 2) AS by_context, count(*) FILTER (first = 3) AS by_text, round(count(*) FILTER (told = new) / greatest(count(first), 1)::DOUBLE, 6) AS consistency FROM n"""
_each = lambda section, pos, name, measures, src: " UNION ALL ".join(f"SELECT '{section}' AS section, {pos}::INTEGER AS position, {name} AS name, '{m}' AS measure, {v}::DOUBLE AS value FROM {src}" for m, v in measures.items())
_ANALYSIS = f""", c AS (SELECT *, row_number() OVER (ORDER BY f1, class) AS pos FROM per),
x AS (SELECT y_true, y_pred, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM pred AS q WHERE q.y_true = p.y_true) AS rate FROM pred AS p WHERE y_true <> y_pred GROUP BY 1, 2),
y AS (SELECT *, row_number() OVER (ORDER BY n DESC, y_true, y_pred) AS pos, row_number() OVER (PARTITION BY y_true ORDER BY n DESC, y_pred) AS k FROM x),
e AS (SELECT count(*) AS n, count(*) FILTER (y_true <> y_pred) AS wrong FROM pred),
l AS (SELECT y_true, y_pred, coalesce(lang, 'vi') AS lang FROM pred LEFT JOIN documents ON doc_id = vec_id),
o AS (SELECT lang, y_true AS class FROM l UNION SELECT lang, y_pred FROM l),
f AS (SELECT o.lang, o.class, count(*) FILTER (y_true = class AND y_pred = class) AS tp, count(*) FILTER (y_true = class) AS nt, count(*) FILTER (y_pred = class) AS np FROM o JOIN l USING (lang) GROUP BY ALL),
g AS (SELECT lang, sum(nt) AS n, avg(2.0::DOUBLE * tp / (nt + np)) AS macro_f1, avg(CASE WHEN nt = 0 THEN 0 ELSE tp::DOUBLE / nt END) AS uar, row_number() OVER (ORDER BY lang) AS pos FROM f GROUP BY lang),
v AS (SELECT vec_id, embedding::DOUBLE[] AS v, CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS side FROM embeddings JOIN documents ON doc_id = vec_id WHERE lang IS NOT NULL),
d AS (SELECT a.vec_id, a.side, b.side AS other, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM v AS a JOIN v AS b ON true GROUP BY ALL),
h AS (SELECT vec_id, max(CASE WHEN other = side THEN n END) AS n, max(CASE WHEN other = side THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN other <> side THEN s / n END) AS b FROM d GROUP BY 1),
sil AS (SELECT avg(CASE WHEN n > 1 AND b IS NOT NULL THEN coalesce((b - a) / nullif(greatest(a, b), 0), 0) ELSE 0 END) AS silhouette FROM h),
m AS (SELECT avg(f1) AS f, coalesce(string_agg(class::VARCHAR, ',' ORDER BY class) FILTER (n_true > 0 AND f1 < 0.2), '') AS weak, coalesce(string_agg(class::VARCHAR, ',' ORDER BY class) FILTER (n_true > 0 AND recall = 0), '') AS never, max(n_true)::DOUBLE / min(n_true) FILTER (n_true > 0) AS i, (SELECT macro_f1 FROM g WHERE lang = 'en') - (SELECT macro_f1 FROM g WHERE lang = 'fr') AS gap FROM per),
r AS (SELECT 1 AS position, 'macro_f1_critical' AS name, '' AS measure, f AS value FROM m WHERE f < 0.3 UNION ALL SELECT 1, 'macro_f1_low', '', f FROM m WHERE f >= 0.3 AND f < 0.5 UNION ALL SELECT 2, 'weak_classes', weak, NULL FROM m WHERE weak <> '' UNION ALL SELECT 3, 'never_predicted', never, NULL FROM m WHERE never <> ''
 UNION ALL SELECT 4, 'rare_class', class::VARCHAR, f1 FROM per WHERE class IN {_RARE} AND n_true > 0 AND f1 < 0.15 UNION ALL SELECT 5, 'confusion', y_true || '>' || y_pred, rate FROM y WHERE pos = 1 AND rate > 0.3 UNION ALL SELECT 6, 'language_gap', 'en', -gap FROM m WHERE gap < -0.05 UNION ALL SELECT 6, 'language_gap', 'fr', gap FROM m WHERE gap > 0.1
 UNION ALL SELECT 7, 'fragmentation', '', silhouette FROM sil WHERE silhouette > 0.2 UNION ALL SELECT 8, 'imbalance', '', round(i) FROM m WHERE i > 10),
t AS ({_each('class', 'pos', 'class::VARCHAR', {'precision': 'precision', 'recall': 'recall', 'f1': 'f1', 'support': 'n_true'}, 'c')} UNION ALL {_each('confusion', 'pos', "y_true || '>' || y_pred", {'count': 'n', 'rate': 'rate'}, 'y WHERE pos <= 5')} UNION ALL {_each('errors', '1', "'all'", {'n': 'n', 'errors': 'wrong', 'rate': 'coalesce(wrong::DOUBLE / nullif(n, 0), 0)'}, 'e')} UNION ALL {_each('language', 'pos', 'lang', {'n': 'n', 'macro_f1': 'macro_f1', 'uar': 'uar'}, 'g')}
 UNION ALL SELECT 'rare', 0, y_true::VARCHAR, 'in ' || lang, count(*) FROM l WHERE y_true IN {_RARE} GROUP BY y_true, lang UNION ALL SELECT 'rare', k, y_true::VARCHAR, 'as ' || y_pred, n FROM y WHERE k <= 3 AND y_true IN {_RARE}
 UNION ALL SELECT 'advice', position, name, measure, value FROM r UNION ALL SELECT 'advice', 0, 'none', '', NULL WHERE NOT EXISTS (SELECT 1 FROM r))
SELECT section, position::INTEGER AS position, name, measure, round(value, 6) AS value FROM t"""
QUERIES = {
    "macro_auc": (macro_auc, STEPS + ", a AS (SELECT class, sum(neg * (tpa + 0.5 * pos)) / (max(ap)::DOUBLE * max(an)) AS r, sum(pos * (tpa + pos)::DOUBLE / (tpa + pos + fpa + neg)) / max(ap)::DOUBLE AS p FROM cum GROUP BY class HAVING max(ap) > 0) SELECT count(*) AS classes, CASE WHEN count(*) >= 2 THEN round(avg(r), 6) END AS macro_roc_auc, CASE WHEN count(*) >= 2 THEN round(avg(p), 6) END AS macro_pr_auc FROM a"),
    "class_breakdown": (class_breakdown, PRED + "SELECT class, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall, n_true AS support FROM per ORDER BY f1, class"),
    "error_pairs": (error_pairs, PRED + "SELECT y_true, y_pred, count(*) AS n, (SELECT count(*) FROM pred WHERE y_true <> y_pred) AS errors, round((SELECT count(*) FROM pred WHERE y_true <> y_pred) / (SELECT greatest(count(*), 1) FROM pred)::DOUBLE, 6) AS error_rate FROM pred WHERE y_true <> y_pred GROUP BY 1, 2"),
    "metrics_per_language": (metrics_per_language, GROUPED.format(rows=BY_LANG, by="lang") + ", l AS (SELECT unnest(['en', 'fr', 'de', 'es', 'vi']) AS lang), q AS (SELECT lang, sum(f.nt)::BIGINT AS n_samples, avg(f1) AS macro_f1, avg(recall) AS uar FROM f JOIN s USING (lang, class) WHERE s.nt + s.np > 0 GROUP BY lang) SELECT lang, coalesce(n_samples, 0) AS n, round(coalesce(macro_f1, 0), 6) AS macro_f1, round(coalesce(uar, 0), 6) AS uar FROM l LEFT JOIN q USING (lang)"),
    "language_distribution": (language_distribution, "SELECT coalesce(lang, 'vi') AS lang, count(*) AS n FROM documents GROUP BY 1 QUALIFY count(*) OVER () >= 2"),
    "rare_class_detail": (rare_class_detail, PRED + f", g AS (SELECT y_true AS class, " + ", ".join(f"count(*) FILTER (coalesce(lang, 'vi') = '{x}') AS {x}" for x in [*LANGS, "vi"]) + f" FROM pred LEFT JOIN documents ON doc_id = vec_id WHERE y_true IN {_RARE} GROUP BY 1), t AS (SELECT y_true AS class, y_pred, count(*) AS n FROM pred WHERE y_true <> y_pred AND y_true IN {_RARE} GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY y_true ORDER BY count(*) DESC, y_pred) <= 3), c AS (SELECT class, string_agg(y_pred || ':' || n, ',' ORDER BY n DESC, y_pred) AS confusions FROM t GROUP BY class) SELECT class, round(f1, 6) AS f1, round(recall, 6) AS recall, n_true AS support, " + ", ".join(f"coalesce({x}, 0) AS {x}" for x in [*LANGS, "vi"]) + f", coalesce(confusions, '') AS confusions FROM per LEFT JOIN g USING (class) LEFT JOIN c USING (class) WHERE class IN {_RARE}"),
    "recommendations": (recommendations, PRED + f""", m AS (SELECT avg(f1) AS f, coalesce(string_agg(class::VARCHAR, ',' ORDER BY class) FILTER (n_true > 0 AND f1 < 0.2), '') AS weak, coalesce(string_agg(class::VARCHAR, ',' ORDER BY class) FILTER (n_true > 0 AND recall = 0), '') AS never, coalesce(string_agg(class::VARCHAR, ',' ORDER BY class) FILTER (n_true > 0 AND class IN {_RARE} AND f1 < 0.15), '') AS rare, max(n_true)::DOUBLE / min(n_true) FILTER (n_true > 0) AS i FROM per),
x AS (SELECT y_true, y_pred, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM pred AS q WHERE q.y_true = p.y_true) AS rate FROM pred AS p WHERE y_true <> y_pred GROUP BY 1, 2 ORDER BY n DESC, y_true, y_pred LIMIT 1),
r AS (SELECT 1 AS rule, 'macro_f1_critical' AS name, '' AS detail FROM m WHERE f < 0.3 UNION ALL SELECT 2, 'macro_f1_low', '' FROM m WHERE f >= 0.3 AND f < 0.5 UNION ALL SELECT 3, 'weak_classes', weak FROM m WHERE weak <> '' UNION ALL SELECT 4, 'never_classes', never FROM m WHERE never <> '' UNION ALL SELECT 5, 'rare_classes', rare FROM m WHERE rare <> '' UNION ALL SELECT 6, 'confusion', y_true || '>' || y_pred FROM x WHERE rate > 0.3 UNION ALL SELECT 7, 'imbalance', round(i)::BIGINT::VARCHAR FROM m WHERE i > 10)
SELECT * FROM r UNION ALL SELECT 0, 'none', '' WHERE NOT EXISTS (SELECT 1 FROM r)"""),
    "analysis_report": (analysis_report, PRED + _ANALYSIS),
    "first_agreeing": (first_agreeing, "SELECT doc_id, CASE WHEN contains(lower(text), 'sad') THEN 'sad' WHEN contains(lower(text), 'fear') THEN 'fear' ELSE 'rest' END AS said, length(text) AS n_chars FROM documents WHERE contains(lower(text), 'sad') OR contains(lower(text), 'fear') OR contains(lower(text), 'rest') ORDER BY doc_id LIMIT 50"),
    "attention_by_group": (attention_by_group, "SELECT label, count(*) AS clips, " + ", ".join(f"round(avg(list_avg(list_transform(range(16), lambda t: embedding[4 * t + {m} + 1]::DOUBLE))), 6) AS m{m}" for m in range(4)) + " FROM embeddings GROUP BY label"),
    "agreement_rates": (agreement_rates, f"WITH {TOLD} SELECT count(*) AS n_samples, {_share('before = model', 'agreement')}, {_share('before IS NOT NULL', 'format_rate')}, {_share('model = gold', 'model_accuracy')}, {_share('before = gold', 'told_accuracy')} FROM t"),
    "ablation_stability": (ablation_stability, f"WITH {TOLD} SELECT count(*) AS n, {_share('before IS NOT DISTINCT FROM after', 'stability')}, {_share('cb <> ca', 'degradation')} FROM t"),
    "counterfactual_flip": (counterfactual_flip, _FLIP),
    "setup_accuracy": (setup_accuracy, f"WITH {TOLD} SELECT 'llm' || (doc_id % 4 + 1) AS setup, count(*) AS n, count(before) AS n_parsed, {_share('before = gold', 'accuracy', 'count(before)')}, round(count(before) / count(*)::DOUBLE, 6) AS compliance FROM t GROUP BY 1"),
    "parsed_metrics": (parsed_metrics, f"WITH {TOLD}, pred AS (SELECT gold AS y_true, before AS y_pred FROM t WHERE doc_id % 11 <> 0 AND before IS NOT NULL), k AS (SELECT class, (SELECT count(*) FROM pred WHERE y_true = class AND y_pred = class) AS tp, (SELECT count(*) FROM pred WHERE y_true = class) AS n_true, (SELECT count(*) FROM pred WHERE y_pred = class) AS n_pred FROM range(8) AS c(class)), per AS (SELECT *, CASE WHEN n_true = 0 THEN 0.0 ELSE tp::DOUBLE / n_true END AS recall, 2.0::DOUBLE * tp / (n_true + n_pred) AS f1 FROM k WHERE n_true + n_pred > 0) " + SUMMARY.format(w="")),
    "language_classifier": (language_classifier, None),
    "manual_agreement": (manual_agreement, f"WITH {TOLD} SELECT count(*) FILTER (doc_id % 6 <> 0) AS n, round(coalesce(count(*) FILTER (doc_id % 6 <> 0 AND gold = model) / nullif(count(*) FILTER (doc_id % 6 <> 0), 0)::DOUBLE, 0), 6) AS agreement, round(avg(doc_id % 10 / 10.0::DOUBLE), 6) AS mean_confidence FROM t"),
    "duration_stats": (duration_stats, "WITH d AS (SELECT floor(o_totalprice)::BIGINT % 3000 / 100.0::DOUBLE - 2 AS d FROM orders) SELECT count(*) FILTER (d > 0) AS n, count(*) FILTER (d <= 0) AS rejected, round(min(d) FILTER (d > 0), 6) AS shortest, round(max(d) FILTER (d > 0), 6) AS longest, round(avg(d) FILTER (d > 0), 6) AS mean FROM d"),
    "source_split_ids": (source_split_ids, "SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'test_ood' WHEN source IN ('src1', 'src2') THEN 'test_id' ELSE 'train' END AS split FROM documents"),
    "label_metrics_by_fold": (label_metrics_by_fold, f"WITH {TOLD}, s AS (SELECT (doc_id % 5)::INTEGER AS fold, count(*) AS n, count(*) FILTER (gold = model) AS h FROM t GROUP BY 1) SELECT fold, n, round(h / n::DOUBLE, 6) AS accuracy, round((sum(h) OVER () - h) / (sum(n) OVER () - n)::DOUBLE, 6) AS others, round(avg(h / n::DOUBLE) OVER (), 6) AS mean FROM s"),
}

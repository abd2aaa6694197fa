"""Joins, splits, vectors, losses, boxes and star-schema queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipwright.functions import arrays as A
from clipwright.operators import boxes as B
from clipwright.operators import splits as S
from clipwright.plans.evaluation import PRED, predictions, r6
from clipwright.sources.tables import table


def split_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in a seeded order, divided in proportion without a stratum."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return S.proportional(docs, [S.seeded("doc_id", 9), F.col("doc_id")], ["train", "val", "test", "ood"], [0.7, 0.15, 0.1, 0.05])


def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return S.proportional(docs, [S.seeded("doc_id", 7), F.col("doc_id")], ["train", "val", "test", "ood"], [0.7, 0.15, 0.1, 0.05], "lang", "source")


def leave_one_source_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("held_out")).withColumn("trained_on", F.sum("held_out").over(Window.partitionBy()) - F.col("held_out"))


def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.todo(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


def features_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")


def cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "documents").filter("doc_id % 5 = 0").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"))
    return S.merge_cache(table(spark, sf_dir, "labels").select("doc_id", "quality"), new, "doc_id")


def variant_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pick_variant(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 3)


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    side = lambda kind, name: e.filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name))
    return S.positional_zip(side("click", "clicked"), side("view", "viewed"), "clicked", "viewed", "user_id")


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves of an embedding as logits of a student and a teacher."""
    v = A.doubles(F.col("embedding"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", A.block(v, 0, 32).alias("a"), A.block(v, 1, 32).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select(
        "vec_id", r6(A.cross_entropy(a, F.col("label")), "ce"), r6(A.focal(a, F.col("label"), 2.0), "focal"),
        r6(A.kl_divergence(a, b, 2.0), "kl"), r6(A.smooth_l1(a, b), "smooth_l1"), r6(A.total(A.mix(a, b, 0.3)), "mixed"),
    )


def late_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the softmax of four blocks, and its first greatest class."""
    v = A.doubles(F.col("embedding"))
    parts = [A.softmax(A.block(v, b, 16)) for b in range(4)]
    fused = reduce(lambda x, y: F.zip_with(x, y, lambda p, q: p + q), parts)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(fused, lambda x: F.round(x / 4, 9)).alias("p"))
    return rows.select("vec_id", A.argmax(F.col("p")).alias("y_pred"), r6(F.array_max("p"), "confidence"))


def nearest_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest classes, within the row: no window, no shuffle."""
    ranked = F.slice(F.array_sort(F.transform("scores", lambda s, i: F.struct((-s).alias("far"), i.alias("class")))), 1, 3)
    long = predictions(spark, sf_dir).select("vec_id", F.posexplode(ranked).alias("place", "x"))
    return long.select("vec_id", (F.col("place") + 1).alias("rank"), F.col("x.class").alias("class"), r6(-F.col("x.far"), "score"))


def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hinge on the margin to the best other class, and the centroid silhouette."""
    rest = F.array_max(F.filter("scores", lambda s, i: i != F.col("y_true")))
    rows = predictions(spark, sf_dir).select("vec_id", "y_true", F.element_at("scores", F.col("y_true") + 1).alias("own"), rest.alias("other"))
    near, far = 1 - F.col("own"), 1 - F.col("other")
    rows = rows.withColumn("hinge", F.greatest(F.lit(0.0), 0.2 - (F.col("own") - F.col("other")))).withColumn("silhouette", F.coalesce(F.try_divide(far - near, F.greatest(near, far)), F.lit(0.0)))
    return rows.groupBy("y_true").agg(F.count("*").alias("n"), r6(F.avg("hinge"), "hinge"), r6(F.avg("silhouette"), "silhouette"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c, n, d: F.pmod(F.col(c).cast("long"), F.lit(n)) / float(d)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", part("l_partkey", 80, 100).alias("xmin"), part("l_suppkey", 70, 100).alias("ymin"),
        (F.col("l_linenumber") / 20.0).alias("width"), ((F.pmod(F.col("l_quantity").cast("long"), F.lit(30)) + 1) / 100.0).alias("height"),
    )


def bbox_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", r6(B.area(), "area"), r6(B.edge_distance(), "edge"), B.corner().alias("corner"), B.is_valid().alias("valid"))


def median_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.median_box(_boxes(spark, sf_dir), "l_orderkey").select("l_orderkey", "n", *[r6(c) for c in B.SIDES])


def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.overlap_with_next(_boxes(spark, sf_dir), "l_orderkey", "l_linenumber", "xmin", "ymin", "height").select("l_orderkey", "l_linenumber", r6("iou"))


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        r6(F.sum("l_quantity"), "sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), r6(F.avg("l_discount"), "avg_disc"), F.count("*").alias("n"))


def revenue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers meet orders on the key; the two small dimensions go by Spark's own choice."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"))
    return spent.join(c, "c_custkey").rollup("r_name", "n_name").agg(F.round(F.sum("spent"), 2).alias("spent"), F.count("*").alias("customers"))


def top_customers_per_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return c.withColumn("rank", rank).filter("rank <= 3")


def priority_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.fillna(0)


RANKED = "SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY md5(doc_id::VARCHAR || ':7'), doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang, source) AS n FROM documents"
BOXES = "WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 80 / 100.0::DOUBLE AS xmin, l_suppkey % 70 / 100.0::DOUBLE AS ymin, l_linenumber / 20.0::DOUBLE AS width, (trunc(l_quantity)::BIGINT % 30 + 1) / 100.0::DOUBLE AS height FROM lineitem)"
LOSS = """WITH v AS (SELECT vec_id, label, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings),
e AS (SELECT *, ln(list_sum(list_transform(a, lambda x: exp(x)))) AS la, ln(list_sum(list_transform(a, lambda x: exp(x / 2)))) AS ha, ln(list_sum(list_transform(b, lambda x: exp(x / 2)))) AS hb FROM v),
c AS (SELECT *, la - a[label + 1] AS ce FROM e)
SELECT vec_id, round(ce, 6) AS ce, round(power(1 - exp(-ce), 2) * ce, 6) AS focal,
 round(4 * list_sum(list_transform(range(1, 33), lambda i: exp(a[i] / 2 - ha) * (a[i] / 2 - ha - b[i] / 2 + hb))), 6) AS kl,
 round(list_avg(list_transform(range(1, 33), lambda i: CASE WHEN abs(a[i] - b[i]) < 1 THEN 0.5 * power(a[i] - b[i], 2) ELSE abs(a[i] - b[i]) - 0.5 END)), 6) AS smooth_l1,
 round(0.3::DOUBLE * list_sum(a) + 0.7::DOUBLE * list_sum(b), 6) AS mixed FROM c"""
FUSED = """WITH c AS (SELECT vec_id, b.b, k.k, exp(embedding[b.b * 16 + k.k + 1]::DOUBLE) AS e FROM embeddings, range(4) AS b(b), range(16) AS k(k)),
p AS (SELECT vec_id, k, e / sum(e) OVER (PARTITION BY vec_id, b) AS p FROM c),
f AS (SELECT vec_id, k, round(avg(p), 9) AS p FROM p GROUP BY vec_id, k)
SELECT vec_id, k::INTEGER AS y_pred, round(p, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) AS r FROM f) AS x WHERE r = 1"""

QUERIES = {
    "split_seeded": (split_seeded, "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':9'), doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), e AS (SELECT *, floor(n * 0.7::DOUBLE) AS a, floor(n * 0.15::DOUBLE) AS b, floor(n * 0.1::DOUBLE) AS c FROM r) SELECT doc_id, CASE WHEN i < a THEN 'train' WHEN i < a + b THEN 'val' WHEN i < a + b + c THEN 'test' ELSE 'ood' END AS split FROM e"),
    "split_stratified": (split_stratified, f"WITH r AS ({RANKED}), e AS (SELECT *, floor(n * 0.7::DOUBLE) AS a, floor(n * 0.15::DOUBLE) AS b, floor(n * 0.1::DOUBLE) AS c FROM r) SELECT doc_id, lang, source, CASE WHEN i < a THEN 'train' WHEN i < a + b THEN 'val' WHEN i < a + b + c THEN 'test' ELSE 'ood' END AS split FROM e"),
    "leave_one_source_out": (leave_one_source_out, "SELECT source, count(*) AS held_out, (SELECT count(*) FROM documents) - count(*) AS trained_on FROM documents GROUP BY source"),
    "resume_anti": (resume_anti, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
    "features_semi": (features_semi, "SELECT * FROM labels WHERE doc_id IN (SELECT vec_id FROM embeddings)"),
    "cache_merge": (cache_merge, "SELECT doc_id, coalesce(n.quality, o.quality) AS quality FROM labels AS o FULL JOIN (SELECT doc_id, (n_chars % 2)::INTEGER AS quality FROM documents WHERE doc_id % 5 = 0) AS n USING (doc_id)"),
    "variant_pick": (variant_pick, "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(o_orderkey::VARCHAR || ':3'), o_orderkey) AS r FROM orders) AS x WHERE r = 1"),
    "positional_zip": (positional_zip, "WITH e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id)::INTEGER AS position FROM events) SELECT user_id, position, a.event_id AS clicked, b.event_id AS viewed FROM (SELECT * FROM e WHERE event_type = 'click') AS a FULL JOIN (SELECT * FROM e WHERE event_type = 'view') AS b USING (user_id, position)"),
    "losses": (losses, LOSS),
    "late_fusion": (late_fusion, FUSED),
    "nearest_topk": (nearest_topk, PRED + "SELECT vec_id, r::INTEGER AS rank, class, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, class) AS r FROM sims) AS x WHERE r <= 3"),
    "margins": (margins, PRED + ", m AS (SELECT vec_id, y_true, max(s) FILTER (class = y_true) AS own, max(s) FILTER (class <> y_true) AS other FROM sims GROUP BY ALL) SELECT y_true, count(*) AS n, round(avg(greatest(0, 0.2 - (own - other))), 6) AS hinge, round(avg(coalesce((own - other) / nullif(greatest(1 - own, 1 - other), 0), 0)), 6) AS silhouette FROM m GROUP BY y_true"),
    "bbox_geometry": (bbox_geometry, BOXES + "SELECT l_orderkey, l_linenumber, round(width * height, 6) AS area, round(least(xmin + width / 2, ymin + height / 2, 1 - xmin - width / 2, 1 - ymin - height / 2), 6) AS edge, CASE WHEN round(ymin + height / 2, 9) < 0.5 THEN 'top' ELSE 'bottom' END || '_' || CASE WHEN round(xmin + width / 2, 9) < 0.5 THEN 'left' ELSE 'right' END AS corner, xmin BETWEEN 0 AND 1 AND ymin BETWEEN 0 AND 1 AND width > 0 AND height > 0 AND round(xmin + width, 9) <= 1 AND round(ymin + height, 9) <= 1 AS valid FROM b"),
    "median_box": (median_box, BOXES + "SELECT l_orderkey, count(*) AS n, round(median(xmin), 6) AS xmin, round(median(ymin), 6) AS ymin, round(median(width), 6) AS width, round(median(height), 6) AS height FROM b GROUP BY l_orderkey"),
    "box_overlap": (box_overlap, BOXES + ", p AS (SELECT *, lead(xmin) OVER w AS x, lead(ymin) OVER w AS y, lead(width) OVER w AS ww, lead(height) OVER w AS hh FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, xmin, ymin, height)), i AS (SELECT *, greatest(0, least(xmin + width, x + ww) - greatest(xmin, x)) * greatest(0, least(ymin + height, y + hh) - greatest(ymin, y)) AS shared FROM p WHERE x IS NOT NULL) SELECT l_orderkey, l_linenumber, round(shared / (width * height + ww * hh - shared), 6) AS iou FROM i"),
    "pricing_summary": (pricing_summary, "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"),
    "revenue_rollup": (revenue_rollup, "WITH s AS (SELECT o_custkey AS c_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY 1) SELECT r_name, n_name, round(sum(spent), 2) AS spent, count(*) AS customers FROM s JOIN customer USING (c_custkey) JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)"),
    "top_customers_per_nation": (top_customers_per_nation, "SELECT * FROM (SELECT c_custkey, c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INTEGER AS rank FROM customer) AS x WHERE rank <= 3"),
    "priority_pivot": (priority_pivot, "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1"),
}

"""Box queries: order lines and events stand for detections in frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipwright.operators import boxes as B
from clipwright.operators import series as S
from clipwright.plans.evaluation import r6
from clipwright.plans.relations import BOXES, _boxes
from clipwright.plans.sequences import ORDER, SEQ, frames
from clipwright.sources.tables import table

WIDE, HIGH = 1920, 1080
#: Detections on events; a few clips have two of them. A third of the users has one place for
#: all, a third for half of them. Places are multiples of 1/213, so that no distance between
#: two of them comes near 0.08 or 0.05, and no mean ends in a 5 at the seventh digit.
_FIXED = "(user_id % 3 = 0 OR user_id % 3 = 1 AND event_id % 2 = 0)"
_part = lambda n: f"CASE WHEN {_FIXED} THEN user_id % {n} ELSE event_id % {n} END"
FOUND = f"""SELECT CASE WHEN event_id % 50 = 0 THEN 1000000 + CAST(floor(event_id / 100.0) AS BIGINT) ELSE user_id END AS clip_id, event_id,
 CAST(40 * ({_part(4)}) + event_id * 7 % 10 AS DOUBLE) / 213D AS xmin, CAST(50 * ({_part(3)}) + event_id * 11 % 10 AS DOUBLE) / 213D AS ymin,
 CAST({_part(6)} + 1 AS DOUBLE) / 21.3D AS width, CAST({_part(8)} + 1 AS DOUBLE) / 10.65D AS height FROM events"""
EPS, EPS_MEAN = 0.08, 0.05
#: The same for DuckDB, where a literal with a point is a decimal.
FOUND_SQL = FOUND.replace("213D", "213::DOUBLE").replace("21.3D", "21.3::DOUBLE").replace("10.65D", "10.65::DOUBLE")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_columns())


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir)
    counts = found.groupBy("clip_id").agg(F.count("*").alias("n_sampled"))
    return found.join(counts, "clip_id")


def _columns() -> list[str]:
    """The select list of FOUND, item by item."""
    body, items, depth, item = FOUND.removeprefix("SELECT ").removesuffix(" FROM events"), [], 0, ""
    for c in body:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            items, item = [*items, item], ""
        else:
            item += c
    return [*items, item]


def webcam_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stable region of small detections, expanded, with stability and edge distance."""
    found = B.stable_region(B.small_or_all(_found(spark, sf_dir), "clip_id"), "clip_id", "event_id", eps=EPS)
    grown = found.select("clip_id", "n_sampled", "n_in", *B.expanded())
    return _told(grown)


def webcam_region_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other setting: all detections, five for a core, mean instead of median, not expanded."""
    found = B.stable_region(detections(spark, sf_dir), "clip_id", "event_id", eps=EPS_MEAN, least=5, stability=0.4, middle="mean", fallback=False)
    return _told(found)


def _told(found: DataFrame) -> DataFrame:
    return found.select("clip_id", *[r6(c) for c in B.SIDES], r6(F.col("n_in") / F.col("n_sampled"), "stability"), r6(B.edge_distance(), "edge"))


def core_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.core_counts(detections(spark, sf_dir), "clip_id", "event_id", EPS)


def small_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.small_or_all(_found(spark, sf_dir), "clip_id", 0.02).select("clip_id", "event_id")


def bbox_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with all five fields in [0, 1], and rejects, by what they have."""
    rows = detections(spark, sf_dir).withColumn("stability", (F.col("event_id") % 25) / 20.0)
    return rows.groupBy(B.in_range(*B.SIDES, "stability").alias("valid")).agg(F.count("*").alias("n"))


def box_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(n) for c, n in zip(B.expanded(), B.SIDES, strict=True)])


def _crops(margin: float):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", B.crop(WIDE, HIGH, margin).alias("c")).select("l_orderkey", "l_linenumber", "c.*")

    return query


def corner_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", F.explode(B.remapped(1280, 720)).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", F.col("b.corner").alias("corner"), *[r6(f"b.{c}", c) for c in B.SIDES])


def keypoint_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("e"))
    at = lambda k: F.get("e", 3 * F.col("i") + k)
    points = e.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("vec_id", (at(0) * 400).alias("x"), (at(1) * 400).alias("y"), at(2).alias("conf"))
    return B.keypoint_box(points, "vec_id", 1280, 720).select("vec_id", *[r6(c) for c in B.SIDES])


def bbox_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's box: of its detections the best, else the clip's stable one, else null."""
    boxes = _boxes(spark, sf_dir)
    stable = B.median_box(boxes, "l_orderkey").filter("n >= 3").select("l_orderkey", F.struct(*B.SIDES).alias("stable"))
    shown = boxes.filter("l_linenumber % 4 <> 0")
    other = shown.select("l_orderkey", "l_linenumber", (F.col("xmin") / 2).alias("xmin"), "ymin", (F.col("width") * 1.5).alias("width"), "height", F.lit(1).alias("k"))
    found = shown.withColumn("k", F.lit(0)).unionByName(other)
    rows = boxes.select("l_orderkey", "l_linenumber").distinct().join(found, ["l_orderkey", "l_linenumber"], "left").join(stable, "l_orderkey", "left")
    best = rows.groupBy("l_orderkey", "l_linenumber").agg(B.best_of("stable", "k", *B.SIDES).alias("best"), F.first("stable").alias("stable"))
    chosen = F.coalesce("best", "stable")
    return best.select("l_orderkey", "l_linenumber", *[F.round(chosen[c], 6).alias(c) for c in B.SIDES])


def frame_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame of a clip with the clip's one box; frames of clips without one are not valid."""
    boxes = _boxes(spark, sf_dir)
    single = B.median_box(boxes, "l_orderkey").filter("n >= 3").drop("n")
    rows = boxes.select("l_orderkey", "l_linenumber").distinct().join(single, "l_orderkey", "left")
    return rows.select("l_orderkey", "l_linenumber", B.crop(WIDE, HIGH, 0.2).alias("c")).select("l_orderkey", "l_linenumber", "c.*")


def usable_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid frames of a clip; all where none is valid or the mask has another length."""
    seq = S.ordered(frames(spark, sf_dir), "clip_id", ORDER).withColumn("ok", (F.col("event_id") % 3 == 0) & (F.col("clip_id") % 5 != 0)).withColumn("masked", F.col("clip_id") % 4 != 0)
    return S.valid_or_all(seq, "clip_id", "ok", "masked").select("clip_id", "event_id")


def detection_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 evenly spaced frames of each clip, or all of a shorter one."""
    return S.even_sample(frames(spark, sf_dir), "clip_id", ORDER, 30).select("clip_id", "slot", "event_id")


_region = lambda cand, eps, least, share, agg: f"""WITH RECURSIVE d AS ({FOUND_SQL}), n AS (SELECT *, xmin + width / 2 AS cx, ymin + height / 2 AS cy, count(*) OVER (PARTITION BY clip_id) AS n FROM d),
c AS ({cand}), near AS (SELECT a.clip_id, a.event_id AS a, b.event_id AS b FROM c AS a JOIN c AS b ON a.clip_id = b.clip_id AND (a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 <= {eps} * {eps}),
core AS (SELECT clip_id, a AS id FROM near GROUP BY ALL HAVING count(*) >= {least}), r(clip_id, id, root) AS (SELECT clip_id, id, id FROM core UNION SELECT r.clip_id, near.b, r.root FROM r JOIN near ON near.clip_id = r.clip_id AND near.a = r.id JOIN core ON core.clip_id = near.clip_id AND core.id = near.b),
comp AS (SELECT clip_id, id, min(root) AS k FROM r GROUP BY ALL), m AS (SELECT near.clip_id, near.a AS id, min(comp.k) AS k FROM near JOIN comp ON comp.clip_id = near.clip_id AND comp.id = near.b GROUP BY ALL),
g AS (SELECT m.clip_id, m.k, any_value(c.n) AS n, count(*) AS n_in, avg(cx) AS ax, avg(cy) AS ay, {agg}(xmin) AS xmin, {agg}(ymin) AS ymin, {agg}(width) AS width, {agg}(height) AS height FROM m JOIN c ON c.clip_id = m.clip_id AND c.event_id = m.id GROUP BY m.clip_id, m.k),
best AS (SELECT * FROM g WHERE n_in::DOUBLE / n >= {share} AND n_in::DOUBLE / n - least(ax, ay, 1 - ax, 1 - ay) > -1 QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY n_in::DOUBLE / n - least(ax, ay, 1 - ax, 1 - ay) DESC, k) = 1)"""  # noqa: E731
_out = "SELECT clip_id, round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(width, 6) AS width, round(height, 6) AS height, round(n_in::DOUBLE / n, 6) AS stability, round(least(xmin + width / 2, ymin + height / 2, 1 - xmin - width / 2, 1 - ymin - height / 2), 6) AS edge FROM "
_crop = lambda m, src: f"SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN x1 END AS x1, CASE WHEN ok THEN y1 END AS y1, CASE WHEN ok THEN x2 END AS x2, CASE WHEN ok THEN y2 END AS y2, ok AS valid FROM (SELECT *, xmin IS NOT NULL AND x2 > x1 AND y2 > y1 AS ok FROM (SELECT *, greatest(0, trunc((xmin - {m}::DOUBLE * width) * {WIDE})::INTEGER) AS x1, greatest(0, trunc((ymin - {m}::DOUBLE * height) * {HIGH})::INTEGER) AS y1, least({WIDE}, trunc((xmin + width * (1 + {m}::DOUBLE)) * {WIDE})::INTEGER) AS x2, least({HIGH}, trunc((ymin + height * (1 + {m}::DOUBLE)) * {HIGH})::INTEGER) AS y2 FROM {src}) AS a) AS b"
_grow = "greatest(0, xmin - width * 0.5::DOUBLE) AS xmin, greatest(0, ymin - height * 1.5::DOUBLE * 0.3::DOUBLE) AS ymin, least(1 - greatest(0, xmin - width * 0.5::DOUBLE), width * 2) AS width, least(1 - greatest(0, ymin - height * 1.5::DOUBLE * 0.3::DOUBLE), height * 2.5::DOUBLE) AS height"
_small = "SELECT * FROM n QUALIFY width * height < {0} OR max((width * height < {0})::INTEGER) OVER (PARTITION BY clip_id) = 0"
_MED = ", s AS (SELECT l_orderkey, median(xmin) AS xmin, median(ymin) AS ymin, median(width) AS width, median(height) AS height FROM b GROUP BY l_orderkey HAVING count(*) >= 3), f AS (SELECT DISTINCT l_orderkey, l_linenumber FROM b)"
QUERIES = {
    "webcam_region": (webcam_region, _region(_small.format("0.25::DOUBLE"), f"{EPS}::DOUBLE", 3, "0.3::DOUBLE", "median") + f""", few AS (SELECT clip_id, any_value(n) AS n, count(*) AS n_in, arg_max(least(cx, cy, 1 - cx, 1 - cy), struct_pack(a := width * height, b := -event_id)) AS edge, median(xmin) AS xmin, median(ymin) AS ymin, median(width) AS width, median(height) AS height FROM c GROUP BY clip_id HAVING count(*) = 2),
u AS (SELECT clip_id, n, n_in, xmin, ymin, width, height FROM best UNION ALL SELECT clip_id, n, n_in, xmin, ymin, width, height FROM few WHERE edge < 0.3::DOUBLE), w AS (SELECT clip_id, n, n_in, {_grow} FROM u) {_out} w"""),
    "webcam_region_mean": (webcam_region_mean, _region("SELECT * FROM n", f"{EPS_MEAN}::DOUBLE", 5, "0.4::DOUBLE", "avg") + f" {_out} best"),
    "core_points": (core_points, f"WITH d AS ({FOUND_SQL}), n AS (SELECT *, xmin + width / 2 AS cx, ymin + height / 2 AS cy FROM d) SELECT a.clip_id, a.event_id, count(*) AS n_near FROM n AS a JOIN n AS b ON a.clip_id = b.clip_id AND (a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 <= {EPS}::DOUBLE * {EPS}::DOUBLE GROUP BY ALL"),
    "small_detections": (small_detections, f"WITH n AS ({FOUND_SQL}) SELECT clip_id, event_id FROM ({_small.format('0.02::DOUBLE')}) AS x"),
    "bbox_constraint": (bbox_constraint, f"WITH n AS ({FOUND_SQL}) SELECT xmin BETWEEN 0 AND 1 AND ymin BETWEEN 0 AND 1 AND width BETWEEN 0 AND 1 AND height BETWEEN 0 AND 1 AND event_id % 25 / 20.0 BETWEEN 0 AND 1 AS valid, count(*) AS n FROM n GROUP BY 1"),
    "box_expansion": (box_expansion, BOXES + f", g AS (SELECT l_orderkey, l_linenumber, {_grow} FROM b) SELECT l_orderkey, l_linenumber, round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(width, 6) AS width, round(height, 6) AS height FROM g"),
    "face_crops": (_crops(0.2), BOXES + _crop(0.2, "b")),
    "region_crops": (_crops(0.1), BOXES + _crop(0.1, "b")),
    "corner_remap": (corner_remap, BOXES + ", k AS (SELECT * FROM (VALUES (0, 0, 0), (1, 832, 0), (2, 0, 469), (3, 832, 469)) AS v(corner, x0, y0)) SELECT l_orderkey, l_linenumber, corner, round((x0 + xmin * 448) / 1280, 6) AS xmin, round((y0 + ymin * 251) / 720, 6) AS ymin, round(width * 448 / 1280, 6) AS width, round(height * 251 / 720, 6) AS height FROM b, k"),
    "keypoint_box": (keypoint_box, "WITH p AS (SELECT vec_id, abs(embedding[3 * k.i + 1]::DOUBLE) * 400 AS x, abs(embedding[3 * k.i + 2]::DOUBLE) * 400 AS y FROM embeddings, range(5) AS k(i) WHERE abs(embedding[3 * k.i + 3]::DOUBLE) > 0.3), e AS (SELECT vec_id, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM p GROUP BY vec_id HAVING count(*) >= 2), h AS (SELECT *, greatest(x2 - x1, y2 - y1, 1) * 1.6::DOUBLE / 2 AS half FROM e), s AS (SELECT vec_id, greatest(0, (x1 + x2) / 2 - half) / 1280 AS xmin, greatest(0, (y1 + y2) / 2 - half) / 720 AS ymin, least(1280, (x1 + x2) / 2 + half) / 1280 AS xmax, least(720, (y1 + y2) / 2 + half) / 720 AS ymax FROM h) SELECT vec_id, round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(xmax - xmin, 6) AS width, round(ymax - ymin, 6) AS height FROM s"),
    "bbox_choice": (bbox_choice, BOXES + _MED + """, d AS (SELECT *, 0 AS k FROM b WHERE l_linenumber % 4 <> 0 UNION ALL SELECT l_orderkey, l_linenumber, xmin / 2, ymin, width * 1.5::DOUBLE, height, 1 FROM b WHERE l_linenumber % 4 <> 0),
j AS (SELECT d.*, CASE WHEN s.xmin IS NULL THEN -d.width * d.height ELSE ((d.xmin + d.width / 2) - (s.xmin + s.width / 2)) ** 2 + ((d.ymin + d.height / 2) - (s.ymin + s.height / 2)) ** 2 END AS far FROM d LEFT JOIN s USING (l_orderkey)), o AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY far, k, xmin, ymin, width, height) = 1)
SELECT f.l_orderkey, f.l_linenumber, round(coalesce(o.xmin, s.xmin), 6) AS xmin, round(coalesce(o.ymin, s.ymin), 6) AS ymin, round(coalesce(o.width, s.width), 6) AS width, round(coalesce(o.height, s.height), 6) AS height FROM f LEFT JOIN o USING (l_orderkey, l_linenumber) LEFT JOIN s ON s.l_orderkey = f.l_orderkey"""),
    "frame_crops": (frame_crops, BOXES + _MED + ", x AS (SELECT f.*, s.xmin, s.ymin, s.width, s.height FROM f LEFT JOIN s USING (l_orderkey)) " + _crop(0.2, "x")),
    "usable_frames": (usable_frames, SEQ + ", m AS (SELECT clip_id, event_id, event_id % 3 = 0 AND clip_id % 5 <> 0 AS ok, clip_id % 4 <> 0 AS masked FROM f) SELECT clip_id, event_id FROM m QUALIFY ok OR NOT masked OR NOT bool_or(ok) OVER (PARTITION BY clip_id)"),
    "detection_frames": (detection_frames, SEQ + ", s AS (SELECT DISTINCT clip_id, n, t.slot FROM f, range(30) AS t(slot) WHERE t.slot < n) SELECT s.clip_id, s.slot::INTEGER AS slot, f.event_id FROM s JOIN f ON f.clip_id = s.clip_id AND f.i = CASE WHEN least(30, s.n) = 1 THEN 0 ELSE (s.slot * (s.n - 1)) // (least(30, s.n) - 1) END"),
}

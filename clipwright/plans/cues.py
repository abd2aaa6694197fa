"""Cue queries: measures that a document's number stands in for, and its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipwright.functions import cues as C
from clipwright.functions import text as T
from clipwright.plans.evaluation import r6
from clipwright.plans.texts import GAMES, NEGATIVE, TEXT_CUES, W
from clipwright.sources.tables import table

#: Stand-ins for measured values, read alike by both engines.
MEASURES = {
    "ear": "CAST(doc_id % 40 AS DOUBLE) / 100", "mar": "CAST(doc_id % 50 AS DOUBLE) / 80", "brow_h": "CAST(doc_id % 9 AS DOUBLE) / 100",
    "yaw": "CAST(doc_id % 61 AS DOUBLE) - 30", "pitch": "CAST(doc_id % 37 AS DOUBLE) - 18", "seen": "doc_id % 7 <> 0",
    "f0": "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST(doc_id % 35 AS DOUBLE) * 10 END", "rms": "CAST(doc_id % 12 AS DOUBLE) / 100", "duration": "CAST(doc_id % 8 AS DOUBLE)",
    "energy": "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST(doc_id % 20 AS DOUBLE) / 100 END", "impact": "CAST(doc_id % 25 AS DOUBLE) / 100", "period": "CAST(doc_id % 10 AS DOUBLE) / 10",
}
_LIST = ", ".join(f"{v} AS {k}" for k, v in MEASURES.items())


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of each document beside the counts of its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    split = docs.select("doc_id", "text", T.words(F.lower("text")).alias("w"))
    names = ["exclaims", "negatives", "games", "n_words"]
    counted = split.select("doc_id", *[c.alias(n) for c, n in zip(T.text_counts(F.col("text"), F.col("w"), NEGATIVE, GAMES), names, strict=True)])
    return counted.selectExpr("*", *[f"{v} AS {k}" for k, v in MEASURES.items()])


def _parts() -> dict[str, tuple[Column, Column]]:
    c = F.col
    return {
        "face": C.face_cue(c("seen"), c("ear"), c("mar"), c("brow_h"), c("yaw"), c("pitch")),
        "voice": C.voice_cue(c("f0"), c("rms"), c("n_words"), c("duration")),
        "motion": C.motion_cue(c("energy"), c("impact"), c("period")),
        "text": T.text_cue(c("exclaims"), c("negatives"), c("games"), c("n_words")),
    }


def face_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, values = _parts()["face"]
    return measured(spark, sf_dir).select("doc_id", told.alias("cue"), *[r6(values[i], f"v{i}") for i in range(5)])


def voice_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, values = _parts()["voice"]
    return measured(spark, sf_dir).select("doc_id", told.alias("cue"), *[r6(values[i], f"v{i}") for i in range(3)])


def motion_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, values = _parts()["motion"]
    return measured(spark, sf_dir).select("doc_id", told.alias("cue"), *[r6(values[i], f"v{i}") for i in range(3)])


def composite_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cue texts with and without motion, and the attributes' number and sum."""
    p = _parts()
    (long, all15), (short, all12) = C.composite(p["face"], p["voice"], p["text"], p["motion"]), C.composite(p["face"], p["voice"], p["text"])
    # Added up part by part, so that the order of addition is stated.
    face, voice, motion, text = (F.aggregate(p[k][1], F.lit(0.0), lambda a, x: a + x) for k in ("face", "voice", "motion", "text"))
    sum15, sum12 = face + voice + motion + text, face + voice + text
    return measured(spark, sf_dir).select("doc_id", long.alias("cue15"), short.alias("cue12"), F.size(all15).alias("n15"), F.size(all12).alias("n12"), r6(sum15, "sum15"), r6(sum12, "sum12"))


def attribute_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen attributes, long."""
    p = _parts()
    _, values = C.composite(p["face"], p["voice"], p["text"], p["motion"])
    long = measured(spark, sf_dir).select("doc_id", F.posexplode(values).alias("i", "x"))
    return long.select("doc_id", "i", r6("x"))


def grounded_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of all eight reconstructed attributes; scaled as the attribute vector is."""
    scaled = {"ear": F.col("ear"), "mar": F.col("mar"), "brow_h": F.col("brow_h"), "yaw": F.col("yaw") / 45, "pitch": F.col("pitch") / 45, "f0": F.col("f0") / 300, "rms": F.col("rms") / 0.1, "rate": F.col("duration") / 5}
    bins = {n: C.grounded(n, v) for n, v in scaled.items()}
    face = F.when(F.col("seen"), F.concat_ws(", ", *[bins[n] for n in ("ear", "mar", "brow_h", "yaw", "pitch")])).otherwise(C.NO_FACE)
    return measured(spark, sf_dir).filter("f0 IS NOT NULL").select("doc_id", face.alias("face"), F.concat_ws(", ", *[bins[n] for n in ("f0", "rms", "rate")]).alias("voice"))


def face_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding components as the landmarks' coordinates."""
    ids = F.array(*[F.lit(i) for i in POINTS])
    flat = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    points = flat.select("vec_id", F.posexplode(ids).alias("at", "kp"), "e").select("vec_id", "kp", F.get("e", 2 * F.col("at")).alias("x"), F.get("e", 2 * F.col("at") + 1).alias("y"))
    found = C.face_geometry(points, "vec_id")
    return found.select("vec_id", *[r6(c) for c in ("ear", "mar", "brow_h", "yaw", "pitch")])


def rule_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda n, k=0: F.col("doc_id") % n == k
    label = C.label_by_rules(d(2), d(3), d(5), d(7), d(3, 1), d(5, 1), d(7, 1), d(2, 1))
    return table(spark, sf_dir, "documents").select("doc_id", label.alias("label"))


def dominant_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event type with 60 % of a user's value, if there is one."""
    found = C.dominant(table(spark, sf_dir, "events"), "user_id", "event_type", "value")
    return found.select("user_id", "event_type", r6("share"))


def mean_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the voiced (not NaN) values of a user; 0 without one."""
    e = table(spark, sf_dir, "events").withColumn("f0", F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    voiced = F.avg(F.when(~F.isnan("f0"), F.col("f0")))
    return e.groupBy("user_id").agg(r6(F.coalesce(voiced, F.lit(0.0)), "f0"))


POINTS = sorted({i for v in C.MESH.values() for i in (v if isinstance(v, tuple) else (v,))})
_case = lambda value, bins, last: "CASE " + " ".join(f"WHEN {value} < {b} THEN '{l}'" for b, l in bins) + f" ELSE '{last}' END"
_x = lambda i: f"embedding[{2 * POINTS.index(i) + 1}]::DOUBLE"
_y = lambda i: f"embedding[{2 * POINTS.index(i) + 2}]::DOUBLE"
_dist = lambda a, b: f"sqrt(({_x(a)} - {_x(b)}) ** 2 + ({_y(a)} - {_y(b)}) ** 2)"
_ratio = lambda a, b, c, d, e, f: f"(({_dist(a, b)} + {_dist(c, d)}) / (2.0::DOUBLE * greatest({_dist(e, f)}, 1e-6)))"
_lean = lambda a, b, k: f"CASE WHEN {a} + {b} > 1e-6 THEN ({a} - {b}) / ({a} + {b}) * {k} ELSE 0 END"
_abs = lambda a, b: f"abs({a} - {b})"
CUES = f"""WITH m AS (SELECT doc_id, {_LIST}, {W.format(t="lower(coalesce(text, ''))")} AS w FROM documents),
t AS ({TEXT_CUES}),
p AS (SELECT m.*, t.cue AS text_cue, exclaims, negatives, games, length, len(w) / greatest(duration, 0.1)::DOUBLE AS rate FROM m JOIN t USING (doc_id)),
f AS (SELECT *, concat_ws(', ', CASE WHEN ear > 0.25 THEN 'eyes=wide' WHEN ear < 0.18 THEN 'eyes=narrow' END, CASE WHEN mar > 0.4 THEN 'mouth=open' WHEN mar < 0.15 THEN 'mouth=closed' END,
  CASE WHEN brow_h > 0.06 THEN 'brows=raised' WHEN brow_h < 0.03 THEN 'brows=lowered' END, CASE WHEN yaw > 15 THEN 'head_turn=left' WHEN yaw < -15 THEN 'head_turn=right' END,
  CASE WHEN pitch > 10 THEN 'head_tilt=up' WHEN pitch < -10 THEN 'head_tilt=down' END) AS parts, {_case("energy", *C.ENERGY)} AS e, {_case("impact", *C.IMPACT)} AS i, {_case("period", *C.PERIOD)} AS r FROM p),
c AS (SELECT *, CASE WHEN NOT seen THEN 'no_webcam' WHEN parts = '' THEN 'neutral_pose' ELSE parts END AS face_cue,
  CASE WHEN f0 IS NULL THEN 'no_audio' ELSE 'pitch=' || {_case("f0", *C.PITCH)} || ', energy=' || {_case("rms", *C.LOUDNESS)} || ', rate=' || {_case("rate", *C.RATE)} END AS voice_cue,
  CASE WHEN energy IS NULL THEN 'no_motion_data' WHEN i = 'strong' THEN 'motion — sharp downward arm impact' WHEN e = 'high' AND r = 'rhythmic' THEN 'motion — high whole-body energy, rhythmic'
   WHEN e = 'high' THEN 'motion — elevated body movement' WHEN e = 'low' AND i = 'none' THEN 'motion — minimal movement' ELSE 'motion — energy=' || e || ', impact=' || i END AS motion_cue,
  CASE WHEN seen THEN [ear, mar, brow_h, yaw / 45, pitch / 45] ELSE [0, 0, 0, 0, 0] END AS fv, CASE WHEN f0 IS NULL THEN [0, 0, 0] ELSE [f0 / 300, rms / 0.1::DOUBLE, rate / 5] END AS vv,
  CASE WHEN energy IS NULL THEN [0, 0, 0] ELSE [least(energy / 0.15::DOUBLE, 1), least(impact / 0.3::DOUBLE, 1), least(period, 1)] END AS mv, [exclaims, negatives, games, length] AS tv FROM f)
"""
QUERIES = {
    "face_cue": (face_cue, CUES + "SELECT doc_id, face_cue AS cue, " + ", ".join(f"round(fv[{i + 1}], 6) AS v{i}" for i in range(5)) + " FROM c"),
    "voice_cue": (voice_cue, CUES + "SELECT doc_id, voice_cue AS cue, " + ", ".join(f"round(vv[{i + 1}], 6) AS v{i}" for i in range(3)) + " FROM c"),
    "motion_cue": (motion_cue, CUES + "SELECT doc_id, motion_cue AS cue, " + ", ".join(f"round(mv[{i + 1}], 6) AS v{i}" for i in range(3)) + " FROM c"),
    "composite_cue": (composite_cue, CUES + "SELECT doc_id, 'face: ' || face_cue || '; voice: ' || voice_cue || '; motion: ' || motion_cue || '; text: ' || text_cue AS cue15, 'face: ' || face_cue || '; voice: ' || voice_cue || '; text: ' || text_cue AS cue12, 15 AS n15, 12 AS n12, round(list_sum(fv) + list_sum(vv) + list_sum(mv) + list_sum(tv), 6) AS sum15, round(list_sum(fv) + list_sum(vv) + list_sum(tv), 6) AS sum12 FROM c"),
    "attribute_vector": (attribute_vector, CUES + "SELECT doc_id, (k.i - 1)::INTEGER AS i, round((fv || vv || mv || tv)[k.i], 6) AS x FROM c, range(1, 16) AS k(i)"),
    "grounded_bins": (grounded_bins, f"WITH m AS (SELECT doc_id, {_LIST} FROM documents) SELECT doc_id, CASE WHEN seen THEN concat_ws(', ', {_case('ear', *C.GROUNDED['ear'])}, {_case('mar', *C.GROUNDED['mar'])}, {_case('brow_h', *C.GROUNDED['brow_h'])}, {_case('yaw / 45', *C.GROUNDED['yaw'])}, {_case('pitch / 45', *C.GROUNDED['pitch'])}) ELSE '{C.NO_FACE}' END AS face, concat_ws(', ', {_case('f0 / 300', *C.GROUNDED['f0'])}, {_case('rms / 0.1::DOUBLE', *C.GROUNDED['rms'])}, {_case('duration / 5', *C.GROUNDED['rate'])}) AS voice FROM m WHERE f0 IS NOT NULL"),
    "face_geometry": (face_geometry, f"SELECT vec_id, round(({_ratio(*C.MESH['left_eye'])} + {_ratio(*C.MESH['right_eye'])}) / 2, 6) AS ear, round({_ratio(*C.MESH['mouth'])}, 6) AS mar, round((abs({_y(70)} - {_y(159)}) + abs({_y(300)} - {_y(386)})) / 2, 6) AS brow_h, round({_lean(_abs(_x(1), _x(234)), _abs(_x(1), _x(454)), 45)}, 6) AS yaw, round({_lean(_abs(_y(1), _y(10)), _abs(_y(1), _y(152)), 30)}, 6) AS pitch FROM embeddings"),
    "rule_label": (rule_label, "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'hype' WHEN doc_id % 5 = 0 THEN 'tilted' WHEN doc_id % 7 = 0 THEN 'fear' ELSE 'shocked' END WHEN doc_id % 3 = 1 THEN 'amused' WHEN doc_id % 5 = 1 THEN 'disgusted' WHEN doc_id % 7 = 1 THEN 'sad' WHEN doc_id % 2 = 1 AND doc_id % 5 = 0 THEN 'tilted' ELSE 'neutral' END AS label FROM documents"),
    "dominant_type": (dominant_type, "WITH s AS (SELECT user_id, event_type, sum(value) AS w FROM events GROUP BY ALL), r AS (SELECT *, w / sum(w) OVER (PARTITION BY user_id) AS share, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, event_type DESC) AS k FROM s) SELECT user_id, CASE WHEN share >= 0.6 THEN event_type END AS event_type, round(share, 6) AS share FROM r WHERE k = 1"),
    "mean_pitch": (mean_pitch, "SELECT user_id, round(coalesce(avg(value) FILTER (event_id % 4 <> 0), 0), 6) AS f0 FROM events GROUP BY user_id"),
}

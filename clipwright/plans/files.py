"""File queries: tables written to the shared folder in each format and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipwright.functions import arrays as A
from clipwright.functions.lexicons import EMOTIONS
from clipwright.functions.text import GENRES
from clipwright.operators import metrics as M
from clipwright.plans.evaluation import BY_LANG, GROUPED, PRED, _binary, predictions, r6
from clipwright.sources import files as R
from clipwright.sources import ledger as L
from clipwright.sources import sinks as W
from clipwright.sources import tensors as N
from clipwright.sources.tables import fresh_path, table

_pick = lambda names, n: f"CASE doc_id % {n} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(names)) + " ELSE 'odd' END"
EMOTION, GENRE = _pick(EMOTIONS, 10), _pick(GENRES, 6)


def _annotation_lines(spark: SparkSession, sf_dir: str) -> str:
    """Annotations as JSON lines, some cut off, some with unknown labels or boxes out of range,
    some without optional fields, all with a field that no schema knows."""
    docs = table(spark, sf_dir, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    box = "CASE WHEN doc_id % 4 <> 0 THEN named_struct('xmin', CASE WHEN doc_id % 7 = 0 THEN 1.5D ELSE 0.2D END, 'ymin', 0.1D, 'width', 0.2D, 'height', 0.3D, 'stability_score', 0.9D) END"
    agents = "transform(sequence(0, CAST(doc_id % 3 AS INT)), i -> named_struct('agent_name', concat('agent', i), 'model_version', 'v1', 'output', concat('out', i), 'metadata', map('n', CAST(i AS STRING))))"
    fields = f"named_struct('clip_id', CAST(doc_id AS STRING), 'emotion_label', {EMOTION}, 'genre', {GENRE}, 'face_aus', map('AU6', CAST(doc_id % 10 AS DOUBLE) / 2, 'AU12', 4.2D), 'peak_frame_idx', CAST(doc_id % 3 AS INT), 'webcam_bbox', {box}, 'visual_objective_desc', 'v', 'audio_tone_desc', 'a', 'transcript', t, 'reasoning', '', 'annotators', {agents}, 'source_language', CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'vi' ELSE 'en' END, 'created_at', '2024-01-01T00:00:00Z', 'unknown_field', doc_id)"
    path = fresh_path(spark, "annotations")
    docs.selectExpr(f"CASE WHEN doc_id % 17 = 0 THEN substring(to_json({fields}), 1, 40) ELSE to_json({fields}) END AS value").write.text(path)
    return path


def annotation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid annotations with the defaults of what they lack."""
    rows = R.read_annotations(spark, _annotation_lines(spark, sf_dir)).filter(F.size("problems") == 0)
    return rows.select(F.col("clip_id").cast("long").alias("clip_id"), "emotion_label", "genre", "source_language", F.col("webcam_bbox").isNotNull().alias("has_face"), "human_verified", "language_mismatch", F.size("annotators").alias("agents"), R.formatted_aus(F.col("face_aus")).alias("aus"), F.md5("transcript").alias("transcript_md5"))


def annotation_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of what is not valid; a row counts for each of its own."""
    rows = R.read_annotations(spark, _annotation_lines(spark, sf_dir))
    return rows.select(F.explode("problems").alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def annotator_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents of valid annotations, one row each."""
    rows = R.read_annotations(spark, _annotation_lines(spark, sf_dir)).filter(F.size("problems") == 0)
    return rows.select(F.col("clip_id").cast("long").alias("clip_id"), F.inline("annotators")).select("clip_id", "agent_name", "output", F.col("metadata.n").cast("int").alias("n"))


def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the training split, one file each; those of the other splits are broken and
    are not opened."""
    path, train = fresh_path(spark, "documents"), F.col("vec_id") % 10 < 7
    clip = table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("clip_id"), "label", F.when(train, "train").otherwise("val").alias("split"))
    W.write_documents(clip.select("clip_id", F.when(train, F.to_json(F.struct("label"))).otherwise("{broken").alias("document")), path)
    rows = R.read_split(spark, path, clip.select("clip_id", "split"), "train", "label int")
    return rows.select(F.col("clip_id").cast("long").alias("vec_id"), "label")


def raw_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations without a schema: whatever can be parsed, by a field that no schema names."""
    rows = R.read_any(spark, _annotation_lines(spark, sf_dir))
    return rows.select(F.variant_get("value", "$.unknown_field", "long").alias("clip_id"), F.variant_get("value", "$.emotion_label", "string").alias("emotion"))


def peak_frame_aus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intensities at a clip's peak frame; units whose list is shorter are left out."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "map('AU1', array(1.0D, 2.0D, CAST(doc_id % 9 AS DOUBLE)), 'AU4', transform(sequence(0, CAST(doc_id % 4 AS INT)), i -> i / 4.0D)) AS aus", "CAST(doc_id % 5 AS INT) AS peak")
    return docs.select("doc_id", R.peak_aus(F.col("aus"), F.col("peak")).alias("m")).select("doc_id", F.col("m.AU1").alias("au1"), F.col("m.AU4").alias("au4"))


def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "manifest")
    W.write_manifest(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip_id"), F.when(F.col("doc_id") % 10 < 7, "train").otherwise("val").alias("split")), path)
    return R.read_map(spark, path).select(F.col("key").cast("long").alias("clip_id"), F.col("value").alias("split"))


def bbox_map_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes by clip, null where none was found."""
    path = fresh_path(spark, "boxes")
    box = "CASE WHEN vec_id % 3 = 0 THEN 'null' ELSE concat('{\"xmin\": ', vec_id % 10, '.5, \"width\": 0.25}') END"
    table(spark, sf_dir, "embeddings").selectExpr(f"concat('{{\"', vec_id, '\": ', {box}, '}}') AS value").write.text(path)
    return R.read_map(spark, path, R.BOX).select(F.col("key").cast("long").alias("vec_id"), F.col("value.xmin").alias("xmin"), F.col("value.width").alias("width"), F.col("value").isNotNull().alias("found"))


def label_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files of one array each, as flat annotations."""
    path = fresh_path(spark, "labels")
    item = F.struct(F.col("l_id").alias("id"), F.concat(F.lit("raw/"), F.when(F.col("doc_id") % 2 == 0, F.lit("FPS_")).otherwise(F.lit("x_")), F.col("l_id"), F.lit(".mp4")).alias("video"), F.expr(EMOTION).alias("choice"), F.lit(0.5).alias("confidence"))
    labels = table(spark, sf_dir, "labels").withColumn("l_id", F.col("doc_id").cast("string"))
    # A file holds a thousand labels.
    labels.groupBy(F.expr("doc_id div 1000")).agg(F.to_json(F.collect_list(item)).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return R.flat_labels(R.read_label_array(spark, path))


def labels_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labels file joined to the index of videos: every clip has to have one."""
    path, docs = fresh_path(spark, "labels-csv"), table(spark, sf_dir, "documents")
    docs.select(F.concat(F.lit(" "), F.col("doc_id").cast("string")).alias("clip_id"), F.concat(F.upper(F.expr(EMOTION)), F.lit("  ")).alias("emotion_label")).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    name = lambda kind, place: F.concat(F.lit(f"/videos/{place}/"), F.col("doc_id").cast("string"), F.lit(f".{kind}")).alias("path")
    paths = docs.select(name("avi", "a")).unionByName(docs.filter("doc_id % 2 = 0").select(name("MP4", "b"))).unionByName(docs.filter("doc_id % 3 = 0").select(name("mkv", "c"))).unionByName(docs.select(name("txt", "d")))
    rows = R.require(R.read_labels_csv(spark, path), R.index_videos(paths), "clip_id", "video")
    return rows.select(F.col("clip_id").cast("long").alias("clip_id"), "emotion_label", "path")


def _source_list(spark: SparkSession, sf_dir: str, tabbed: bool) -> DataFrame:
    """The pages' urls as lists of a thousand, with comments and blank lines."""
    path, pages = fresh_path(spark, "sources"), table(spark, sf_dir, "pages")
    line = F.concat_ws("\t", "url", F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string")), F.lit("fps")) if tabbed else F.concat(F.lit("  "), F.col("url"))
    head = "# sources\n\nURL\tstreamer\tgenre" if tabbed else "# sources\n"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", line.alias("t")))), lambda x: x["t"]), "\n#x\n\n")
    pages.groupBy(F.expr("page_id div 1000")).agg(F.concat(F.lit(head + "\n"), body).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return R.read_source_list(spark, path)


def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source_list(spark, sf_dir, True).select(F.col("fields.URL").alias("url"), F.col("fields.streamer").alias("streamer"), F.col("fields.genre").alias("genre"))


def source_list_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source_list(spark, sf_dir, False).select(F.col("fields.url").alias("url"))


def au_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide file of intensities, long: spaces in a column's name, no numbers, a column short."""
    path = fresh_path(spark, "aus")
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("clip"), F.col("event_id").alias("frame"), F.when(F.col("event_id") % 6 == 0, "x").otherwise(F.col("value").cast("string")).alias(" AU01_r"), (F.col("event_id") % 10 / 2).cast("string").alias("AU02_r"))
    e.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return R.read_au_csv(spark, path, [1, 2, 12], "clip", "frame").select(F.col("clip").cast("long").alias("clip"), F.col("frame").cast("long").alias("frame"), "au", r6("intensity"))


def feature_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature documents, and the width of a modality told by the first that knows it."""
    path = fresh_path(spark, "features")
    e = table(spark, sf_dir, "embeddings").select(F.format_string("%08d", "vec_id").alias("clip_id"), F.when(F.col("vec_id") > 2, F.array(F.lit(1), F.lit(64), (F.col("vec_id") % 5 + 700).cast("int"))).alias("audio_shape"), (F.col("vec_id") % 2 == 0).alias("has_facecam"))
    W.write_json(e, path)
    metas = R.read_json(spark, path, R.FEATURES)
    dim = R.feature_dim(metas, "audio")
    return metas.groupBy("has_facecam").agg(F.count("*").alias("n"), F.count("audio_shape").alias("known")).crossJoin(F.broadcast(dim))


def cue_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached measures beside all clips: null where a file is absent or broken."""
    path = fresh_path(spark, "cues")
    e = table(spark, sf_dir, "embeddings").filter("vec_id % 5 <> 0")
    e.selectExpr("CASE WHEN vec_id % 7 = 0 THEN '{\"clip_id\": 3, ' ELSE concat('{\"clip_id\": ', vec_id, ', \"energy\": ', vec_id % 9, '.5}') END AS value").write.text(path)
    cache = R.read_json(spark, path, "clip_id long, energy double").filter("_corrupt is null").select("clip_id", "energy")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id")).join(cache, "clip_id", "left")


def predictions_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions appended in two runs of which the second repeats the first: each key once."""
    path = fresh_path(spark, "predictions")
    rows = predictions(spark, sf_dir).select("vec_id", "y_true", F.when(F.col("vec_id") % 7 != 0, F.col("y_pred")).alias("y_pred"))
    W.append_new(rows.filter("vec_id % 2 = 0").withColumn("run", F.lit(1)), path, "vec_id")
    W.append_new(rows.withColumn("run", F.lit(2)), path, "vec_id")
    return spark.read.schema("vec_id long, y_true int, y_pred int, run int").json(path).dropna(subset=["y_true", "y_pred"])


def tensor_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by clip in a cache partitioned by configuration; clips that are there are skipped."""
    path = fresh_path(spark, "tensors")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("tokens"), F.lit("c1").alias("config_hash"))
    e.filter("vec_id % 3 = 0").write.partitionBy("config_hash").parquet(path)
    there = spark.read.parquet(path).filter("config_hash = 'c1'").select("vec_id")
    e.join(there, "vec_id", "left_anti").select(*e.columns).write.mode("append").partitionBy("config_hash").parquet(path)
    cached = spark.read.option("ignoreCorruptFiles", True).parquet(path).filter("config_hash = 'c1'")
    return cached.select("vec_id", F.size("tokens").alias("width"), r6(F.aggregate("tokens", F.lit(0.0), lambda a, x: a + x), "total"))


def tensor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens as array files written in two runs: the second computes what is not there, or was
    made of another clip; shapes come from the lines beside the files."""
    path = fresh_path(spark, "arrays")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("clip_id"), F.lit("text").alias("modality"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    clips = e.withColumn("clip_hash", F.md5(F.array_join("v", ",")))
    tokens = lambda df: df.select("clip_id", "modality", "clip_hash", F.posexplode(A.rows_of(F.col("v"), 8, 8)).alias("row", "values"))
    first = clips.filter("clip_id % 3 = 0").withColumn("clip_hash", F.when(F.expr("clip_id % 2 = 0"), F.col("clip_hash")).otherwise("stale"))
    N.write_tensors(tokens(first), path, config_hash="c1", dtype="float32")
    N.write_tensors(tokens(N.to_compute(clips, path, "c1")), path, config_hash="c1", dtype="float32")
    rows = N.read_tensors(spark, path, modality="text").filter("problem IS NULL")
    read = rows.groupBy("clip_id").agg(F.count("*").alias("n_rows"), r6(F.sum(A.total(F.col("values"))), "total"))
    meta = N.read_meta(spark, path).select("clip_id", F.element_at("shape", -1).alias("width"), (F.col("clip_hash") == "stale").alias("stale"))
    return read.join(meta, "clip_id").select(F.col("clip_id").cast("long").alias("vec_id"), "n_rows", "width", "total", "stale")


def keypoint_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keypoints (frames x 3 x 4) of each user as one array file, read back in ranges of bytes:
    movement between frames, over the points' x."""
    path = fresh_path(spark, "keypoints")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    frames = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("clip_id"), F.lit("pose").alias("modality"), (F.row_number().over(order) - 1).alias("row"), F.expr("transform(sequence(0, 11), i -> value * (i % 4 + 1))").alias("values"))
    N.write_tensors(frames, path, tail="3,4")
    back = N.read_tensors(spark, path, part_bytes=4096)
    moved = F.abs(F.col("values")[0] - F.lag(F.col("values")[0]).over(Window.partitionBy("clip_id").orderBy("row")))
    told = back.select("clip_id", "shape", moved.alias("moved"), F.size("values").alias("width"))
    return told.groupBy(F.col("clip_id").cast("long").alias("user_id")).agg(F.count("*").alias("n_frames"), F.max(F.col("shape")[0]).alias("n_stated"), F.max("width").alias("width"), r6(F.coalesce(F.sum("moved"), F.lit(0.0)), "moved"))


def keyed_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come several times, in a stream that breaks off between writing and commit
    and is taken up again: each is held once."""
    root, state, path = fresh_path(spark, "held"), fresh_path(spark, "held-state"), fresh_path(spark, "sent")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    for part in ("event_id % 4 < 2", "event_id % 4 > 0", "event_id % 4 <> 2"):
        events.filter(part).coalesce(2).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(path)
    broken: set[int] = set()

    def breaks(batch: int) -> None:
        if batch == 1 and batch not in broken:
            broken.add(batch)
            raise RuntimeError("broken off")

    def listener(batch: DataFrame, number: int) -> None:
        raise ValueError(f"a listener's own fault in batch {number}")

    for _ in range(2):
        query = L.exactly_once(stream, root, "events", ["event_id"], state, listener, together=2, before_commit=breaks)
        try:
            query.awaitTermination()
        except StreamingQueryException:
            continue
    return L.committed(spark, root, "events", events.schema).select("event_id", "user_id", "event_type", r6("value"))


def group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by language through a CSV report of six digits."""
    path = fresh_path(spark, "report")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("lang"))
    W.write_report(M.summary(_binary(spark, sf_dir).join(docs, "doc_id"), 2, "lang"), path, ["lang"])
    return spark.read.option("header", True).schema("lang string, n_samples long, accuracy double, macro_f1 double, weighted_f1 double, uar double").csv(path)


def group_report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report as a Markdown table, line by line."""
    path = fresh_path(spark, "report-md")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("lang"))
    rows = M.summary(_binary(spark, sf_dir).join(docs, "doc_id"), 2, "lang").select("lang", "n_samples", "accuracy", "macro_f1")
    W.write_markdown(rows, path, ["lang"], 4)
    return spark.read.text(path).withColumnRenamed("value", "line")


def batch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of batches of rows, some of which raise: their error is a column."""
    def score(part: pd.DataFrame) -> pd.Series:
        if (part["doc_id"] % 9 == 0).any():
            raise ValueError("no frames")
        return part["n_chars"] / 100

    path = fresh_path(spark, "scores")
    W.write_json(W.scored(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), score, "doc_id"), path)
    return spark.read.schema("doc_id long, score double, error string").json(path)


def transcript_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts filled in where they are empty, and what became of each."""
    ann = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip_id"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.lit(" ")).alias("transcript"))
    found = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("clip_id")).agg(F.min(F.coalesce("text", F.lit(""))).alias("transcript"))
    return W.updated_transcripts(ann, found).groupBy("fate").agg(F.count("*").alias("n"), F.sum(F.length("transcript")).alias("n_chars"))


def misclassified_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong rows as JSON lines, written when the metric beats the best before: of three epochs
    the second is worse than the first, and the third is better."""
    path, best = fresh_path(spark, "wrong"), -1.0
    rows = predictions(spark, sf_dir).select("vec_id", "y_true", "y_pred")
    for epoch, every in enumerate((5, 2, 9)):
        told = rows.withColumn("y_pred", F.when(F.col("vec_id") % every == 0, (F.col("y_pred") + 1) % 10).otherwise(F.col("y_pred")).cast("int"))
        best = W.write_if_better(told.withColumn("epoch", F.lit(epoch)), path, best)
    return spark.read.schema("vec_id long, y_true int, y_pred int, epoch int").json(path)


_LANG = "CASE WHEN doc_id % 5 = 0 THEN 'vi' WHEN doc_id % 2 = 0 THEN 'vi' ELSE 'en' END"
_OK = "doc_id % 17 <> 0 AND doc_id % 10 < 8 AND NOT (doc_id % 4 <> 0 AND doc_id % 7 = 0)"
QUERIES = {
    "annotation_scan": (annotation_scan, f"SELECT doc_id AS clip_id, {EMOTION} AS emotion_label, {GENRE} AS genre, {_LANG} AS source_language, doc_id % 4 <> 0 AS has_face, false AS human_verified, false AS language_mismatch, (doc_id % 3 + 1)::INTEGER AS agents, printf('AU6=%.1f, AU12=4.2', doc_id % 10 / 2.0::DOUBLE) AS aus, md5(coalesce(text, '')) AS transcript_md5 FROM documents WHERE {_OK}"),
    "annotation_rejects": (annotation_rejects, "SELECT 'corrupt' AS problem, count(*) AS n FROM documents WHERE doc_id % 17 = 0 HAVING count(*) > 0 UNION ALL SELECT 'emotion_label', count(*) FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 10 >= 8 HAVING count(*) > 0 UNION ALL SELECT 'webcam_bbox', count(*) FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 4 <> 0 AND doc_id % 7 = 0 HAVING count(*) > 0"),
    "annotator_rows": (annotator_rows, f"SELECT doc_id AS clip_id, 'agent' || k.i AS agent_name, 'out' || k.i AS output, k.i::INTEGER AS n FROM documents, range(3) AS k(i) WHERE {_OK} AND k.i <= doc_id % 3"),
    "split_documents": (split_documents, "SELECT vec_id, label FROM embeddings WHERE vec_id % 10 < 7"),
    "raw_annotations": (raw_annotations, f"SELECT doc_id AS clip_id, {EMOTION} AS emotion FROM documents WHERE doc_id % 17 <> 0"),
    "peak_frame_aus": (peak_frame_aus, "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 WHEN 2 THEN doc_id % 9 END AS au1, CASE WHEN doc_id % 5 <= doc_id % 4 THEN doc_id % 5 / 4.0::DOUBLE END AS au4 FROM documents"),
    "manifest_scan": (manifest_scan, "SELECT doc_id AS clip_id, CASE WHEN doc_id % 10 < 7 THEN 'train' ELSE 'val' END AS split FROM documents"),
    "bbox_map_scan": (bbox_map_scan, "SELECT vec_id, CASE WHEN vec_id % 3 <> 0 THEN vec_id % 10 + 0.5::DOUBLE END AS xmin, CASE WHEN vec_id % 3 <> 0 THEN 0.25::DOUBLE END AS width, vec_id % 3 <> 0 AS found FROM embeddings"),
    "label_array": (label_array, f"SELECT CASE WHEN doc_id % 2 = 0 THEN 'FPS_' ELSE 'x_' END || doc_id AS clip_id, CASE WHEN {EMOTION} = 'odd' THEN 'neutral' ELSE {EMOTION} END AS emotion_label, CASE WHEN doc_id % 2 = 0 THEN 'fps' ELSE 'moba' END AS genre FROM labels"),
    "labels_csv": (labels_csv, f"SELECT doc_id AS clip_id, {EMOTION} AS emotion_label, CASE WHEN doc_id % 2 = 0 THEN '/videos/b/' || doc_id || '.MP4' WHEN doc_id % 3 = 0 THEN '/videos/c/' || doc_id || '.mkv' ELSE '/videos/a/' || doc_id || '.avi' END AS path FROM documents"),
    "source_list": (source_list, "SELECT url, 's' || page_id % 3 AS streamer, 'fps' AS genre FROM pages"),
    "source_list_plain": (source_list_plain, "SELECT url FROM pages"),
    "au_csv": (au_csv, "SELECT user_id AS clip, event_id AS frame, a.au, round(CASE a.au WHEN 1 THEN CASE WHEN event_id % 6 = 0 THEN 0 ELSE value END WHEN 2 THEN event_id % 10 / 2.0::DOUBLE ELSE 0 END, 6) AS intensity FROM events, (VALUES (1), (2), (12)) AS a(au)"),
    "feature_metadata": (feature_metadata, "SELECT vec_id % 2 = 0 AS has_facecam, count(*) AS n, count(*) FILTER (vec_id > 2) AS known, (SELECT (min(vec_id) % 5 + 700)::INTEGER FROM embeddings WHERE vec_id > 2) AS dim FROM embeddings GROUP BY 1"),
    "cue_cache": (cue_cache, "SELECT vec_id AS clip_id, CASE WHEN vec_id % 5 <> 0 AND vec_id % 7 <> 0 THEN vec_id % 9 + 0.5::DOUBLE END AS energy FROM embeddings"),
    "predictions_jsonl": (predictions_jsonl, PRED + "SELECT vec_id, y_true, y_pred, CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 2 END AS run FROM pred WHERE vec_id % 7 <> 0"),
    "tensor_cache": (tensor_cache, "SELECT vec_id, 64 AS width, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings"),
    "tensor_files": (tensor_files, "SELECT vec_id, 8::BIGINT AS n_rows, 8::BIGINT AS width, round(list_sum(embedding::DOUBLE[]), 6) AS total, false AS stale FROM embeddings"),
    "keypoint_files": (keypoint_files, "WITH f AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events) SELECT user_id, count(*) AS n_frames, count(*) AS n_stated, 12 AS width, round(coalesce(sum(abs(value - old)), 0), 6) AS moved FROM f GROUP BY user_id"),
    "keyed_sink": (keyed_sink, "SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events"),
    "group_report": (group_report, GROUPED.format(rows=BY_LANG, by="lang") + "SELECT lang, n_samples, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1, round(uar, 6) AS uar FROM m"),
    "group_report_markdown": (group_report_markdown, GROUPED.format(rows=BY_LANG, by="lang") + "SELECT '| lang | n_samples | accuracy | macro_f1 |' AS line UNION ALL SELECT '|---|---|---|---|' UNION ALL SELECT '| ' || lang || ' | ' || n_samples || ' | ' || printf('%.4f', accuracy) || ' | ' || printf('%.4f', macro_f1) || ' |' FROM m"),
    "batch_scores": (batch_scores, "SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN n_chars / 100.0::DOUBLE END AS score, CASE WHEN doc_id % 9 = 0 THEN 'ValueError: no frames' END AS error FROM documents"),
    "transcript_update": (transcript_update, "WITH f AS (SELECT conv_id, min(coalesce(text, '')) AS t FROM conversations GROUP BY 1), r AS (SELECT CASE WHEN doc_id % 3 = 0 AND trim(coalesce(d.text, ''), ' ') <> '' THEN 'skipped' WHEN f.t IS NULL THEN 'missing' ELSE 'transcribed' END AS fate, CASE WHEN doc_id % 3 = 0 THEN d.text ELSE ' ' END AS old, f.t FROM documents AS d LEFT JOIN f ON conv_id = doc_id) SELECT fate, count(*) AS n, sum(length(CASE WHEN fate = 'transcribed' THEN t ELSE old END))::BIGINT AS n_chars FROM r GROUP BY fate"),
    "misclassified_sink": (misclassified_sink, PRED + ", e AS (SELECT vec_id, y_true, CASE WHEN vec_id % k.every = 0 THEN (y_pred + 1) % 10 ELSE y_pred END AS y_pred, k.epoch FROM pred, (VALUES (0, 5), (1, 2), (2, 9)) AS k(epoch, every)), a AS (SELECT epoch, avg((y_true = y_pred)::INTEGER) AS accuracy FROM e GROUP BY epoch), b AS (SELECT max(epoch) AS epoch FROM a WHERE accuracy > coalesce((SELECT max(x.accuracy) FROM a AS x WHERE x.epoch < a.epoch), -1)) SELECT vec_id, y_true, y_pred, epoch FROM e JOIN b USING (epoch) WHERE y_true <> y_pred"),
}

"""Readers of annotation, label, manifest and cache files, with stated schemas.

Nothing is inferred. Lines that cannot be read are kept apart with a reason and never fail
a job; absent optional fields take their defaults and unknown fields are ignored. A path
may be a file, a folder or a pattern in any store that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipwright.functions.lexicons import EMOTIONS
from clipwright.functions.text import GENRES

BOX = "struct<xmin: double, ymin: double, width: double, height: double, stability_score: double>"
AGENT = "struct<agent_name: string, model_version: string, output: string, metadata: map<string,string>>"
ANNOTATION = f"""clip_id string, emotion_label string, ekman_label string, genre string, face_aus map<string,double>, peak_frame_idx int, webcam_bbox {BOX},
 face_description string, visual_objective_desc string, audio_tone_desc string, transcript string, reasoning string, annotators array<{AGENT}>, human_verified boolean,
 human_reviewer string, cohens_kappa double, code_switching_ratio double, source_language string, asr_detected_language string, text_detected_language string,
 language_detect_confidence double, language_mismatch boolean, created_at timestamp"""
REQUIRED = ["clip_id", "emotion_label", "genre", "face_aus", "peak_frame_idx", "visual_objective_desc", "audio_tone_desc", "transcript", "reasoning", "annotators", "created_at"]
DEFAULTS = {"face_description": "", "human_verified": False, "code_switching_ratio": 0.0, "source_language": "vi", "language_mismatch": False}
FEATURES = "clip_id string, " + ", ".join(f"h_{m}_path string, {m}_shape array<int>" for m in ("audio", "face", "context", "text")) + ", has_facecam boolean, extracted_at timestamp"
VIDEO_KINDS = ["mp4", "mkv", "webm", "avi", "mov"]


def read_json(spark: SparkSession, path: str, schema: str, documents: bool = False) -> DataFrame:
    """Rows of JSON lines, or with ``documents`` of files that hold one document each, beside
    ``_corrupt`` (the text of what cannot be read, else null) and ``_stem`` (the file's name)."""
    reader = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", documents)
    return reader.json(path).withColumn("_stem", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))


def read_annotations(spark: SparkSession, path: str, documents: bool = False) -> DataFrame:
    """Annotations with defaults, and ``problems array<string>``: empty for a valid row.

    In files of one document each the file's stem is the clip; the stem alone decides before
    anything else is read if the rows are filtered by it."""
    rows = read_json(spark, path, ANNOTATION, documents)
    if documents:
        rows = rows.withColumn("clip_id", F.col("_stem"))
    rows = rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items()})
    bad = {"corrupt": F.col("_corrupt").isNotNull()}
    bad |= {f"no {c}": F.col("_corrupt").isNull() & F.col(c).isNull() for c in REQUIRED}
    bad |= {"emotion_label": ~F.col("emotion_label").isin(EMOTIONS), "genre": ~F.col("genre").isin(GENRES), "source_language": ~F.col("source_language").isin("vi", "en")}
    inside = [F.coalesce(F.col(f"webcam_bbox.{c}").between(0, 1), F.lit(False)) for c in ("xmin", "ymin", "width", "height", "stability_score")]
    bad["webcam_bbox"] = F.col("webcam_bbox").isNotNull() & ~(inside[0] & inside[1] & inside[2] & inside[3] & inside[4])
    return rows.withColumn("problems", F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in bad.items()]), lambda x: x.isNotNull()))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """``(value variant)``: JSON lines without a schema; those that cannot be parsed are left out."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("value")).filter("value is not null")


def read_map(spark: SparkSession, path: str, value: str = "string", whole: bool = False) -> DataFrame:
    """``(key, value)`` of JSON objects with keys of any name: one object in a file (``whole``),
    or one or more keys on each line. Null values stay."""
    text = spark.read.text(path, wholetext=whole)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


#: File names that one read is filtered by.
NAMES = 10_000


def read_split(spark: SparkSession, path: str, manifest: DataFrame, split: str, schema: str, suffix: str = ".json", mode: str = "FAILFAST") -> DataFrame:
    """The JSON documents whose stem ``manifest (clip_id, split)`` gives to ``split``, with ``clip_id``.

    The names are a filter on the files' metadata, which the planner applies to its list of
    files: one of another split is never opened, so it may be broken. Names are as many as
    the split's files, which the planner lists in any case; each read takes ``NAMES`` of them.
    """
    stems = sorted(r[0] for r in manifest.filter(F.col("split") == split).select(F.col("clip_id").cast("string")).distinct().toLocalIterator())
    documents = spark.read.schema(schema).option("mode", mode).option("multiLine", True).json(path)
    name = F.col("_metadata.file_name")
    stem = F.regexp_replace(name, r"\.[^.]*$", "").alias("clip_id")
    out = documents.filter(F.lit(False)).select(F.lit(None).cast("string").alias("clip_id"), *[c for c in documents.columns if c != "clip_id"])
    for i in range(0, len(stems), NAMES):
        part = documents.filter(name.isin([f"{s}{suffix}" for s in stems[i : i + NAMES]]))
        out = out.unionByName(part.select(stem, *[c for c in documents.columns if c != "clip_id"]))
    return out


def read_label_array(spark: SparkSession, path: str) -> DataFrame:
    """``(id, video, choice, confidence)`` of files with one JSON array each; anything else in one
    is an error. A label file is small, and there may be any number of them."""
    item = "struct<id: string, video: string, choice: string, confidence: double>"
    text = spark.read.text(path, wholetext=True)
    array = F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", f"array<{item}>"))
    return text.select(F.explode(F.coalesce(array, F.raise_error(F.lit("expected a JSON array")).cast(f"array<{item}>"))).alias("x")).select("x.*")


def flat_labels(entries: DataFrame) -> DataFrame:
    """``(clip_id, emotion_label, genre)`` of label entries: the video's stem, an unknown choice as
    neutral, and the first genre that the name holds."""
    stem = F.regexp_replace(F.regexp_replace("video", r"^.*/", ""), r"\.[^.]*$", "")
    genre = F.lit(GENRES[0])
    for g in GENRES[::-1]:
        genre = F.when(F.lower(stem).contains(g), g).otherwise(genre)
    return entries.select(stem.alias("clip_id"), F.when(F.col("choice").isin(EMOTIONS), F.col("choice")).otherwise("neutral").alias("emotion_label"), genre.alias("genre"))


def read_labels_csv(spark: SparkSession, path: str) -> DataFrame:
    """A labels file with a header; clip and label are stripped, the label is lowered."""
    rows = spark.read.option("header", True).csv(path)
    if missing := {"clip_id", "emotion_label"} - set(rows.columns):
        raise ValueError(f"the labels file lacks {sorted(missing)}; it has {rows.columns}")
    return rows.withColumns({"clip_id": F.trim("clip_id"), "emotion_label": F.lower(F.trim("emotion_label"))})


def read_source_list(spark: SparkSession, path: str) -> DataFrame:
    """``(line, fields map<string,string>)`` of a list of urls: plain, or with tabs and a header
    that names a url. Comments and blank lines go. A list is a small file, of which there may
    be any number."""
    lines = F.filter(F.transform(F.split("value", "\r?\n"), lambda x: F.struct(F.trim(x).alias("t"), x.startswith("#").alias("c"))), lambda x: (x["t"] != "") & ~x["c"])
    kept = spark.read.text(path, wholetext=True).select(F.transform(lines, lambda x: x["t"]).alias("lines"))
    head = F.try_element_at("lines", F.lit(1))
    tabbed = head.contains("\t") & F.lower(head).contains("url")
    rows = kept.select(tabbed.alias("tabbed"), F.transform(F.split(head, "\t"), lambda x: F.trim(x)).alias("names"), F.posexplode("lines").alias("line", "t"))
    values = F.transform(F.split("t", "\t"), lambda x: F.trim(x))
    n = F.least(F.size("names"), F.size(values))
    named = F.map_from_arrays(F.slice("names", F.lit(1), n), F.slice(values, F.lit(1), n))
    return rows.filter(~F.col("tabbed") | (F.col("line") > 0)).select("line", F.when(F.col("tabbed"), named).otherwise(F.create_map(F.lit("url"), "t")).alias("fields"))


def read_au_csv(spark: SparkSession, path: str, aus: list[int], *keys: str) -> DataFrame:
    """``(*keys, au, intensity)`` of wide files whose columns ``AU01_r`` may have spaces in
    front; an absent column and what is no number give 0."""
    wide = spark.read.option("header", True).csv(path)
    wide = wide.toDF(*[c.strip() for c in wide.columns])
    value = lambda au: F.coalesce(F.trim(f"AU{au:02d}_r").try_cast("double"), F.lit(0.0)) if f"AU{au:02d}_r" in wide.columns else F.lit(0.0)
    return wide.select(*keys, *[value(au).alias(str(au)) for au in aus]).unpivot(list(keys), [str(au) for au in aus], "au", "intensity").withColumn("au", F.col("au").cast("int"))


def index_videos(paths: DataFrame) -> DataFrame:
    """``(clip_id, path)``: for each stem the path of the first kind, then the least."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    order = F.array_position(F.array(*[F.lit(k) for k in VIDEO_KINDS]), kind)
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    known = paths.select("path", stem.alias("clip_id"), order.alias("o")).filter("o > 0")
    return known.groupBy("clip_id").agg(F.min_by("path", F.struct("o", "path")).alias("path"))


def video_paths(spark: SparkSession, folder: str) -> DataFrame:
    """``(path)`` of the files below a folder; nothing of them is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")


def require(rows: DataFrame, found: DataFrame, key: str, what: str) -> DataFrame:
    """Left join whose rows must all be found; the first that is not fails the job."""
    both = rows.join(found.withColumn("_found", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"{what} not found for "), F.col(key).cast("string")))
    return both.filter(F.coalesce("_found", missing.cast("boolean"))).drop("_found")


def feature_dim(metas: DataFrame, modality: str) -> DataFrame:
    """``(dim)``: the last axis in the first file that tells the modality's shape."""
    told = metas.filter(F.col(f"{modality}_shape").isNotNull() & (F.size(f"{modality}_shape") > 0))
    return told.select("clip_id", F.element_at(f"{modality}_shape", -1).alias("dim")).orderBy("clip_id").limit(1).select("dim")


def peak_aus(aus: Column, peak: Column) -> Column:
    """``map<string,double>``: of each unit's intensities the one at the peak, if there is one."""
    return F.map_filter(F.transform_values(aus, lambda k, v: F.get(v, peak)), lambda k, v: v.isNotNull())


def formatted_aus(aus: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(aus), lambda e: F.format_string("%s=%.1f", e["key"], e["value"])), ", ")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_r", rank).filter("_r = 1").drop("_r")

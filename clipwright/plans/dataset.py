"""Dataset queries: manifests, feature caches and label schemas joined to annotations.

Documents stand for annotated clips, embeddings for their cached features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipwright.functions import arrays as A
from clipwright.functions import labels as L
from clipwright.operators import splits as S
from clipwright.operators.stratify import multilabel_split
from clipwright.plans.evaluation import r6
from clipwright.sources.tables import table

#: Annotation fields of a document, read alike by both engines.
FIELDS = {
    "clip_id": "doc_id", "emotion": f"CASE doc_id % 10 {' '.join(f'WHEN {i} THEN {chr(39)}{n}{chr(39)}' for i, n in enumerate(L.EMOTIONS))} ELSE 'odd' END",
    "language": "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE lang END", "bbox": "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(doc_id % 9 AS DOUBLE) / 10 END",
    "split": "CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'val' ELSE 'test' END", "genre": "source",
}
_ANN = "ann AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in FIELDS.items()) + ", text FROM documents)"


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*[f"{v} AS {k}" for k, v in FIELDS.items()], "text")


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits by clip; some clips are in none, and some of its clips have no annotation."""
    docs = table(spark, sf_dir, "documents").filter("doc_id % 5 <> 4")
    return docs.select((F.col("doc_id") + F.when(F.col("doc_id") % 13 == 0, 10_000_000).otherwise(0)).alias("clip_id"), F.expr(FIELDS["split"]).alias("split"))


_MANIFEST = f"man AS (SELECT doc_id + CASE WHEN doc_id % 13 = 0 THEN 10000000 ELSE 0 END AS clip_id, {FIELDS['split']} AS split FROM documents WHERE doc_id % 5 <> 4)"


def split_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of one split: in its manifest, with cached features, with a class index."""
    return _items(spark, sf_dir).select("clip_id", L.index_of(F.col("emotion")).alias("label"), F.coalesce("language", F.lit("vi")).alias("language"))


def _items(spark: SparkSession, sf_dir: str, split: str = "train") -> DataFrame:
    chosen = _manifest(spark, sf_dir).filter(F.col("split") == split).select("clip_id")
    cached = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"))
    return annotations(spark, sf_dir).drop("split").join(chosen, "clip_id").join(cached, "clip_id", "left_semi")


def missing_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of the manifest without a source, by split."""
    gone = _manifest(spark, sf_dir).join(annotations(spark, sf_dir).select("clip_id"), "clip_id", "left_anti")
    return gone.groupBy("split").agg(F.count("*").alias("missing"))


def face_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What extraction found about a face, else whether the annotation has a box; a box comes
    from the annotation, else from the fallback map."""
    feats = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), F.when(F.col("vec_id") % 3 != 0, F.col("vec_id") % 2 == 0).alias("found"))
    fallback = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("clip_id"), (F.col("quality") / 2.0).alias("other"))
    rows = annotations(spark, sf_dir).select("clip_id", "bbox").join(feats, "clip_id", "left").join(fallback, "clip_id", "left")
    return rows.select("clip_id", F.coalesce("found", F.col("bbox").isNotNull()).alias("has_face"), F.coalesce("bbox", "other").alias("bbox"))


def masked_modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modalities (blocks of an embedding) set to zero by a strategy and by request; without
    its face a clip has none."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", A.doubles(F.col("embedding")).alias("v"))
    strategy = F.element_at(F.array(F.lit("face_only"), F.lit("dual_path"), F.lit("full_frame"), F.lit("else")), (F.col("vec_id") % 4 + 1).cast("int"))
    asked = F.when(F.col("vec_id") % 5 == 0, F.array(F.lit("face"))).otherwise(F.array().cast("array<string>"))
    gone = F.array_union(L.zeroed_by(strategy), asked)
    rows = e.withColumn("gone", gone)
    return rows.select(
        "vec_id", F.array_join(F.array_sort("gone"), ",").alias("zeroed"), (~F.array_contains("gone", "face")).alias("has_face"),
        *[r6(A.total(A.zero_if(F.array_contains("gone", m), A.block(F.col("v"), i, 16))), m) for i, m in enumerate(L.MODALITIES)],
    )


def label_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class indices under the three merge modes, display names, and the external schema."""
    e = F.col("emotion")
    return annotations(spark, sf_dir).select(
        "clip_id", *[L.index_of(e, m).alias(m) for m in L.MERGE_MODES], L.display(L.index_of(e, "merge_hype_amused"), "merge_hype_amused").alias("name"),
        L.display(F.col("clip_id") % 11, "none").alias("any_name"), L.index_or_other(F.when(F.col("clip_id") % 2 == 0, F.concat(F.lit(" "), F.upper(e))).otherwise((F.col("clip_id") % 8).cast("string"))).alias("seven"),
        L.external(e).alias("external"),
    )


def cache_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips whose cached features can be used: both files are there, the configuration is
    the same, and the source is too where its hash is known."""
    meta = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), F.when(F.col("vec_id") % 3 == 0, "old").otherwise("new").alias("config"), F.when(F.col("vec_id") % 4 == 0, "").otherwise(F.md5(F.concat((F.col("vec_id") - F.col("vec_id") % 2).cast("string"), F.lit("")))).alias("source_hash"), (F.col("vec_id") % 7 != 0).alias("tensor"))
    rows = annotations(spark, sf_dir).select("clip_id", F.md5(F.col("clip_id").cast("string")).alias("now")).join(meta, "clip_id", "left")
    fine = F.col("tensor") & (F.col("config") == "new") & ((F.col("source_hash") == "") | (F.col("source_hash") == F.col("now")))
    return rows.select("clip_id", F.coalesce(fine, F.lit(False)).alias("valid"))


def config_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve digits of the md5 of a configuration as JSON with sorted keys."""
    settings = F.to_json(F.struct(F.col("n_nationkey").alias("audio"), F.col("n_name").alias("face"), F.col("n_regionkey").alias("text")))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.substring(F.md5(settings), 1, 12).alias("config_hash"))


def evidence_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text evidence where any annotation is there, else the embedding, else text defaults."""
    docs = annotations(spark, sf_dir).select("clip_id", F.when(F.col("clip_id") % 3 == 0, F.lit("N/A")).when(F.col("clip_id") % 3 == 1, F.lit("")).otherwise(F.col("emotion")).alias("aus"), F.when(F.col("clip_id") % 5 == 0, F.col("genre")).alias("scene"), "text")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), F.col("label"))
    told = lambda c: ~F.coalesce(F.col(c), F.lit("")).isin("", "N/A")
    by_vector = ~(told("aus") | told("scene")) & F.col("label").isNotNull()
    rows = docs.join(vectors, "clip_id", "left")
    return rows.select("clip_id", F.when(by_vector, "embedding").otherwise("text").alias("path"), F.when(~by_vector, F.coalesce("aus", F.lit("N/A"))).alias("aus"), F.when(~by_vector, F.coalesce("scene", F.lit("N/A"))).alias("scene"), F.when(~by_vector, F.length(F.coalesce("text", F.lit("")))).alias("n_chars"))


def five_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five sources tells about a clip, with a default of its own."""
    t = lambda name, key, *cols: table(spark, sf_dir, name).select(F.col(key).alias("clip_id"), *cols)
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("clip_id")).agg(F.count("*").alias("turns"))
    rows = annotations(spark, sf_dir).select("clip_id", "language")
    for other in (t("labels", "doc_id", F.col("quality").cast("string").alias("label")), t("embeddings", "vec_id", F.col("label").cast("string").alias("face")), t("pages", "page_id", F.col("url").alias("scene")), turns):
        rows = rows.join(other, "clip_id", "left")
    return rows.select("clip_id", F.coalesce("label", F.lit("neutral")).alias("label"), F.coalesce("face", F.lit("N/A")).alias("face"), F.coalesce("scene", F.lit("N/A")).alias("scene"), F.coalesce("turns", F.lit(0)).alias("turns"), F.coalesce("language", F.lit("vi")).alias("language"))


def language_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clips of one language, by class."""
    kept = annotations(spark, sf_dir).filter("language = 'en'")
    return kept.groupBy("emotion").agg(F.count("*").alias("n"))


def reasoning_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of the training split that have a text to reason from."""
    rows = _items(spark, sf_dir).filter(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    prompt = F.concat(F.lit("Speech ("), F.coalesce("language", F.lit("vi")), F.lit("): "), F.col("text"))
    return rows.select("clip_id", "emotion", F.md5(prompt).alias("prompt_md5"))


def limited_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty clips by name, before anything costly is done with them."""
    return annotations(spark, sf_dir).select(F.lpad(F.col("clip_id").cast("string"), 8, "0").alias("name"), "emotion").orderBy("name").limit(20)


def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and rest balanced over the combinations of class, language and genre, the
    rest divided 10 : 7 : 3 over all of it."""
    rows = annotations(spark, sf_dir).select("clip_id", "emotion", "language", "genre")
    return S.combined_folds(rows, "clip_id", ["emotion", "language", "genre"], ["train", "val", "test", "ood"], [0.7, 0.15, 0.1, 0.05], 42)


def multilabel_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and rest balanced over class, language and genre at once, rarest label first."""
    rows = annotations(spark, sf_dir).select("clip_id", "emotion", "language", "genre")
    return multilabel_split(rows, "clip_id", ["emotion", "language", "genre"], ["train", "val", "test", "ood"], [0.7, 0.15, 0.1, 0.05], 42)


def audio_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language identification restricted to two candidates: their more likely one, and
    whether transcription has to be done again with it; the language by each routing."""
    docs = table(spark, sf_dir, "documents").withColumns({"vi": F.expr("CAST(doc_id % 7 AS DOUBLE) / 10"), "en": F.expr("CAST(doc_id % 5 AS DOUBLE) / 8"), "ko": F.expr("CAST(doc_id % 3 AS DOUBLE) / 4")})
    probs = F.create_map(*[x for n in ("vi", "en", "ko") for x in (F.lit(n), F.col(n))])
    found = docs.select("doc_id", "lang", L.restricted_language(probs, ["vi", "en"], 0.6).alias("x"))
    return found.select("doc_id", "x.top", "x.language", "x.redo", L.routed(F.col("lang"), "metadata").alias("by_metadata"), L.routed(F.col("lang"), "force").alias("by_force"), L.mismatch(F.col("lang"), F.col("x.language"), F.when(F.col("doc_id") % 2 == 0, F.lit("en"))).alias("mismatch"))


def length_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cleaned text, unless cleaning took more than half of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-m]", "").alias("c"))
    kept = F.when(F.length("c") < F.length("t") * 0.5, F.col("t")).otherwise(F.col("c"))
    return docs.select("doc_id", F.md5(kept).alias("kept_md5"), F.length(kept).alias("n_chars"))


def duplicate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First tokens that several labels share, and labels of several tokens."""
    first = F.substring("p_name", 1, 4)
    named = table(spark, sf_dir, "part").select(first.alias("token"), (F.size(F.split("p_name", " ")) > 1).cast("int").alias("several"))
    return named.groupBy("token").agg(F.count("*").alias("n"), F.sum("several").alias("several")).filter("n > 1 or several > 0")


_label = lambda names: "CASE emotion " + " ".join(f"WHEN '{n}' THEN {i}" for n, i in names) + " ELSE 0 END"
_MODES = [("none", list(zip(L.EMOTIONS, range(8), strict=True))), ("amused_as_happy", list(zip(L.EMOTIONS, range(8), strict=True))), ("merge_hype_amused", [("neutral", 0), ("hype", 1), ("amused", 1), ("tilted", 2), ("sad", 3), ("shocked", 4), ("fear", 5), ("disgusted", 6)])]
_NAMES = "['" + "', '".join(L.EMOTIONS) + "']"
QUERIES = {
    "split_items": (split_items, f"WITH {_ANN}, {_MANIFEST} SELECT clip_id, {_label(_MODES[0][1])} AS label, coalesce(language, 'vi') AS language FROM ann JOIN man USING (clip_id) WHERE man.split = 'train' AND clip_id IN (SELECT vec_id FROM embeddings)"),
    "missing_clips": (missing_clips, f"WITH {_MANIFEST} SELECT split, count(*) AS missing FROM man WHERE clip_id NOT IN (SELECT doc_id FROM documents) GROUP BY split"),
    "face_presence": (face_presence, f"WITH {_ANN} SELECT clip_id, coalesce(CASE WHEN vec_id % 3 <> 0 THEN vec_id % 2 = 0 END, bbox IS NOT NULL) AS has_face, coalesce(bbox, quality / 2.0::DOUBLE) AS bbox FROM ann LEFT JOIN embeddings ON vec_id = clip_id LEFT JOIN labels ON doc_id = clip_id"),
    "masked_modalities": (masked_modalities, "WITH g AS (SELECT vec_id, embedding::DOUBLE[] AS v, vec_id % 4 = 0 AS c, vec_id % 5 = 0 AS f FROM embeddings) SELECT vec_id, concat_ws(',', CASE WHEN c THEN 'context' END, CASE WHEN f THEN 'face' END) AS zeroed, NOT f AS has_face, round(list_sum(v[1:16]), 6) AS audio, CASE WHEN f THEN 0 ELSE round(list_sum(v[17:32]), 6) END AS face, CASE WHEN c THEN 0 ELSE round(list_sum(v[33:48]), 6) END AS context, round(list_sum(v[49:64]), 6) AS text FROM g"),
    "label_schemas": (label_schemas, f"WITH {_ANN}, m AS (SELECT *, {', '.join(f'{_label(v)} AS {k}' for k, v in _MODES)} FROM ann) SELECT clip_id, none, amused_as_happy, merge_hype_amused, (['neutral', 'happy', 'tilted', 'sad', 'shocked', 'fear', 'disgusted'])[merge_hype_amused + 1] AS name, coalesce(({_NAMES})[(clip_id % 11 + 1)::INTEGER], (clip_id % 11)::VARCHAR) AS any_name, CASE WHEN clip_id % 2 = 1 THEN (clip_id % 8)::INTEGER WHEN emotion = 'odd' THEN 6 ELSE none END AS seven, CASE emotion WHEN 'neutral' THEN 'neutral' WHEN 'hype' THEN 'happy' WHEN 'amused' THEN 'happy' WHEN 'tilted' THEN 'anger' WHEN 'sad' THEN 'sad' WHEN 'shocked' THEN 'surprise' WHEN 'fear' THEN 'fear' WHEN 'disgusted' THEN 'disgust' END AS external FROM m"),
    "cache_valid": (cache_valid, "SELECT doc_id AS clip_id, coalesce(vec_id % 7 <> 0 AND vec_id % 3 <> 0 AND (vec_id % 4 = 0 OR vec_id % 2 = 0), false) AS valid FROM documents LEFT JOIN embeddings ON vec_id = doc_id"),
    "config_hash": (config_hash, "SELECT n_nationkey, md5('{\"audio\":' || n_nationkey || ',\"face\":\"' || n_name || '\",\"text\":' || n_regionkey || '}')[1:12] AS config_hash FROM nation"),
    "evidence_choice": (evidence_choice, f"WITH {_ANN}, d AS (SELECT clip_id, CASE clip_id % 3 WHEN 0 THEN 'N/A' WHEN 1 THEN '' ELSE emotion END AS aus, CASE WHEN clip_id % 5 = 0 THEN genre END AS scene, text FROM ann), e AS (SELECT d.*, NOT (clip_id % 3 = 2 OR coalesce(scene, '') NOT IN ('', 'N/A')) AND label IS NOT NULL AS v FROM d LEFT JOIN embeddings ON vec_id = clip_id) SELECT clip_id, CASE WHEN v THEN 'embedding' ELSE 'text' END AS path, CASE WHEN NOT v THEN coalesce(aus, 'N/A') END AS aus, CASE WHEN NOT v THEN coalesce(scene, 'N/A') END AS scene, CASE WHEN NOT v THEN length(coalesce(text, '')) END AS n_chars FROM e"),
    "five_way": (five_way, f"WITH {_ANN}, t AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1) SELECT clip_id, coalesce(quality::VARCHAR, 'neutral') AS label, coalesce(e.label::VARCHAR, 'N/A') AS face, coalesce(url, 'N/A') AS scene, coalesce(turns, 0) AS turns, coalesce(language, 'vi') AS language FROM ann LEFT JOIN labels AS l ON l.doc_id = clip_id LEFT JOIN embeddings AS e ON vec_id = clip_id LEFT JOIN pages ON page_id = clip_id LEFT JOIN t ON conv_id = clip_id"),
    "language_subset": (language_subset, f"WITH {_ANN} SELECT emotion, count(*) AS n FROM ann WHERE language = 'en' GROUP BY 1"),
    "reasoning_examples": (reasoning_examples, f"WITH {_ANN}, {_MANIFEST} SELECT clip_id, emotion, md5('Speech (' || coalesce(language, 'vi') || '): ' || text) AS prompt_md5 FROM ann JOIN man USING (clip_id) WHERE man.split = 'train' AND clip_id IN (SELECT vec_id FROM embeddings) AND length(trim(coalesce(text, ''), ' ')) > 0"),
    "limited_items": (limited_items, f"WITH {_ANN} SELECT lpad(clip_id::VARCHAR, 8, '0') AS name, emotion FROM ann ORDER BY name LIMIT 20"),
    "stratified_folds": (stratified_folds, f"""WITH {_ANN}, o AS (SELECT clip_id, emotion, language, genre, md5(clip_id || ':42') AS h FROM ann), r AS (SELECT *, row_number() OVER (ORDER BY emotion NULLS FIRST, language NULLS FIRST, genre NULLS FIRST, h, clip_id) - 1 AS i FROM o),
rest AS (SELECT *, row_number() OVER (ORDER BY md5(clip_id || ':43'), clip_id) - 1 AS j, count(*) OVER () AS m FROM r WHERE i % 3 = 2) SELECT clip_id, emotion, language, genre, 'train' AS split FROM r WHERE i % 3 <> 2 UNION ALL SELECT clip_id, emotion, language, genre, CASE WHEN j < floor(m * (0.15::DOUBLE / (0.15::DOUBLE + 0.1::DOUBLE + 0.05::DOUBLE))) THEN 'val' WHEN j < floor(m * (0.15::DOUBLE / (0.15::DOUBLE + 0.1::DOUBLE + 0.05::DOUBLE))) + floor(m * (0.1::DOUBLE / (0.15::DOUBLE + 0.1::DOUBLE + 0.05::DOUBLE))) THEN 'test' ELSE 'ood' END FROM rest"""),
    "multilabel_folds": (multilabel_folds, None),
    "audio_language": (audio_language, """WITH p AS (SELECT doc_id, lang, CAST(doc_id % 7 AS DOUBLE) / 10 AS vi, CAST(doc_id % 5 AS DOUBLE) / 8 AS en, CAST(doc_id % 3 AS DOUBLE) / 4 AS ko FROM documents), q AS (SELECT *, greatest(vi, en, ko) AS p, CASE WHEN vi = greatest(vi, en, ko) THEN 'vi' WHEN en = greatest(vi, en, ko) THEN 'en' ELSE 'ko' END AS top, CASE WHEN vi >= en THEN 'vi' ELSE 'en' END AS language FROM p)
SELECT doc_id, top, language, language <> top OR p < 0.6 AS redo, CASE WHEN coalesce(lang, 'vi') IN ('vi', 'en') THEN coalesce(lang, 'vi') ELSE 'vi' END AS by_metadata, 'vi' AS by_force, coalesce(lang <> language, false) OR (doc_id % 2 = 0 AND coalesce(lang <> 'en', false)) AS mismatch FROM q"""),
    "length_guard": (length_guard, "WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[^a-m]', '', 'g') AS c FROM documents), k AS (SELECT doc_id, CASE WHEN length(c) < length(t) * 0.5 THEN t ELSE c END AS k FROM d) SELECT doc_id, md5(k) AS kept_md5, length(k)::INTEGER AS n_chars FROM k"),
    "duplicate_tokens": (duplicate_tokens, "SELECT p_name[1:4] AS token, count(*) AS n, sum((len(string_split(p_name, ' ')) > 1)::INTEGER)::BIGINT AS several FROM part GROUP BY 1 HAVING count(*) > 1 OR sum((len(string_split(p_name, ' ')) > 1)::INTEGER) > 0"),
}

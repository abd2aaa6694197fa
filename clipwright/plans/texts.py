"""Text, cue, label and JSON queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipwright.functions import lexicons as L
from clipwright.functions import text as T
from clipwright.plans.evaluation import r6
from clipwright.sources.tables import table

#: The lexicons, and words of the given tables that stand in for them.
NEGATIVE, GAMES = [*L.NEGATIVE, "not", "with", "den"], [*L.GAME_TERMS, "that", "of", "les"]
PATTERNS = ["subscribe", "license", "the and", "www"]
GIVEN = "CASE WHEN doc_id % 11 = 10 THEN NULL ELSE split('" + ",".join(L.EMOTIONS) + ",nope', ',')[CAST(doc_id % 9 AS INT)] END"
RAW = [
    (1, "Cues: face: eyes=wide; voice: pitch=high. Emotion: hype.", "neutral"),
    (2, "<think>a</think><think>AU12 high</think><answer> Amused </answer>", "neutral"),
    (3, "some random text", "neutral"),
    (4, "<think>only thought</think>", "sad"),
    (5, "Clue: 7.5 Label: 12", "fear"),
    (6, "", "hype"),
]
#: Output in each form around every text of the table; both engines read it alike.
FORMS = """CASE doc_id % 6 WHEN 0 THEN 'Cues: ' || t || ' . Emotion: Hype.' WHEN 1 THEN '<think>' || t || '</think><think> AU12 high </think> <answer> amused </answer>'
 WHEN 2 THEN t WHEN 3 THEN '<think>' || t || '</think>' WHEN 4 THEN '<clue_score> ' || (n_chars % 14) || '.5 </clue_score><label_score>' || (doc_id % 13) || '</label_score>' || t
 ELSE '<answer>sad</answer>' || t END"""
_RAW = "(SELECT * FROM (VALUES " + ", ".join(f"({-i}::BIGINT, '{r}', '{f}')" for i, r, f in RAW) + f") AS v(id, raw, fallback) UNION ALL SELECT doc_id, {FORMS}, 'neutral' FROM (SELECT doc_id, n_chars, coalesce(text, '') AS t FROM documents) AS d) AS r"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, raw, fallback)``: a few outputs by hand, and one around every document's text."""
    few = spark.createDataFrame([(-i, r, f) for i, r, f in RAW], "id long, raw string, fallback string")
    docs = table(spark, sf_dir, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    return few.unionByName(docs.select(F.col("doc_id").alias("id"), F.expr(FORMS).alias("raw"), F.lit("neutral").alias("fallback")))


def text_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    split = docs.select("doc_id", "text", T.words(F.lower("text")).alias("w"))
    names = ["exclaims", "negatives", "games", "length"]
    counted = split.select("doc_id", *[c.alias(n) for c, n in zip(T.text_counts(F.col("text"), F.col("w"), NEGATIVE, GAMES), names, strict=True)])
    told, values = T.text_cue(*[F.col(n) for n in names])
    return counted.select("doc_id", told.alias("cue"), *[r6(values[i], n) for i, n in enumerate(names)])


def cue_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = [(100.0, "short"), (1000.0, "middle"), (5000.0, "long")]
    return table(spark, sf_dir, "documents").select("doc_id", T.binned(F.length("text"), bins, "huge").alias("bin"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as transcribed segments, with stand-ins of a transcriber's two measures; ``spoken``:
    not silence, none of the patterns, no repeated half, and likely enough."""
    c = table(spark, sf_dir, "conversations").withColumns({"said": T.strip(F.coalesce("text", F.lit(""))), "silence": (F.col("conv_id") * 3 + F.col("turn")) % 10 / 10.0, "logprob": -((F.col("conv_id") + F.col("turn") * 7) % 11) / 10.0})
    w = c.withColumn("w", T.words(F.col("said")))
    made_up = (F.col("said") != "") & (T.any_pattern(F.col("said"), L.HALLUCINATIONS) | T.half_repeated(F.col("w")) | (F.col("logprob") < -0.7))
    return w.withColumn("spoken", (F.col("silence") <= 0.6) & ~made_up).drop("w")


def hallucination_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that are speech and not made up."""
    return _segments(spark, sf_dir).filter("spoken").select("conv_id", "turn")


def segment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken texts of a conversation in turn order, joined by spaces."""
    kept = F.when(F.col("spoken"), F.struct("turn", "role", "said"))
    c = _segments(spark, sf_dir).groupBy("conv_id")
    joined = T.strip(F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["said"]), " "))
    return c.agg(F.md5(joined).alias("transcript_md5"), F.count(kept).alias("segments"))


def suspect_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", T.contained_patterns(F.col("text"), PATTERNS).alias("p"))
    return found.filter(F.size("p") > 0).select("doc_id", F.array_join("p", ",").alias("patterns"))


def tag_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.tag(F.col("html"), "title").alias("title"))


def output_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("id", T.output_parts(F.col("raw"), F.col("fallback")).alias("x")).select("id", "x.*")


def format_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = F.col("raw").rlike(r"(?s)<think>.*?</think>\s*<answer>.*?</answer>")
    return _raw(spark, sf_dir).agg(r6(F.coalesce(F.avg(fine.cast("double")), F.lit(0.0)), "compliance"))


def reward_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards of outputs, and each against the mean of its group of ten prompts."""
    answer = F.lower(T.strip(F.regexp_extract("raw", T.ANSWER, 1)))
    right = (answer == "amused").cast("double")
    form = F.col("raw").rlike(r"(?s)<think>.*?</think>\s*<answer>.*?</answer>").cast("double")
    rows = _raw(spark, sf_dir).select("id", right.alias("accuracy"), form.alias("format"), (0.8 * right + 0.2 * form).alias("total"))
    return rows.select("id", "accuracy", "format", r6("total"), r6(F.col("total") - F.avg("total").over(Window.partitionBy(F.floor(F.col("id") / 10))), "advantage"))


def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's two scores; without a label score, 10 where the labels match, else 0."""
    match = F.when(F.col("id") % 2 == 0, 10.0).otherwise(0.0)
    return _raw(spark, sf_dir).select("id", T.told_score(F.col("raw"), "clue_score", F.lit(5.0)).alias("clue"), T.told_score(F.col("raw"), "label_score", match).alias("label"))


#: A consolidator's output on every document, in five forms.
CONSOLIDATED = """CASE doc_id % 5 WHEN 0 THEN '<think>a</think><think> ' || doc_id || ' </think><answer> Hype </answer><confidence>0.' || doc_id % 7 || '</confidence><distribution>{"hype": 0.5, "sad": ' || doc_id % 4 || ', "odd": 9}</distribution>'
 WHEN 1 THEN '<answer>odd</answer><confidence>7.5</confidence>' WHEN 2 THEN '<confidence>1.2.3</confidence><distribution>{broken}</distribution>' WHEN 3 THEN '' ELSE '<ANSWER>fear</ANSWER><distribution>{"fear": 0}</distribution>' END"""


def consolidator_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.consolidated(F.expr(CONSOLIDATED), F.lit("neutral")).alias("x"))
    return rows.select("doc_id", "x.reasoning", "x.label", r6("x.confidence", "confidence"), F.size("x.distribution").alias("known"), r6(F.try_element_at("x.distribution", F.lit("sad")), "sad"))


def substring_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.first_contained(F.col("text"), ["sad", "fear", "hype", "the"], "neutral").alias("label"))


def genre_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.first_contained(F.concat("source", F.lit("_"), F.element_at(F.array(*[F.lit(g) for g in T.GENRES]), (F.col("doc_id") % 6 + 1).cast("int")), F.lit("_clip")), T.GENRES, "moba").alias("genre"))


def label_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = F.create_map(*[F.lit(x) for pair in (("en", 0), ("de", 1), ("fr", 2)) for x in pair])
    return table(spark, sf_dir, "documents").groupBy(F.coalesce(F.try_element_at(merged, F.col("lang")), F.lit(0)).alias("label")).agg(F.count("*").alias("n"))


def codeswitch_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of words with a letter outside ASCII, in three buckets."""
    w = T.words(F.col("text"))
    share = F.coalesce(F.try_divide(F.size(F.filter(w, lambda x: x.rlike(r"[^\x00-\x7F]"))), F.size(w)), F.lit(0.0))
    bucket = F.when(share < 0.1, "none").when(share < 0.3, "low").otherwise("high")
    return table(spark, sf_dir, "documents").select("doc_id", r6(share, "share"), bucket.alias("bucket"))


def label_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual labels: confidence within [0, 1], and scaled with the alternatives to a sum of one
    where there are any; none given is neutral at 0; unknown labels are told as not valid."""
    docs = table(spark, sf_dir, "documents").withColumns({"given": F.expr(GIVEN), "conf": F.expr("(doc_id % 15 - 2) / 10.0D"), "alternatives": F.expr("CASE WHEN doc_id % 3 = 0 THEN map() ELSE map('sad', (doc_id % 4) / 4.0D, 'fear', 0.5D) END")})
    return docs.select("doc_id", T.normalised_label(F.col("given"), F.col("conf"), F.col("alternatives")).alias("x")).select("doc_id", "x.label", r6("x.confidence", "confidence"), r6(F.coalesce("x.alternatives.sad", F.lit(0.0)), "sad"), r6(F.coalesce("x.alternatives.fear", F.lit(0.0)), "fear"), "x.placeholder", "x.valid")


def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of a document and its label as a prompt over the whole text, with
    defaults for what is absent."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    told = lambda c, otherwise="N/A": F.coalesce(F.col(c).cast("string"), F.lit(otherwise))
    prompt = F.concat(
        F.lit("Evidence:\n- Face: "), told("quality"), F.lit("\n- Scene: "), told("source"), F.lit("\n- Voice: "), told("toxic"),
        F.lit("\n- Speech ("), told("lang", "vi"), F.lit('): "'), told("text", ""), F.lit('"\n\nLabels: ' + ", ".join(L.EMOTIONS) + "\n<think></think>\n<answer></answer>"),
    )
    return docs.select("doc_id", F.md5(prompt).alias("prompt_md5"), F.length(prompt).alias("n_chars"))


def hash_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.substring(F.md5("url"), 1, 12).alias("url_hash"), F.sha2("html", 256).alias("html_sha256"))


def source_list_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of every distinct url."""
    return table(spark, sf_dir, "pages").groupBy(F.substring(F.md5("url"), 1, 12).alias("url_hash")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("seen"))


def json_map_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.explode_outer(F.from_json("props", "map<string,int>")).alias("key", "item"))
    return rows


def json_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "struct<k: int>")["k"]
    return table(spark, sf_dir, "events").groupBy(F.pmod(k, F.lit(10)).alias("k")).agg(F.count("*").alias("n"), r6(F.sum("value"), "total"))


def lang_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop-word language against the stored one."""
    w = T.words(F.lower("text"))
    count = lambda names: F.size(F.filter(w, lambda x: x.isin(*names)))
    votes = F.array(*[F.struct(count(n).alias("n"), F.lit(l).alias("lang")) for l, n in (("en", ["the", "of", "and", "to"]), ("de", ["der", "die", "und", "den"]), ("fr", ["le", "la", "les", "et"]), ("es", ["el", "los", "que", "y"]))])
    best = F.array_max(votes)["lang"]
    return table(spark, sf_dir, "documents").select("doc_id", best.alias("detected"), (best != F.col("lang")).alias("mismatch"))


W = "list_filter(regexp_split_to_array({t}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
SCORE = "<{n}>\\s*([0-9]+(?:\\.[0-9]+)?)\\s*</{n}>"
_in = lambda names: ", ".join(f"'{n}'" for n in names)
SPOKEN = f"""WITH c AS (SELECT *, {STRIP.format(x="coalesce(text, '')")} AS said FROM conversations), w AS (SELECT *, {W.format(t="said")} AS w FROM c),
s AS (SELECT *, (conv_id * 3 + turn) % 10 / 10.0::DOUBLE <= 0.6 AND NOT (said <> '' AND (regexp_matches(said, '(?i){"|".join(f"(?:{p})" for p in L.HALLUCINATIONS)}') OR (len(w) >= 6 AND w[1:len(w) // 2] = w[len(w) // 2 + 1:2 * (len(w) // 2)]) OR -((conv_id + turn * 7) % 11) / 10.0::DOUBLE < -0.7)) AS spoken FROM w)
"""
FIRST = lambda text, names, other: "CASE " + " ".join(f"WHEN contains(lower({text}), '{n}') THEN '{n}'" for n in names) + f" ELSE '{other}' END"
OK = "regexp_matches(raw, '(?s)<think>.*?</think>\\s*<answer>.*?</answer>')"

#: The text cue with its measures as they are, not rounded.
TEXT_CUES = f"WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {W.format(t="lower(coalesce(text, ''))")} AS w FROM documents), c AS (SELECT doc_id, len(regexp_extract_all(text, '[!?]+')) AS e, len(list_filter(w, lambda x: x IN ({_in(NEGATIVE)}))) AS n, len(list_filter(w, lambda x: x IN ({_in(GAMES)}))) AS g, len(w) AS k FROM w) SELECT doc_id, CASE WHEN k = 0 THEN 'no_speech' ELSE concat_ws(', ', CASE WHEN e > 0 THEN 'exclamation' END, CASE WHEN n > 0 THEN 'negative_lexicon' END, CASE WHEN g > 0 THEN 'game_term' END, k || '_words') END AS cue, CASE WHEN k = 0 THEN 0 ELSE least(e, 5) / 5.0::DOUBLE END AS exclaims, least(n, 5) / 5.0::DOUBLE AS negatives, least(g, 5) / 5.0::DOUBLE AS games, least(k, 30) / 30.0::DOUBLE AS length FROM c"
QUERIES = {
    "text_cues": (text_cues, "SELECT doc_id, cue, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("exclaims", "negatives", "games", "length")) + f" FROM ({TEXT_CUES}) AS t"),
    "cue_bins": (cue_bins, "SELECT doc_id, CASE WHEN length(text) < 100 THEN 'short' WHEN length(text) < 1000 THEN 'middle' WHEN length(text) < 5000 THEN 'long' ELSE 'huge' END AS bin FROM documents"),
    "hallucination_filter": (hallucination_filter, SPOKEN + "SELECT conv_id, turn FROM s WHERE spoken"),
    "segment_join": (segment_join, SPOKEN + f"SELECT conv_id, md5({STRIP.format(x="coalesce(string_agg(said, ' ' ORDER BY turn, role, said) FILTER (spoken), '')")}) AS transcript_md5, count(*) FILTER (spoken) AS segments FROM s GROUP BY conv_id"),
    "suspect_audit": (suspect_audit, "SELECT doc_id, p AS patterns FROM (SELECT doc_id, array_to_string(list_filter(['subscribe', 'license', 'the and', 'www'], lambda p: contains(lower(text), p)), ',') AS p FROM documents) AS x WHERE p <> ''"),
    "tag_parse": (tag_parse, "SELECT page_id, nullif(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '') AS title FROM pages"),
    "output_parse": (output_parse, f"WITH p AS (SELECT *, regexp_matches(raw, '{T.CUES}') AND regexp_matches(raw, '{T.EMOTION}') AS c, regexp_extract_all(raw, '{T.THINK}', 1) AS t, regexp_matches(raw, '{T.ANSWER}') AS a FROM {_RAW}) SELECT id, CASE WHEN c THEN {STRIP.format(x=f"regexp_extract(raw, '{T.CUES}', 1)")} WHEN len(t) > 0 THEN {STRIP.format(x='t[-1]')} ELSE {STRIP.format(x='raw')} END AS reasoning, CASE WHEN c THEN lower(regexp_extract(raw, '{T.EMOTION}', 1)) WHEN a THEN {STRIP.format(x=f"regexp_extract(raw, '{T.ANSWER}', 1)")} ELSE fallback END AS answer, c OR (len(t) > 0 AND a) AS valid FROM p"),
    "format_compliance": (format_compliance, f"SELECT round(avg({OK}::INTEGER), 6) AS compliance FROM {_RAW}"),
    "reward_scores": (reward_scores, f"WITH s AS (SELECT id, (lower({STRIP.format(x=f"regexp_extract(raw, '{T.ANSWER}', 1)")}) = 'amused')::INTEGER::DOUBLE AS accuracy, {OK}::INTEGER::DOUBLE AS format FROM {_RAW}) SELECT id, accuracy, format, round(0.8 * accuracy + 0.2 * format, 6) AS total, round(0.8 * accuracy + 0.2 * format - avg(0.8 * accuracy + 0.2 * format) OVER (PARTITION BY floor(id / 10.0)), 6) AS advantage FROM s"),
    "judge_scores": (judge_scores, f"SELECT id, greatest(0, least(10, coalesce(try_cast(nullif(regexp_extract(raw, '{SCORE.format(n='clue_score')}', 1), '') AS DOUBLE), 5)))::DOUBLE AS clue, greatest(0, least(10, coalesce(try_cast(nullif(regexp_extract(raw, '{SCORE.format(n='label_score')}', 1), '') AS DOUBLE), CASE WHEN id % 2 = 0 THEN 10 ELSE 0 END)))::DOUBLE AS label FROM {_RAW}"),
    "consolidator_parse": (consolidator_parse, "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN doc_id::VARCHAR ELSE '' END AS reasoning, CASE doc_id % 5 WHEN 0 THEN 'hype' WHEN 4 THEN 'fear' ELSE 'neutral' END AS label, CASE doc_id % 5 WHEN 0 THEN round(doc_id % 7 / 10.0::DOUBLE, 6) WHEN 1 THEN 1.0 ELSE 0.5 END AS confidence, CASE doc_id % 5 WHEN 0 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS known, CASE WHEN doc_id % 5 = 0 THEN round(doc_id % 4 / (0.5::DOUBLE + doc_id % 4), 6) END AS sad FROM documents"),
    "substring_label": (substring_label, f"SELECT doc_id, {FIRST('text', ['sad', 'fear', 'hype', 'the'], 'neutral')} AS label FROM documents"),
    "genre_infer": (genre_infer, "WITH g AS (SELECT doc_id, source || '_' || (['moba', 'fps', 'horror', 'casual', 'rpg', 'mobile'])[(doc_id % 6 + 1)::INTEGER] || '_clip' AS stem FROM documents) SELECT doc_id, " + FIRST("stem", T.GENRES, "moba") + " AS genre FROM g"),
    "label_merge": (label_merge, "SELECT CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 0 END AS label, count(*) AS n FROM documents GROUP BY 1"),
    "codeswitch_bucket": (codeswitch_bucket, f"WITH w AS (SELECT doc_id, {W.format(t='text')} AS w FROM documents), s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda x: regexp_matches(x, '[^\\x00-\\x7F]'))) / len(w)::DOUBLE END AS share FROM w) SELECT doc_id, round(share, 6) AS share, CASE WHEN share < 0.1 THEN 'none' WHEN share < 0.3 THEN 'low' ELSE 'high' END AS bucket FROM s"),
    "label_normalise": (label_normalise, f"WITH g AS (SELECT doc_id, CASE WHEN doc_id % 11 = 10 THEN NULL ELSE (string_split('{','.join(L.EMOTIONS)},nope', ','))[(doc_id % 9 + 1)::INTEGER] END AS given, greatest(0, least(1, (doc_id % 15 - 2) / 10.0::DOUBLE)) AS conf, doc_id % 3 <> 0 AND doc_id % 11 <> 10 AS alt, (doc_id % 4) / 4.0::DOUBLE AS sad FROM documents), t AS (SELECT *, CASE WHEN alt THEN conf + sad + 0.5 ELSE 1 END AS total FROM g) SELECT doc_id, coalesce(given, 'neutral') AS label, CASE WHEN given IS NULL THEN 0 ELSE round(conf / total, 6) END AS confidence, CASE WHEN alt THEN round(sad / total, 6) ELSE 0 END AS sad, CASE WHEN alt THEN round(0.5 / total, 6) ELSE 0 END AS fear, given IS NULL AS placeholder, coalesce(given, 'neutral') <> 'nope' AS valid FROM t"),
    "prompt_build": (prompt_build, f"WITH p AS (SELECT doc_id, 'Evidence:' || chr(10) || '- Face: ' || coalesce(quality::VARCHAR, 'N/A') || chr(10) || '- Scene: ' || coalesce(source, 'N/A') || chr(10) || '- Voice: ' || coalesce(toxic::VARCHAR, 'N/A') || chr(10) || '- Speech (' || coalesce(lang, 'vi') || '): \"' || coalesce(text, '') || '\"' || chr(10) || chr(10) || 'Labels: {', '.join(L.EMOTIONS)}' || chr(10) || '<think></think>' || chr(10) || '<answer></answer>' AS p FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id, md5(p) AS prompt_md5, length(p)::INTEGER AS n_chars FROM p"),
    "hash_keys": (hash_keys, "SELECT page_id, md5(url)[1:12] AS url_hash, sha256(html) AS html_sha256 FROM pages"),
    "source_list_dedup": (source_list_dedup, "SELECT md5(url)[1:12] AS url_hash, min(page_id) AS page_id, count(*) AS seen FROM pages GROUP BY 1"),
    "json_map_scan": (json_map_scan, "SELECT event_id, 'k' AS key, (props::JSON->>'k')::INTEGER AS item FROM events"),
    "json_group": (json_group, "SELECT (props::JSON->>'k')::INTEGER % 10 AS k, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1"),
    "lang_mismatch": (lang_mismatch, f"WITH w AS (SELECT doc_id, lang, {W.format(t='lower(text)')} AS w FROM documents), c AS (SELECT doc_id, lang, unnest(['en', 'de', 'fr', 'es']) AS l, unnest([len(list_filter(w, lambda x: x IN ('the', 'of', 'and', 'to'))), len(list_filter(w, lambda x: x IN ('der', 'die', 'und', 'den'))), len(list_filter(w, lambda x: x IN ('le', 'la', 'les', 'et'))), len(list_filter(w, lambda x: x IN ('el', 'los', 'que', 'y')))]) AS n FROM w) SELECT doc_id, l AS detected, l <> lang AS mismatch FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, l DESC) AS r FROM c) AS x WHERE r = 1"),
}

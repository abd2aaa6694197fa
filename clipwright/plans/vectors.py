"""Vector queries: tokens, losses and augmentations on embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipwright.functions import arrays as A
from clipwright.operators import blocks as K
from clipwright.operators import splits as S
from clipwright.plans.evaluation import PRED, predictions, r6
from clipwright.sources.tables import table

WEIGHTS = [0.5 + 0.25 * k for k in range(10)]
RARE = [1, 4, 7]


def _e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", A.doubles(F.col("embedding")).alias("v"))


def _long(rows: DataFrame, name: str = "x") -> DataFrame:
    made = rows.select("vec_id", F.posexplode(name).alias("i", "x"))
    return made.select("vec_id", "i", r6("x"))


def masked_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax over four modalities of which some are missing."""
    b = F.col("vec_id")
    present = F.array(b % 2 != 0, b % 3 != 0, b % 2 != 0, b % 3 != 0)
    return _long(_e(spark, sf_dir).select("vec_id", A.masked_softmax(A.block(F.col("v"), 0, 4), present).alias("x")))


def present_modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modalities that are not all zero; a third of the blocks is set to zero."""
    blocks = [A.zero_if((F.col("vec_id") + k) % 3 == 0, A.block(F.col("v"), k, 16)) for k in range(4)]
    return _e(spark, sf_dir).select("vec_id", *[(~A.all_zero(b)).alias(n) for b, n in zip(blocks, ("audio", "face", "context", "text"), strict=True)])


def weighted_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, sum and weighted mean of weighted focal and cross-entropy losses."""
    logits = A.block(F.col("v"), 0, 10)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.col("label") + 1)
    rows = _e(spark, sf_dir).select(A.weighted_focal(logits, F.col("label"), 2.0, WEIGHTS).alias("focal"), A.weighted_focal(logits, F.col("label"), 0.0, WEIGHTS).alias("ce"), weight.alias("w"))
    return rows.agg(r6(F.avg("focal"), "focal_mean"), r6(F.sum("focal"), "focal_sum"), r6(F.sum("ce") / F.sum("w"), "ce_weighted"), r6(F.avg("ce"), "ce_mean"))


def reconstruction_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smooth L1 by modality over a batch, the face only where there is one, and their sum."""
    part = lambda a, n, b: A.smooth_l1(F.slice("v", a, n), F.slice("v", b, n))
    rows = _e(spark, sf_dir).select("label", F.when(F.col("vec_id") % 3 != 0, part(1, 5, 33)).alias("face"), part(6, 3, 38).alias("voice"), part(9, 3, 41).alias("motion"), part(12, 4, 44).alias("text"))
    means = rows.groupBy("label").agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("face", "voice", "motion", "text")])
    return means.select("label", *[r6(c) for c in ("face", "voice", "motion", "text")], r6(F.col("face") + F.col("voice") + F.col("motion") + F.col("text"), "total"))


def hier_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of eight classes from an easy and a hard group."""
    v = F.col("v")
    return _long(_e(spark, sf_dir).select("vec_id", A.hierarchical(F.slice(v, 1, 2), F.slice(v, 3, 4), F.slice(v, 7, 4), [0, 2, 4, 6], [1, 3, 5, 7]).alias("x")))


def pad_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged tokens of width 4, padded to the longest of their batch of sixteen clips."""
    ragged = _e(spark, sf_dir).select("vec_id", F.slice(A.rows_of(F.col("v"), 16, 4), F.lit(1), (F.col("vec_id") % 9 + 1).cast("int")).alias("t"), F.floor(F.col("vec_id") / 16).alias("batch"))
    longest = F.max(F.size("t")).over(Window.partitionBy("batch"))
    made = ragged.withColumn("steps", longest).select("vec_id", F.size("t").alias("own"), A.padded(F.col("t"), F.col("steps"), 4).alias("p"))
    return made.select("vec_id", "own", F.size("p").alias("steps"), r6(A.total(F.flatten("p")), "total"), r6(A.total(F.element_at("p", -1)), "last"))


def token_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, max, first and attention pooling of 16 tokens, after taking off a batch axis."""
    tokens = A.squeezed(F.array(A.rows_of(F.col("v"), 16, 4)))
    rows = _e(spark, sf_dir).withColumn("t", tokens).withColumn("s", F.transform("t", lambda r: F.get(r, F.lit(0)) * 2))
    pools = {how: A.pooled(F.col("t"), how, F.col("s")) for how in ("mean", "max", "cls", "attention")}
    return rows.select("vec_id", *[r6(F.get(p, F.lit(d)), f"{how}{d}") for how, p in pools.items() for d in (0, 3)])


def patch_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 8 grid in 3 x 3 buckets."""
    return _long(_e(spark, sf_dir).select("vec_id", A.grid_pool(F.col("v"), 8, 3, 3).alias("x")))


def _hash(key: str, salt: int, n: int) -> Column:
    """A number below n, the same in any engine, from a key and a salt."""
    return F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{salt}"))), 1, 7), 16, 10).cast("long") % n


def embed_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a chance of a half, one contiguous span of 1 to 3 of 16 tokens set to zero."""
    length = _hash("vec_id", 1, 3) + 1
    start = _hash("vec_id", 2, 1000) % (17 - length)
    masked = F.when(_hash("vec_id", 3, 2) == 0, A.time_masked(A.rows_of(F.col("v"), 16, 4), start, length)).otherwise(A.rows_of(F.col("v"), 16, 4))
    rows = _e(spark, sf_dir).select("vec_id", masked.alias("m"))
    return rows.select("vec_id", F.size(F.filter("m", lambda r: F.forall(r, lambda x: x == 0))).alias("gone"), r6(A.total(F.flatten("m")), "total"))


def embed_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with normal noise of a tenth of its own spread added, long; the draws follow
    from the clip's number by hashes, so any engine and any run repeats them."""
    spread = F.sqrt(F.greatest((A.dot(F.col("v"), F.col("v")) - 64 * A.mean(F.col("v")) * A.mean(F.col("v"))) / 63, F.lit(1e-12)))
    drawn = lambda salt: lambda i: (F.conv(F.substring(F.md5(F.concat(F.col("vec_id").cast("string"), F.lit(f":{salt}:"), i.cast("string"))), 1, 7), 16, 10).cast("double") + 0.5) / 2**28
    normal = lambda i: F.sqrt(-2 * F.log(drawn("a")(i))) * F.cos(2 * F.pi() * drawn("b")(i))
    rows = _e(spark, sf_dir).select("vec_id", "v", spread.alias("s"))
    noisy = A.bound(F.col("s"), lambda s: F.transform(F.col("v"), lambda x, i: x + 0.1 * s * normal(i)))
    return _long(rows.select("vec_id", noisy.alias("x")))


def class_scores_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All class scores of each clip, the greatest first; of equal ones the lesser class."""
    scored = predictions(spark, sf_dir).select("vec_id", F.transform("scores", lambda s, i: F.struct((-s).alias("minus"), i.alias("class"))).alias("s"))
    listed = scored.select("vec_id", F.posexplode(F.array_sort("s")).alias("rank", "x"))
    return listed.select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("x.class").alias("class"), r6(-F.col("x.minus"), "score"))


def modality_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a chance of 0.3 one of four modalities goes; the face takes its flag along."""
    chosen = F.when(_hash("vec_id", 5, 10) < 3, _hash("vec_id", 6, 4))
    rows = _e(spark, sf_dir).withColumn("d", F.coalesce(chosen, F.lit(-1)))
    return rows.select("vec_id", F.col("d").alias("dropped"), ((F.col("vec_id") % 2 == 0) & (F.col("d") != 1)).alias("has_face"), *[r6(A.total(A.zero_if(F.col("d") == i, A.block(F.col("v"), i, 16))), m) for i, m in enumerate(("audio", "face", "context", "text"))])


def mixup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector mixed with a partner of a rare class, which its hash picks by rank; the
    share is never below a half."""
    e = _e(spark, sf_dir)
    partners = S.numbered(e.filter(F.col("label").isin(RARE)).select(F.col("vec_id").alias("partner"), F.col("label").alias("label_b"), F.col("v").alias("w")), "partner")
    size = partners.agg(F.max("place").alias("k"))
    rows = e.crossJoin(F.broadcast(size)).withColumn("place", _hash("vec_id", 7, 1_000_003) % (F.col("k") + 1)).withColumn("share", _hash("vec_id", 8, 1000) / 1000.0)
    share = F.greatest("share", 1 - F.col("share"))
    mixed = F.zip_with("v", "w", lambda a, b: share * a + (1 - share) * b)
    return rows.join(partners, "place").select("vec_id", "partner", F.col("label").alias("label_a"), "label_b", r6(share, "share"), r6(A.total(mixed), "total"))


def pair_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of what the cosines of two classes' vectors exceed a margin by, over stated pairs of
    classes. Each vector of one class meets every one of the other: that is the measure."""
    pairs = spark.createDataFrame([(0, 1), (2, 5), (3, 99)], "left long, right long")
    rows = _e(spark, sf_dir).select(F.col("label").alias("by"), F.col("vec_id").alias("id"), "v")
    return K.margin_excess(rows, pairs, 0.05).select(F.col("left").cast("int").alias("a"), F.col("right").cast("int").alias("b"), "n", r6("loss"))


def soft_token_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest of the vocabulary, all embeddings' first blocks, to all eight tokens of
    each clip."""
    e = _e(spark, sf_dir)
    words = e.select(F.col("vec_id").alias("id"), A.block(F.col("v"), 0, 8).alias("v"))
    tokens = e.select("vec_id", F.posexplode(A.rows_of(F.col("v"), 8, 8)).alias("token", "v"))
    near = K.nearest(tokens.select((F.col("vec_id") * 8 + F.col("token")).alias("id"), "v"), words, 3)
    token = F.pmod("id", F.lit(8)).cast("int")
    return near.select(F.expr("id div 8").alias("vec_id"), token.alias("token"), "rank", "word", r6("s"))


def silhouette_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean silhouette of embeddings, English against all other languages, and of each side."""
    docs = table(spark, sf_dir, "documents").filter("lang is not null").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "en").otherwise("other").alias("by"))
    rows = _e(spark, sf_dir).select(F.col("vec_id").alias("id"), "v").join(docs, "id")
    told = K.silhouettes(rows)
    return told.rollup("by").agg(F.count("*").alias("n"), r6(F.avg("silhouette"), "silhouette")).select(F.coalesce("by", F.lit("all")).alias("side"), "n", "silhouette")


def mean_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over the 16 tokens of each clip, long."""
    return _long(_e(spark, sf_dir).select("vec_id", A.pooled(A.rows_of(F.col("v"), 16, 4), "mean").alias("x")))


_B = "b AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_h = lambda salt, n: f"(('0x' || md5(vec_id || ':{salt}')[1:7])::BIGINT % {n})"
_CE = "(ln(list_sum(list_transform(v[1:10], lambda x: exp(x)))) - v[label + 1])"
_W = "(0.5 + 0.25::DOUBLE * label)"
_l1 = lambda a, n, b: f"list_avg(list_transform(range(0, {n}), lambda i: CASE WHEN abs(v[{a} + i] - v[{b} + i]) < 1 THEN 0.5 * (v[{a} + i] - v[{b} + i]) ** 2 ELSE abs(v[{a} + i] - v[{b} + i]) - 0.5 END))"
_ls = lambda a, n: f"ln(list_sum(list_transform(v[{a}:{a + n - 1}], lambda x: exp(x))))"
_tok = lambda d: f"list_transform(range(0, 16), lambda t: v[4 * t + {d} + 1])"
_GRID = [[(r, c) for r in range(i * 8 // 3, -(-(i + 1) * 8 // 3)) for c in range(j * 8 // 3, -(-(j + 1) * 8 // 3))] for i in range(3) for j in range(3)]
QUERIES = {
    "masked_weights": (masked_weights, f"WITH {_B}, k AS (SELECT vec_id, i::INTEGER AS i, exp(v[i + 1]) AS e, CASE WHEN i % 2 = 0 THEN vec_id % 2 <> 0 ELSE vec_id % 3 <> 0 END OR vec_id % 6 = 0 AS on_ FROM b, range(4) AS t(i)) SELECT vec_id, i, round(CASE WHEN on_ THEN e / sum(e) FILTER (on_) OVER (PARTITION BY vec_id) ELSE 0 END, 6) AS x FROM k"),
    "present_modalities": (present_modalities, "SELECT vec_id, vec_id % 3 <> 0 AS audio, (vec_id + 1) % 3 <> 0 AS face, (vec_id + 2) % 3 <> 0 AS context, (vec_id + 3) % 3 <> 0 AS text FROM embeddings"),
    "weighted_losses": (weighted_losses, f"WITH {_B}, l AS (SELECT {_CE} AS ce, {_W} AS w FROM b) SELECT round(avg(w * power(1 - exp(-ce), 2) * ce), 6) AS focal_mean, round(sum(w * power(1 - exp(-ce), 2) * ce), 6) AS focal_sum, round(sum(w * ce) / sum(w), 6) AS ce_weighted, round(avg(w * ce), 6) AS ce_mean FROM l"),
    "reconstruction_loss": (reconstruction_loss, f"WITH {_B}, l AS (SELECT label, coalesce(avg({_l1(1, 5, 33)}) FILTER (vec_id % 3 <> 0), 0) AS face, avg({_l1(6, 3, 38)}) AS voice, avg({_l1(9, 3, 41)}) AS motion, avg({_l1(12, 4, 44)}) AS text FROM b GROUP BY label) SELECT label, round(face, 6) AS face, round(voice, 6) AS voice, round(motion, 6) AS motion, round(text, 6) AS text, round(face + voice + motion + text, 6) AS total FROM l"),
    "hier_logprob": (hier_logprob, f"WITH {_B}, g AS (SELECT *, {_ls(1, 2)} AS a, {_ls(3, 4)} AS e, {_ls(7, 4)} AS h FROM b) SELECT vec_id, i::INTEGER AS i, round(CASE WHEN i % 2 = 0 THEN v[1] - a + v[3 + i // 2] - e ELSE v[2] - a + v[7 + i // 2] - h END, 6) AS x FROM g, range(8) AS t(i)"),
    "pad_tokens": (pad_tokens, f"WITH {_B}, o AS (SELECT *, (vec_id % 9 + 1)::INTEGER AS own, max((vec_id % 9 + 1)::INTEGER) OVER (PARTITION BY vec_id // 16) AS steps FROM b) SELECT vec_id, own, steps, round(list_sum(v[1:4 * own]), 6) AS total, CASE WHEN own < steps THEN 0 ELSE round(list_sum(v[4 * own - 3:4 * own]), 6) END AS last FROM o"),
    "token_pooling": (token_pooling, f"WITH {_B}, w AS (SELECT *, list_transform({_tok(0)}, lambda x: exp(2 * x)) AS a FROM b) SELECT vec_id, " + ", ".join(f"round(list_avg({_tok(d)}), 6) AS mean{d}, round(list_max({_tok(d)}), 6) AS max{d}, round(v[{d + 1}], 6) AS cls{d}, round(list_dot_product(a, {_tok(d)}) / list_sum(a), 6) AS attention{d}" for d in (0, 3)) + " FROM w"),
    "patch_pool": (patch_pool, f"WITH {_B} " + " UNION ALL ".join(f"SELECT vec_id, {k} AS i, round(({' + '.join(f'v[{8 * r + c + 1}]' for r, c in cells)}) / {len(cells)}, 6) AS x FROM b" for k, cells in enumerate(_GRID))),
    "embed_mask": (embed_mask, f"WITH {_B}, m AS (SELECT vec_id, v, {_h(1, 3)} + 1 AS n, {_h(2, 1000)} % (16 - {_h(1, 3)}) AS s, {_h(3, 2)} = 0 AS on_ FROM b) SELECT vec_id, CASE WHEN on_ THEN n::INTEGER ELSE 0 END AS gone, round(list_sum(v) - CASE WHEN on_ THEN list_sum(v[4 * s + 1:4 * (s + n)]) ELSE 0 END, 6) AS total FROM m"),
    "embed_noise": (embed_noise, f"WITH {_B}, m AS (SELECT vec_id, v, sqrt(greatest((list_dot_product(v, v) - 64 * list_avg(v) * list_avg(v)) / 63, 1e-12)) AS s FROM b), u AS (SELECT vec_id, s, k.i, v[k.i + 1] AS x, (('0x' || md5(vec_id || ':a:' || k.i)[1:7])::BIGINT::DOUBLE + 0.5) / 268435456 AS a, (('0x' || md5(vec_id || ':b:' || k.i)[1:7])::BIGINT::DOUBLE + 0.5) / 268435456 AS c FROM m, range(64) AS k(i)) SELECT vec_id, i::INTEGER AS i, round(x + 0.1::DOUBLE * s * (sqrt(-2 * ln(a)) * cos(2 * pi() * c)), 6) AS x FROM u"),
    "class_scores_sorted": (class_scores_sorted, PRED + "SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, class)::INTEGER AS rank, class, round(s, 6) AS score FROM sims"),
    "modality_drop": (modality_drop, f"WITH {_B}, d AS (SELECT *, CASE WHEN {_h(5, 10)} < 3 THEN {_h(6, 4)} ELSE -1 END AS d FROM b) SELECT vec_id, d AS dropped, vec_id % 2 = 0 AND d <> 1 AS has_face, " + ", ".join(f"CASE WHEN d = {i} THEN 0 ELSE round(list_sum(v[{16 * i + 1}:{16 * i + 16}]), 6) END AS {m}" for i, m in enumerate(("audio", "face", "context", "text"))) + " FROM d"),
    "mixup": (mixup, f"WITH {_B}, p AS (SELECT vec_id AS partner, label AS label_b, v AS w, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM b WHERE label IN (1, 4, 7)), r AS (SELECT *, {_h(7, 1_000_003)} % (SELECT count(*) FROM p) AS place, greatest({_h(8, 1000)} / 1000.0::DOUBLE, 1 - {_h(8, 1000)} / 1000.0::DOUBLE) AS share FROM b) SELECT vec_id, partner, label AS label_a, label_b, round(share, 6) AS share, round(share * list_sum(v) + (1 - share) * list_sum(w), 6) AS total FROM r JOIN p USING (place)"),
    "pair_margin": (pair_margin, f"WITH {_B}, k AS (SELECT * FROM (VALUES (0, 1), (2, 5), (3, 99)) AS t(a, b)) SELECT k.a, k.b, count(*) AS n, round(avg(greatest(list_cosine_similarity(x.v, y.v) - 0.05, 0)), 6) AS loss FROM k JOIN b AS x ON x.label = k.a JOIN b AS y ON y.label = k.b GROUP BY 1, 2"),
    "soft_token_top3": (soft_token_top3, f"WITH {_B}, s AS (SELECT t.vec_id, k.i::INTEGER AS token, w.vec_id AS word, round(list_cosine_similarity(t.v[8 * k.i + 1:8 * k.i + 8], w.v[1:8]), 9) AS s FROM b AS t, range(8) AS k(i), b AS w) SELECT vec_id, token, row_number() OVER (PARTITION BY vec_id, token ORDER BY s DESC, word)::INTEGER AS rank, word, round(s, 6) AS s FROM s QUALIFY row_number() OVER (PARTITION BY vec_id, token ORDER BY s DESC, word) <= 3"),
    "silhouette_by_language": (silhouette_by_language, f"WITH {_B}, r AS (SELECT vec_id, v, CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS side FROM b JOIN documents ON doc_id = vec_id WHERE lang IS NOT NULL), d AS (SELECT x.vec_id, x.side, y.side AS other, sum(list_distance(x.v, y.v)) AS s, count(*) AS n FROM r AS x JOIN r AS y ON true GROUP BY ALL), k AS (SELECT vec_id, side, max(CASE WHEN other = side THEN n END) AS n, max(CASE WHEN other = side THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN other <> side THEN s / n END) AS b FROM d GROUP BY 1, 2) SELECT coalesce(side, 'all') AS side, count(*) AS n, round(avg(CASE WHEN n > 1 AND b IS NOT NULL THEN coalesce((b - a) / nullif(greatest(a, b), 0), 0) ELSE 0 END), 6) AS silhouette FROM k GROUP BY ROLLUP (side)"),
    "mean_embedding": (mean_embedding, f"WITH {_B} SELECT vec_id, d.d::INTEGER AS i, round(list_avg(list_transform(range(0, 16), lambda t: v[4 * t + d.d + 1])), 6) AS x FROM b, range(4) AS d(d)"),
}

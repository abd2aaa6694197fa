"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clipwright.llm import byte_pairs, chat_format, embedding_dedup, exact_dedup, fill_in_middle, language_id, packing, secrets, sentence_pieces, simhash, spelling, suffix_dedup, toxicity
from clipwright.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.document_digests(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.read_back(chat_format.windows(chat_format.with_probe(table(spark, sf_dir, "conversations"))))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.document_digests(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.corpus_variants(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_language_id, op3_secrets, op4_packing, op5_exact_dedup, op6_toxicity, op7_sentence_pieces, op8_chat_format, op9_suffix_dedup, op10_embedding_dedup, op11_byte_pairs, op12_spelling, op13_fill_in_middle, pipeline)}


def oracle_sql() -> dict[str, str]:
    """DuckDB twins of the queries that SQL can express."""
    return {"op5_exact_dedup": OP5_SQL, "op12_spelling": OP12_SQL, "op13_fill_in_middle": OP13_SQL}


OP5_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
         count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
         sha256(coalesce(text, '')) AS text_sha256
  FROM documents) AS d
"""

OP13_SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, t, units, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM cut),
placed AS (
  SELECT doc_id, t, n, array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
         array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
         array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM placed
"""

OP12_SQL = """
WITH RECURSIVE remainders AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS r
  FROM range(256) AS t(i)),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)),
counted AS (
  SELECT run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h
  FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda c, b: xor(c >> 8, r[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM counted, remainders),
spelled AS (
  SELECT CASE WHEN crc % 31 = 0 THEN left(run, (crc % length(run))::INT) || substr(run, (crc % length(run))::INT + 2) ELSE run END AS word, n
  FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
shorter AS (SELECT word, i, left(word, i::INT) || substr(word, i::INT + 2) AS v FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
halves AS (
  SELECT DISTINCT a.word AS word, b.word AS near FROM shorter AS a JOIN shorter AS b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT s.word, w.word FROM shorter AS s JOIN words AS w ON s.v = w.word),
near AS (SELECT word, near FROM halves UNION SELECT near, word FROM halves),
ranked AS (
  SELECT near.word, near.near, w.n, count(*) OVER (PARTITION BY near.word) AS n_near,
         row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, near.near) AS place
  FROM near JOIN words AS w ON w.word = near.near),
formed AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 10 * words.n THEN b.near END AS form,
         CASE WHEN b.n >= 10 * words.n THEN b.n END AS form_n
  FROM words LEFT JOIN ranked AS b ON b.word = words.word AND place = 1),
followed AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT followed.word, formed.form FROM followed JOIN formed ON followed.root = formed.word WHERE form IS NOT NULL),
ended AS (SELECT followed.word, root FROM followed JOIN formed ON followed.root = formed.word WHERE form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ended USING (word)
"""

"""The corpus pipeline: five stages over ``documents``, each by one operator.

1. language identification: documents whose language cannot be told go;
2. exact dedup: of equal texts the one with the largest doc_id stays;
3. SimHash near-dedup: of each component the document it is named by stays;
4. secret scans: spans found in a text are masked in it;
5. packing: the token sequences of what is left.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Nulls,
empty texts and repeated rows are treated as each operator states; an empty table passes
through as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from clipwright.llm import exact_dedup, language_id, packing, secrets, simhash
from clipwright.llm.common import stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_per_component(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_duplicates),
    ("near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Language identification is trained and packing needs a tokenizer; tests hold ``run``
#: against a brute-force version instead.
ORACLE_SQL = None


#: Rows of a batch that goes to a Python worker. Workers serve all stages one after the other,
#: so what a batch of whole texts takes in one of them adds up.
BATCH_ROWS, BATCH_SETTING = 250, "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written before the next."""
    docs = table(spark, sf_dir, "documents")
    with _small_batches(spark):
        for name, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        return STAGES[-1][1](spark, docs, sf_dir)

"""Writers that can be taken up again after a loss, and reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def write_if_better(rows: DataFrame, path: str, best: float) -> float:
    """Writes the wrong rows of ``rows (y_true, y_pred, ...)`` in place of those before if the
    accuracy is above ``best``; returns the better of the two. No rows have accuracy 0."""
    accuracy = rows.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))).first()[0] or 0.0
    if accuracy > best:
        write_json(rows.filter("y_true <> y_pred"), path, "overwrite")
    return max(accuracy, best)


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Appends to JSON lines the rows whose key is not there yet; returns how many. A run that
    was broken off is taken up by calling it again: what it had committed is skipped before
    anything is computed. A key that ``rows`` repeat is written as often as they do."""
    spark = rows.sparkSession
    before = 0
    if exists(spark, path):
        done = spark.read.schema(rows.schema).json(path).select(key)
        before = done.count()
        rows = rows.join(done.distinct(), key, "left_anti").select(*rows.columns)
    rows.write.mode("append").json(path)
    return spark.read.schema(rows.schema).json(path).count() - before


def write_documents(rows: DataFrame, path: str, suffix: str = ".json") -> int:
    """One file for each of ``rows (clip_id string, document string)``, named by the clip; returns
    how many. Tasks write under another name and rename, so a file is there whole or not at
    all, and a task that is run again writes the same. A repeated clip's last file stays."""
    store, root = store_of(path)
    store.create_dir(root, recursive=True)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for clip, document in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                draft = f"{root}/_{uuid.uuid4().hex}"
                with store_of(path)[0].open_output_stream(draft) as file:
                    file.write((document or "").encode())
                store_of(path)[0].move(draft, f"{root}/{clip}{suffix}")
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], ["n"])

    return rows.select("clip_id", "document").mapInArrow(each, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def store_of(path: str) -> tuple[stores.FileSystem, str]:
    """The store that a path names, and the path in it."""
    return stores.FileSystem.from_uri(path if "://" in path or path.startswith(("/", "file:")) else f"file:///{path}")


def write_manifest(splits: DataFrame, path: str) -> None:
    """``(clip_id, split)`` as JSON objects ``{clip_id: split}``, one on each line, so that no
    task needs all of them."""
    splits.select(F.to_json(F.create_map(F.col("clip_id").cast("string"), "split")).alias("value")).write.text(path)


def write_report(rows: DataFrame, path: str, order: list[str], digits: int = 6) -> None:
    """One CSV file with a header, in order; fractions are rounded half to even. For reports,
    which are a row for each class or group."""
    rounded = [F.bround(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in rows.dtypes]
    rows.select(*rounded).coalesce(1).sortWithinPartitions(*order).write.option("header", True).csv(path)


def write_markdown(rows: DataFrame, path: str, order: list[str], digits: int = 6) -> None:
    """One file with a Markdown table, in order. For reports, as ``write_report``."""
    cell = lambda c, kind: F.format_string(f"%.{digits}f", F.bround(c, digits)) if kind in ("double", "float") else F.col(c).cast("string")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(cell(c, kind), F.lit("")) for c, kind in rows.dtypes]), F.lit(" |"))
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"]), "\n")
    # A row for each class or group: a bounded list.
    rows.groupBy().agg(F.concat_ws("\n", F.lit(head), F.when(F.count("*") > 0, body)).alias("value")).write.text(path)


def scored(rows: DataFrame, score: Callable[[pd.DataFrame], Iterable[float]], *keep: str) -> DataFrame:
    """``(*keep, score, error)``: what ``score`` gives for the rows of a batch, or the error it
    raised. A batch that raises is halved until the rows that do so stand alone, so their
    errors are theirs and the others keep their scores."""

    def told(part: pd.DataFrame) -> list[tuple[float | None, str | None]]:
        try:
            return [(float(x), None) for x in score(part)]
        except Exception as problem:  # noqa: BLE001 - the row carries it
            if len(part) == 1:
                return [(None, f"{type(problem).__name__}: {problem}")]
            half = len(part) // 2
            return told(part.iloc[:half]) + told(part.iloc[half:])

    def each(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = told(batch) if len(batch) else []
            values, errors = [x for x, _ in found], [e for _, e in found]
            yield batch[list(keep)].assign(score=pd.array(values, "Float64").astype(object), error=errors)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.mapInPandas(each, f"{kept}, score double, error string")


def updated_transcripts(annotations: DataFrame, found: DataFrame, overwrite: bool = False) -> DataFrame:
    """``annotations (clip_id, transcript)`` with those of ``found``, and ``fate``: transcribed,
    skipped (it has one, and is not to be overwritten) or missing (none was found)."""
    both = annotations.join(found.select("clip_id", F.col("transcript").alias("_new")), "clip_id", "left")
    has = (F.length(F.trim(F.coalesce("transcript", F.lit("")))) > 0) & F.lit(not overwrite)
    fate = F.when(has, "skipped").when(F.col("_new").isNull(), "missing").otherwise("transcribed")
    return both.withColumn("fate", fate).withColumn("transcript", F.when(F.col("fate") == "transcribed", F.col("_new")).otherwise(F.col("transcript"))).drop("_new")

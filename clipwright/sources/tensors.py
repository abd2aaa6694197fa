"""Tensors and keypoints in ``.npy`` files as a Spark data source.

``spark.read.format("tensors").load(folder)`` gives one row for each row of each array. The
planner lists names and sizes only and cuts the bytes into ranges: small files share a
task, a large one is read by many, and where the ranges asked for would make very many
tasks they are widened. Each task reads the header of a file it has a range of
and takes the rows that begin there. What cannot be read (no array, cut off, objects in
it) is one row with a ``problem`` and no values, and never fails a job; nothing is ever
unpickled.

``df.write.format("tensors")`` writes one file for each (clip, modality) as rows come in,
with a line of shape and hashes beside it. Tasks write into a folder that readers do not
look at; the job's commit renames it once, an aborted job leaves nothing. Of a tensor that
several jobs wrote, the latest counts. Folders may lie in any store that pyarrow reaches;
where a rename copies, as in object stores, the commit takes that long.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import prod
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from clipwright.sources.sinks import exists, store_of

ROWS = "clip_id string, modality string, row long, values array<double>, shape array<long>, problem string"
WRITTEN = ["clip_id", "modality", "row", "values", "n", "clip_hash"]
META = "clip_id string, modality string, file string, shape array<long>, dtype string, sha256 string, config_hash string, clip_hash string"
#: Bytes of files that one task reads, and bytes of one Arrow batch.
PART_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
#: Tasks up to which ranges below PART_BYTES are made: a task costs more than some kilobytes do.
TASKS = 200
STAGING = "_staging"


def file_name(clip_id: str, modality: str | None) -> str:
    plain = lambda x: quote(x, safe="").replace(".", "%2E")
    return plain(clip_id) + (f".{plain(modality)}" if modality is not None else "") + ".npy"


def named(path: str) -> tuple[str, str | None]:
    """Clip and modality of a file; one without a modality in its name has none."""
    clip, dot, modality = path.rpartition("/")[2].removesuffix(".npy").rpartition(".")
    return (unquote(clip), unquote(modality)) if dot else (unquote(modality), None)


@dataclass
class Ranges(InputPartition):
    """Byte ranges of files: (path, size, begin, end)."""

    parts: list[tuple[str, int, int, int]]


def cut(files: list[tuple[str, int]], part_bytes: int) -> list[Ranges]:
    """Files (path, size) as tasks of about ``part_bytes``; a larger file becomes several. Where
    that makes over TASKS of them, each takes its share, up to PART_BYTES or what was asked."""
    part_bytes = max(part_bytes, min(PART_BYTES, -(-sum(size for _, size in files) // TASKS)))
    out: list[Ranges] = []
    held: list[tuple[str, int, int, int]] = []
    filled = 0
    for path, size in files:
        begin = 0
        while True:
            end = min(size, begin + part_bytes - filled)
            held.append((path, size, begin, end))
            filled += end - begin
            if filled >= part_bytes:
                out.append(Ranges(held))
                held, filled = [], 0
            begin = end
            if begin >= size:
                break
    return [*out, Ranges(held)] if held else out


class TensorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> DataSourceReader:
        return TensorReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if schema.names != WRITTEN:
            raise ValueError(f"tensors are written from the columns {WRITTEN}, not {schema.names}")
        return TensorWriter(dict(self.options), overwrite)


class TensorReader(DataSourceReader):
    """Options: path, part_bytes, modality (only files of one)."""

    def __init__(self, options: dict):
        self.path, self.modality = options["path"], options.get("modality")
        self.part_bytes = max(1, int(options.get("part_bytes", PART_BYTES)))

    def partitions(self) -> list[InputPartition]:
        store, root = store_of(self.path)
        latest: dict[str, tuple[str, int]] = {}
        for info in sorted(store.get_file_info(stores.FileSelector(root, recursive=True, allow_not_found=True)), key=lambda x: x.path):
            inside = info.path[len(root) :].split("/")
            if info.type == stores.FileType.File and info.path.endswith(".npy") and not any(x.startswith(("_", ".")) for x in inside):
                if self.modality is None or named(info.path)[1] == self.modality:
                    latest[info.base_name] = (info.path, info.size)
        return cut(list(latest.values()), self.part_bytes) or [Ranges([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        for path, size, begin, end in partition.parts:
            yield from rows_of_range(store, path, size, begin, end)


def _batch(path: str, first: int, values: np.ndarray, shape: list[int], problem: str | None = None) -> pa.RecordBatch:
    clip, modality = named(path)
    n, width = values.shape
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.reshape(-1)))
    if problem:
        n, lists = 1, pa.nulls(1, pa.list_(pa.float64()))
    shapes = pa.array([None if problem else shape] * n, pa.list_(pa.int64()))
    rows = pa.nulls(1, pa.int64()) if problem else pa.array(np.arange(first, first + n))
    arrays = [pa.array([clip] * n, pa.string()), pa.array([modality] * n, pa.string()), rows, lists, shapes, pa.array([problem] * n, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["clip_id", "modality", "row", "values", "shape", "problem"])


def rows_of_range(store: stores.FileSystem, path: str, size: int, begin: int, end: int) -> Iterator[pa.RecordBatch]:
    """The rows that begin in bytes begin..end of a file; its problem, if it has one, comes with
    the range of its first byte."""
    try:
        with store.open_input_file(path) as file:
            yield from _rows(file, path, size, begin, end)
    except (ValueError, OSError, EOFError, SyntaxError) as problem:
        if begin == 0:
            yield _batch(path, 0, np.zeros((0, 1)), [], f"{type(problem).__name__}: {problem}"[:200])


def _rows(file: pa.NativeFile, path: str, size: int, begin: int, end: int) -> Iterator[pa.RecordBatch]:
    version = np.lib.format.read_magic(file)
    if version not in ((1, 0), (2, 0)):
        raise ValueError(f"version {version} of the format")
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, dtype = read(file)
    if dtype.kind not in "fiub":
        raise ValueError(f"no numbers but {dtype}")
    data, n = file.tell(), shape[0] if shape else 1
    width = prod(shape[1:])
    row_bytes = width * dtype.itemsize
    if data + n * row_bytes > size:
        raise ValueError(f"cut off: {size} bytes of {data + n * row_bytes}")
    if by_column and len(shape) > 1 or not row_bytes:
        # Rows that do not lie together are read by the task of the first byte alone.
        if begin == 0 and n:
            flat = np.frombuffer(file.read_at(n * row_bytes, data), dtype)
            yield _batch(path, 0, flat.reshape(shape, order="F").reshape(n, width).astype(np.float64), list(shape))
        return
    place = lambda at: min(n, max(0, -(-(at - data) // row_bytes)))
    first, last = place(begin), n if end >= size else place(end)
    step = max(1, BATCH_BYTES // row_bytes)
    for a in range(first, last, step):
        b = min(last, a + step)
        flat = np.frombuffer(file.read_at((b - a) * row_bytes, data + a * row_bytes), dtype)
        yield _batch(path, a, flat.reshape(b - a, width).astype(np.float64), list(shape))


@dataclass
class Part(WriterCommitMessage):
    folder: str
    tensors: int


class TensorWriter(DataSourceArrowWriter):
    """Options: path, dtype (float64), tail (sizes of the axes after the first, as "17,4"),
    config_hash. Rows have to come by tensor and in order; ``n`` is a tensor's number of rows."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.dtype, self.config_hash = options.get("dtype", "float64"), options.get("config_hash")
        self.tail = [int(x) for x in options["tail"].split(",")] if options.get("tail") else None
        self.job = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = store_of(self.path)
        task = TaskContext.get()
        folder = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        out, lines = f"{root}/{STAGING}/{self.job}/{folder}", []
        tensor: _Tensor | None = None
        for batch in iterator:
            clips, modalities = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keys = list(zip(clips, modalities, strict=True))
            begins = [i for i, key in enumerate(keys) if i == 0 or key != keys[i - 1]]
            for begin, end in zip(begins, [*begins[1:], len(keys)], strict=True):
                if tensor is None or keys[begin] != tensor.key:
                    lines += [tensor.closed()] if tensor else []
                    if not lines and tensor is None:
                        store.create_dir(out, recursive=True)
                    tensor = _Tensor(store, out, keys[begin], batch.column(4)[begin].as_py(), batch.column(5)[begin].as_py(), self)
                tensor.add(batch.column(2)[begin:end], batch.column(3)[begin:end])
        lines += [tensor.closed()] if tensor else []
        if lines:
            with store.open_output_stream(f"{out}/meta.jsonl") as file:
                file.write("".join(json.dumps(x) + "\n" for x in lines).encode())
        return Part(folder, len(lines))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = store_of(self.path)
        staged = f"{root}/{STAGING}/{self.job}"
        kept = {m.folder for m in messages if m is not None and m.tensors}
        older = [x.path for x in store.get_file_info(stores.FileSelector(root, allow_not_found=True)) if x.type == stores.FileType.Directory and x.base_name != STAGING]
        if kept:
            # Attempts that lost against another of the same task, or failed, go.
            for info in store.get_file_info(stores.FileSelector(staged)):
                if info.base_name not in kept:
                    store.delete_dir(info.path)
            store.move(staged, f"{root}/{self.job}")
        for path in older if self.overwrite else []:
            store.delete_dir(path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = store_of(self.path)
        staged = f"{root}/{STAGING}/{self.job}"
        if store.get_file_info(staged).type == stores.FileType.Directory:
            store.delete_dir(staged)


class _Tensor:
    """One file that is being written."""

    def __init__(self, store: stores.FileSystem, folder: str, key: tuple[str, str], n: int, clip_hash: str | None, writer: TensorWriter):
        self.key, self.n, self.done, self.writer, self.clip_hash = key, n, 0, writer, clip_hash
        self.name = file_name(*key)
        self.file = store.open_output_stream(f"{folder}/{self.name}")
        self.digest, self.shape = hashlib.sha256(), None

    def add(self, rows: pa.Array, values: pa.ListArray) -> None:
        """Rows that lie together in a batch."""
        due = np.arange(self.done, self.done + len(rows))
        wrong = np.flatnonzero((rows.to_numpy(zero_copy_only=False) != due) | (due >= self.n))
        if len(wrong):
            raise ValueError(f"row {rows[int(wrong[0])].as_py()} of {self.key}: row {due[wrong[0]]} of {self.n} was to come")
        sizes, flat = values.value_lengths(), values.flatten()
        if self.shape is None:
            self.width = sizes[0].as_py() or 0
            tail = self.writer.tail or [self.width]
            if prod(tail) != self.width:
                raise ValueError(f"{self.key}: {self.width} values do not fill {tail}")
            self.shape = [self.n, *tail]
            np.lib.format.write_array_header_1_0(self.file, {"descr": np.dtype(self.writer.dtype).newbyteorder("<").str, "fortran_order": False, "shape": tuple(self.shape)})
        if values.null_count or flat.null_count or (sizes.to_numpy(zero_copy_only=False) != self.width).any():
            raise ValueError(f"rows {due[0]} to {due[-1]} of {self.key}: nulls, or not {self.width} values in each")
        data = flat.to_numpy(zero_copy_only=False).astype(np.dtype(self.writer.dtype).newbyteorder("<")).tobytes()
        self.digest.update(data)
        self.file.write(data)
        self.done += len(rows)

    def closed(self) -> dict:
        self.file.close()
        if self.done != self.n:
            raise ValueError(f"{self.key}: {self.done} rows of {self.n}")
        clip, modality = self.key
        known = {"config_hash": self.writer.config_hash, "clip_hash": self.clip_hash}
        return {"clip_id": clip, "modality": modality, "file": self.name, "shape": self.shape, "dtype": self.writer.dtype, "sha256": self.digest.hexdigest(), **known}


def registered(spark: SparkSession) -> SparkSession:
    """The session, which knows the format ``tensors`` afterwards."""
    spark.dataSource.register(TensorSource)
    return spark


def read_tensors(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """``(clip_id, modality, row, values, shape, problem)``; a folder that is not there has no rows."""
    return registered(spark).read.format("tensors").options(**options).load(path)


def write_tensors(rows: DataFrame, path: str, mode: str = "append", **options: object) -> None:
    """Writes ``(clip_id string, modality string, row, values array<double>)`` with rows numbered
    from 0 in each tensor, and ``clip_hash`` if there is one. A gap, a repeated row, a null or
    rows of different widths fail the job, and nothing of it is seen. No rows write nothing.
    A clip's tensor goes through one task as a stream, so its length costs no memory."""
    hashed = F.col("clip_hash") if "clip_hash" in rows.columns else F.lit(None)
    one = Window.partitionBy("clip_id", "modality")
    ready = rows.select("clip_id", "modality", F.col("row").cast("long").alias("row"), F.col("values").cast("array<double>").alias("values"), F.count("*").over(one).alias("n"), hashed.cast("string").alias("clip_hash"))
    registered(rows.sparkSession)
    ready.sortWithinPartitions("clip_id", "modality", "row").write.format("tensors").mode(mode).options(**options).save(path)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """The latest line of every tensor that was written; none where nothing was."""
    if not exists(spark, path):
        return spark.createDataFrame([], META)
    lines = spark.read.schema(META).option("recursiveFileLookup", True).option("pathGlobFilter", "meta.jsonl").json(path)
    columns = lines.columns
    latest = lines.withColumn("_from", F.col("_metadata.file_path")).groupBy("clip_id", "modality").agg(F.max_by(F.struct(*columns), "_from").alias("m"))
    return latest.select(*[f"m.{c}" for c in columns])


def to_compute(wanted: DataFrame, path: str, config_hash: str | None) -> DataFrame:
    """Rows of ``wanted (clip_id, modality, clip_hash, ...)`` whose tensor is not there, or was
    made of another clip or by another configuration. Null hashes equal each other."""
    meta = read_meta(wanted.sparkSession, path).filter(F.col("config_hash").eqNullSafe(F.lit(config_hash))).select(*[F.col(c).alias(f"_{c}") for c in ("clip_id", "modality", "clip_hash")])
    same = (F.col("clip_id") == F.col("_clip_id")) & (F.col("modality") == F.col("_modality")) & F.col("clip_hash").eqNullSafe(F.col("_clip_hash"))
    return wanted.join(meta, same, "left_anti")


def widths(meta: DataFrame) -> DataFrame:
    """``(modality, width)``: the last axis of a modality's tensors, of the first clip that has one."""
    return meta.filter(F.size("shape") > 0).groupBy("modality").agg(F.min_by(F.element_at("shape", -1), "clip_id").alias("width"))

"""Exact duplicates by content-defined chunk recipes.

Every text is cut where a rolling hash of its last 16 bytes hits a pattern, so equal texts
have equal cuts. A chunk is named by (hash, length); names that occur more than once are
verified: their bytes are shuffled, distinct per task first, and different bytes under one
name are told apart by a rank. A text then *is* its recipe, the ordered list of verified
names, and only recipes are grouped and joined. To verify names, a chunk moves once from
each task that holds it, if its name may occur elsewhere: a filter of bounded size tells,
which lets most through from some millions of repeated names on (then every chunk moves once
from each task; the result is the same).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipwright.llm.common import drop_rows, keyed, passes, residue_filter, stored, text_bytes

MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 256, 10, 4096
WINDOW = 16
_TABLE = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
_FACTOR = 0x2545F491


def cut_points(joined: np.ndarray) -> np.ndarray:
    """Positions after which a chunk may end: the hash of the 16 bytes up to there has
    ``MEAN_BITS`` leading zero bits."""
    rolled = _TABLE[joined]
    step = 1
    while step < WINDOW:
        after = rolled.copy()
        after[step:] += rolled[:-step] * np.uint32(pow(_FACTOR, step, 1 << 32))
        rolled, step = after, 2 * step
    return np.flatnonzero(rolled < np.uint32(1 << (32 - MEAN_BITS))) + 1


def _cuts(points: list[int], begin: int, end: int) -> list[int]:
    """Ends of the chunks of one text that lies at [begin, end) of the pass."""
    out, last = [], begin
    for p in points:
        while p - last > MAX_CHUNK:
            last += MAX_CHUNK
            out.append(last)
        if p - last >= MIN_CHUNK and p < end:
            out.append(p)
            last = p
    while end - last > MAX_CHUNK:
        last += MAX_CHUNK
        out.append(last)
    if end > last or end == begin:
        out.append(end)
    return out


def chunked(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(row number, its chunks in order) for each text; an empty text is one empty chunk."""
    sizes = [len(t) for t in texts]
    for a, b in passes(sizes):
        joined = b"".join(texts[a:b])
        points = cut_points(np.frombuffer(joined, np.uint8)) if joined else np.empty(0, np.int64)
        ends = np.cumsum(sizes[a:b])
        firsts = np.searchsorted(points, ends - sizes[a:b], "right").tolist()
        lasts = np.searchsorted(points, ends, "left").tolist()
        points = points.tolist()
        begin = 0
        for i, end in enumerate(ends.tolist()):
            pieces, last = [], begin
            for p in _cuts(points[firsts[i] : lasts[i]], begin, end):
                pieces.append(joined[last:p])
                last = p
            yield a + i, pieces
            begin = end


def _name(chunk: bytes, hash_bits: int) -> int:
    value = xxhash.xxh64_intdigest(chunk) >> (64 - hash_bits)
    return value - (1 << 64) if value >> 63 else value


def recipes(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """``(doc_id, text_sha256, recipe array<struct<h long, n int>>)`` of every row."""
    item = pa.struct([("h", pa.int64()), ("n", pa.int32())])

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            lists = [[{"h": _name(c, hash_bits), "n": len(c)} for c in pieces] for _, pieces in chunked(texts)]
            digests = [hashlib.sha256(t).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests), pa.array(lists, pa.list_(item))], ["doc_id", "text_sha256", "recipe"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, text_sha256 string, recipe array<struct<h: long, n: int>>")


def chunks(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """``(doc_id, text_sha256, seq, h, n, piece binary)``: the chunks themselves."""
    names = ["doc_id", "text_sha256", "seq", "h", "n", "piece"]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            held, size = [[] for _ in names], 0
            for row, pieces in chunked(texts):
                digest = hashlib.sha256(texts[row]).hexdigest()
                for seq, piece in enumerate(pieces):
                    for column, value in zip(held, (ids[row], digest, seq, _name(piece, hash_bits), len(piece), piece), strict=True):
                        column.append(value)
                    size += len(piece)
                if size > 8 << 20:
                    yield _chunk_batch(held, names)
                    held, size = [[] for _ in names], 0
            if held[0]:
                yield _chunk_batch(held, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, text_sha256 string, seq int, h long, n int, piece binary")


def _chunk_batch(held: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds, strict=True)], names)


def _ambiguous(docs: DataFrame, lists: DataFrame, hash_bits: int) -> DataFrame:
    """Names ``(h, n)`` under which different bytes occur."""
    named = lists.select(F.explode("recipe").alias("c")).select("c.h", "c.n")
    repeated = named.groupBy("h", "n").count().filter("count > 1").select("h", "n")
    pieces = residue_filter(chunks(docs, hash_bits).select("h", "n", "piece"), repeated, ["h", "n"])
    return pieces.groupBy("h", "n", "piece").count().groupBy("h", "n").agg(F.count("*").alias("k")).filter("k > 1").select("h", "n")


def exact_duplicates(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per input row.

    Texts are equal when their bytes are; null counts as empty. The largest ``doc_id`` of
    a group stays. Rows that repeat a ``doc_id`` with the same text are all marked alike.
    An empty table gives no rows; other columns are ignored. ``hash_bits`` below 64 makes
    chunk names collide on purpose (for tests); the result does not depend on it.
    """
    lists = stored(recipes(docs, hash_bits), "recipes")
    clashes = stored(_ambiguous(docs, lists, hash_bits), "chunk-clashes")
    if clashes.isEmpty():
        lists = lists.withColumn("ranks", F.lit(None).cast("array<int>"))
    else:
        rows = chunks(docs, hash_bits).join(clashes, ["h", "n"], "left_semi")
        order = Window.partitionBy("h", "n").orderBy("piece")
        told = rows.select("h", "n", "piece").distinct().withColumn("rank", F.row_number().over(order))
        by_row = rows.join(told, ["h", "n", "piece"]).groupBy("doc_id", "text_sha256")
        ranks = by_row.agg(F.array_sort(F.collect_set(F.struct("seq", "rank"))).getField("rank").alias("ranks"))
        lists = stored(lists.join(ranks, ["doc_id", "text_sha256"], "left"), "recipes-verified")
    lists = lists.withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))
    groups = lists.groupBy("recipe", "ranks").agg(F.max("doc_id").alias("last"), F.count("*").alias("size")).filter("size > 1")
    told = lists.join(groups, ["recipe", "ranks"], "left")
    keep = F.coalesce("last", "doc_id")
    return told.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).alias("group_size"), (F.col("doc_id") == keep).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay; columns as they are.

    Of the rows of one text exactly one stays: the one of the largest ``doc_id``. Null is
    less than any other; of rows that repeat doc_id and text any one stays.
    """
    rows = keyed(docs)
    found = exact_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).filter("group_size > 1")
    found = stored(found.select(F.col("doc_id").alias("_row"), F.col("keep_id").alias("group")), "exact-groups")
    found = found.join(rows.select("_row", F.col("doc_id").cast("long").alias("doc_id")), "_row")
    last = found.groupBy("group").agg(F.max(F.struct("doc_id", "_row")).alias("last")).select("last._row")
    return drop_rows(rows, found.join(last, "_row", "left_anti"))

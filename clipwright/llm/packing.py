"""Harmonic packing of token sequences.

A piece of length l belongs to class k = floor(C / l), its size lying in (C/(k+1), C/k],
and every bin of class k takes exactly k pieces, so workers fill bins of a class without
knowing of each other. Documents are cut so that pieces sit at the top of their class:
full capacities first, then the greatest C // k that fits, until what is left is within
1/128 of a class's top or shorter than ``SMALL``. Pieces of bins that stay incomplete, at
most k - 1 in each share of a class, are packed best-fit decreasing in bounded groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipwright.llm.common import passes, stored
from clipwright.llm.token_ids import default_path, encoder

CAPACITY = 2048
END_ID = 1
SMALL = 64
#: Pieces in a share of a class, that is, in one window (ten bins' worth at least), and
#: leftover pieces that are packed together.
SHARE, BINS, TAIL = 1_000, 10, 10_000


@cache
def remainder_pieces(n: int, capacity: int = CAPACITY) -> tuple[int, ...]:
    """Lengths that a remainder of n < capacity ids is cut into."""
    if n == 0:
        return ()
    k = capacity // n
    if n < SMALL or capacity // k - n <= n // 128:
        return (n,)
    top = capacity // (k + 1)
    return (top, *remainder_pieces(n - top, capacity))


def document_pieces(n: int, capacity: int = CAPACITY) -> list[int]:
    return [capacity] * (n // capacity) + list(remainder_pieces(n % capacity, capacity))


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of every text with an end id after it; null counts as empty.

    ``(doc_id, start, length, ids_crc32, doc_tokens)`` and, on demand, ``ids array<int>``.
    Each id lies in exactly one piece.
    """
    path = path or default_path()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    end = END_ID.to_bytes(4, "little")

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for a, b in passes(sizes):
                held: list[list] = [[] for _ in names]
                ids, ends = encoder(path).encode_column(texts.slice(a, b - a))
                flat, begin = ids.tobytes(), 0
                for doc_id, stop in zip(doc_ids[a:b], ends.tolist(), strict=True):
                    own = flat[4 * begin : 4 * stop] + end
                    start, n, begin = 0, stop - begin + 1, stop
                    for length in document_pieces(n, capacity):
                        part = own[4 * start : 4 * (start + length)]
                        row = [doc_id, start, length, zlib.crc32(part), n]
                        if with_ids:
                            row.append(memoryview(part).cast("I").tolist())
                        for column, value in zip(held, row, strict=True):
                            column.append(value)
                        start += length
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds, strict=True)], names)

    schema = PIECE + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, schema)


def _best_fit(group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Best-fit decreasing over a bounded group; bins of equal room are interchangeable."""
    group = group.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, opened = [], [], 0
    for length in group["length"].tolist():
        left = next((r for r in range(length, capacity) if room[r]), None)
        if left is None:
            number, left, opened = opened, capacity, opened + 1
        else:
            number = room[left].pop()
        bins.append(number)
        offsets.append(capacity - left)
        room[left - length].append(number)
    return group.assign(bin=bins, offset=offsets)


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` (gapless from 0 in each sequence) to pieces.

    ``parts`` is read several times and should be a stored table. An empty table gives no
    rows; repeated rows are packed like any other.
    """
    parts = parts.withColumn("k", F.floor(F.lit(capacity) / F.col("length")).cast("int"))
    # At most `capacity` classes, so this broadcast has a fixed bound.
    shares = parts.groupBy("k").agg(F.ceil(F.count("*") / F.greatest(F.lit(SHARE), F.col("k") * BINS)).alias("shares"))
    salted = parts.join(F.broadcast(shares), "k").withColumn("share", F.pmod(F.xxhash64("doc_id", "start"), F.col("shares")))
    share = Window.partitionBy("k", "share")
    ordered = share.orderBy("doc_id", "start", "ids_crc32")
    upto = ordered.rowsBetween(Window.unboundedPreceding, -1)
    ranked = salted.select("*", (F.row_number().over(ordered) - 1).alias("rank"), F.coalesce(F.sum("length").over(upto), F.lit(0)).alias("before"), F.count("*").over(share).alias("n"))
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") / F.col("k")))
    in_bin = Window.partitionBy("k", "share", "bin")
    placed = stored(ranked.withColumn("offset", F.col("before") - F.min("before").over(in_bin)), "packing")
    columns = [c for c in parts.columns if c != "k"]
    full = placed.filter((F.col("bin") + 1) * F.col("k") <= F.col("n"))
    number = F.shiftleft(F.col("k").cast("long"), 50) + F.shiftleft(F.col("share").cast("long"), 20) + F.col("bin")
    full = full.select(*columns, number.alias("sequence_id"), "offset")

    rest = placed.filter((F.col("bin") + 1) * F.col("k") > F.col("n")).select(*columns)
    groups = max(1, -(-rest.count() // TAIL))
    rest = rest.withColumn("share", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)))
    schema = f"{PIECE}, share long, bin long, offset long"
    tail = rest.select(*PIECE_COLUMNS, "share").groupBy("share").applyInPandas(lambda group: _best_fit(group, capacity), schema)
    tail = tail.select(*PIECE_COLUMNS, (F.shiftleft("share", 20) + F.col("bin")).alias("sequence_id"), "offset")
    return full.unionByName(tail)


PIECE_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, one row per piece."""
    return place(stored(pieces(docs, capacity, path), "pieces"), capacity).select(*PIECE_COLUMNS, "sequence_id", "offset")


def sequences(docs: DataFrame, placed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0, path: str | None = None) -> DataFrame:
    """``(sequence_id, n_ids, ids array<int>)``: the packed sequences themselves.

    A sequence is padded to the capacity unless its length is a power of two. Groups hold
    one sequence each, so at most ``capacity`` ids.
    """
    keys = ["doc_id", "start", "length", "ids_crc32"]
    ids = pieces(docs, capacity, path, with_ids=True).select(*keys, "ids").dropDuplicates(keys)
    rows = placed.join(ids, keys).groupBy("sequence_id")
    whole = rows.agg(F.flatten(F.array_sort(F.collect_list(F.struct("offset", "ids"))).getField("ids")).alias("ids"))
    n = F.size("ids")
    padded = F.when(F.bit_count(n) == 1, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(capacity) - n)))
    return whole.select("sequence_id", n.alias("n_ids"), padded.alias("ids"))

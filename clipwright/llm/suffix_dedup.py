"""Removal of repeated 100-byte strings by bucket-pointer refinement.

Positions are put into buckets by the Q = 50 bytes from them on, and buckets are refined by
the bucket identifiers at later offsets: those at p and p + 50 tell apart the 100 bytes at p,
those of a run's first and last 100 bytes, reused, whole runs of windows.

To keep shuffles small, not every position is dealt out. Of each 100-byte window, the
leftmost least 50-byte identifier is its anchor; equal windows have equal anchors at equal
offsets, so a bucket is an anchor's value. Neighbouring windows with one anchor form a
*run*, about one for 26 bytes.

1. Of equal texts, the first stands for all: the others lose every byte, if they have 100.
2. Runs are dealt out by bucket and sorted by refined value. Those alone in their bucket
   drop out; of those that agree in their value, all but the earliest are removed whole.
3. Where a bucket keeps several different runs, their bytes are dealt out by bucket and the
   refinement is repeated for each of their windows. Of those that agree, all but the
   earliest are removed. A bucket of over MANY such runs, or one seen to be frequent in a
   sample of texts, is dealt out window by window instead, so that no task gets it whole.

The sample steers where rows go and nothing else. Rows that a task already knows to be
later than an equal one take no part in a comparison, so a passage in a third of all
documents is one row for each batch of them. Equality is that of all identifiers that make
up a value, 128 bits at least. Texts are dealt out once, into a table in buckets of their
rows' numbers, with which all that follows is joined in place; long ones are taken in segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipwright.llm.common import bucketed, discard, passes, stored, tasks_of, text_bytes

LENGTH = 100
Q = 50
WINDOW = LENGTH - Q + 1
SEGMENT = 1 << 19
#: Bytes that one numpy pass takes; its arrays need some 80 times as much.
PASS = 1 << 20
#: `at` holds the position of the first window, the anchor's offset in it and the number of windows.
POSITION_SHIFT, OFFSET_SHIFT = 14, 7
#: Different runs of one bucket that are compared in one task; beyond, windows are dealt out.
MANY = 4096
#: Texts in the sample for frequent buckets, how often such a one stands in it, and their bound.
SAMPLED, FREQUENT, FREQUENT_BUCKETS = 4000, 8, 50_000
#: A null doc_id counts as the largest long, and its row's number has this bit set.
UNNAMED, LAST_ID = 62, (1 << 63) - 1

_RANDOM = np.random.default_rng(9)
_BYTES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_C1, _C2, _C3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        both.append(np.cumprod(out, dtype=np.uint64))
    return both[0], both[1]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _C1 + ((b << np.uint64(31)) | (b >> np.uint64(33))) * _C2
    x ^= x >> np.uint64(29)
    x *= _C3
    return x ^ (x >> np.uint64(32))


def gram_ids(data: np.ndarray) -> np.ndarray:
    """Identifier of the Q bytes from each position on: a rolling polynomial, mixed."""
    power, inverse = _powers(1 << max(16, int(len(data)).bit_length()))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
    grams = sums[Q:] - sums[:-Q]
    grams *= inverse[: len(grams)]
    grams *= _C3
    grams ^= grams >> np.uint64(32)
    return grams


def window_ids(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Identifiers of the 100-byte strings at the given positions, by doubling."""
    return _mixed(grams[at], grams[at + Q])


def runs(data: np.ndarray, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """(anchor value, run value, first window, anchor's offset in it, windows) of all runs,
    and the identifiers of the Q bytes from each position on.

    ``bounds``: the texts' places in ``data``; no window crosses them.
    """
    valid = np.zeros(len(data), bool)
    for a, b in bounds:
        valid[a : max(a, b - LENGTH + 1)] = True
    starts = np.flatnonzero(valid)
    if not len(starts):
        empty = np.empty(0, np.int64)
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty, empty.view(np.uint64)
    grams = gram_ids(data)
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    step = 1
    while 2 * step <= WINDOW:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if WINDOW > step:
        least = np.minimum(least[: step - WINDOW], least[WINDOW - step :])
    anchors = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero((anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    first = np.concatenate(([0], new))
    last = np.concatenate((new, [len(starts)])) - 1
    low, high, anchor = starts[first], starts[last], anchors[first]
    extent = ((anchor - low) * 128 + (high - low)).astype(np.uint64)
    value = _mixed(_mixed(window_ids(grams, low), window_ids(grams, high)), extent)
    return grams[anchor], value, low, anchor - low, high - low + 1, grams


def _units(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(row, offset, bytes): texts, long ones in segments that overlap by LENGTH - 1."""
    for row, text in enumerate(texts):
        for offset in range(0, max(1, len(text)), SEGMENT):
            if len(text) - offset >= LENGTH:
                yield row, offset, text[offset : offset + SEGMENT + LENGTH - 1]


class _Runs:
    """The runs of one pass, and the identifiers of the Q bytes from each position on."""

    def __init__(self, units: list[tuple[int, int, bytes]]):
        ends = np.cumsum([len(u[2]) for u in units])
        begins = ends - [len(u[2]) for u in units]
        data = np.frombuffer(b"".join(u[2] for u in units), np.uint8)
        self.g, self.v, self.low, offset, n, self.grams = runs(data, list(zip(begins.tolist(), ends.tolist(), strict=True)))
        unit = np.searchsorted(ends, self.low, "right")
        self.text = np.array([u[0] for u in units], np.int64)[unit]
        start = self.low + (np.array([u[1] for u in units], np.int64) - begins)[unit]
        self.at = (start << POSITION_SHIFT) | (offset << OFFSET_SHIFT) | n


def _runs_of(texts: list[bytes]) -> Iterator[_Runs]:
    units = list(_units(texts))
    for i, j in passes([len(u[2]) for u in units], PASS):
        yield _Runs(units[i:j])


def _later(ids: list[np.ndarray], place: list[np.ndarray]) -> np.ndarray:
    """Rows that stand behind another one of equal identifiers."""
    order = np.lexsort([*place[::-1], *ids[::-1]])
    same = np.ones(max(0, len(order) - 1), bool)
    for x in ids:
        same &= x[order][1:] == x[order][:-1]
    later = np.zeros(len(order), bool)
    later[order[1:]] = same
    return later


def _frequent(texts: DataFrame) -> np.ndarray:
    """Buckets that are frequent in a sample of the texts, sorted: FREQUENT_BUCKETS at most."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _runs_of(text_bytes(batch.column(0))):
                yield pa.RecordBatch.from_arrays([pa.array(r.g.view(np.int64))], ["g"])

    step = max(1, texts.count() // SAMPLED)
    found = texts.filter(F.pmod(F.xxhash64("row"), F.lit(step)) == 0).select("text").mapInArrow(each, "g long")
    counted = found.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "g").limit(FREQUENT_BUCKETS)
    return np.sort(np.array([r.g for r in counted.collect()], np.int64))


_FOUND = "g long, v long, frequent boolean, k long, row long, at long, known boolean"


def _runs_found(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """All runs of ``texts (k, row, text)``; ``known`` are those that stand behind an equal
    one of their batch."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)
    names = [f.split()[0] for f in _FOUND.split(", ")]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, row = (batch.column(i).to_numpy() for i in range(2))
            held = [(r.g, r.v, r.text, r.at) for r in _runs_of(text_bytes(batch.column(2)))]
            if not held:
                continue
            g, v, text, at = (np.concatenate(x) for x in zip(*held, strict=True))
            k, row = k[text], row[text]
            known = _later([g, v], [k, row, at])
            # Known ones are spread by their place; they are not compared with anything.
            g = np.where(known, _mixed(row.view(np.uint64), at.view(np.uint64)), g).view(np.int64)
            columns = [g, np.where(known, 0, v.view(np.int64)), np.isin(g, shared.value) & ~known, k, row, at, known]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return texts.select("k", "row", "text").mapInArrow(each, _FOUND)


def _judged(found: DataFrame) -> DataFrame:
    """``(g, row, k, at, later, apart)``: runs to be removed (later), and those whose bucket
    keeps others; ``apart`` tells that they are to be compared window by window.

    Rows go by bucket, those of frequent ones by bucket and value. A value in a third of all
    documents has a row for each batch of them.
    """
    place = F.struct("k", "row", "at")
    dealt = found.withColumn("salt", F.when(F.col("frequent"), F.col("v")).otherwise(F.lit(0))).repartition(tasks_of(found), "g", "frequent", "salt")
    bucket = Window.partitionBy("g", "frequent", "salt")
    value = Window.partitionBy("g", "frequent", "salt", "v")
    ranked = dealt.withColumn("first", F.min(place).over(value)).withColumn("several", F.min("v").over(bucket) < F.max("v").over(bucket)).withColumn("n", F.count("*").over(bucket))
    later = F.col("known") | (place > F.col("first"))
    kept = ranked.select("g", "row", "k", "at", later.alias("later"), (F.col("frequent") | (F.col("n") > MANY)).alias("apart"), "several")
    return kept.filter(F.col("later") | F.col("several") | F.col("apart")).drop("several")


_WINDOWS = "a long, b long, k long, row long, at long, bytes binary, known boolean"


def _contested(texts: DataFrame, judged: DataFrame) -> DataFrame:
    """What is compared anew: runs of a bucket with their bytes (a: the bucket, b: 0), and
    single windows (a, b: their identifiers). ``known`` windows stand behind one of their batch."""
    names = [f.split()[0] for f in _WINDOWS.split(", ")]
    mine = F.collect_list(F.struct("at", "g", "apart"))
    lists = judged.filter("not later").groupBy("row").agg(mine.alias("runs"))

    def batch_of(a: np.ndarray, b: np.ndarray, k: np.ndarray, row: np.ndarray, at: np.ndarray, data: pa.Array, known: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in (a, b, k, row, at)), data, pa.array(known)], names)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, row = (batch.column(i).to_numpy() for i in range(2))
            texts, lists = text_bytes(batch.column(2)), batch.column(3)
            for i, j in passes([len(t) for t in texts], 8 * PASS):
                data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
                own = lists.slice(i, j - i)
                values = own.flatten()
                at, g, apart = (values.field(c).to_numpy(zero_copy_only=False) for c in range(3))
                text = i + np.repeat(np.arange(j - i), np.diff(own.offsets.to_numpy()))
                sizes = np.array([len(t) for t in texts[i:j]], np.int64)
                start = (at >> POSITION_SHIFT) + (np.cumsum(sizes) - sizes)[text - i]
                size = (at & 127) + LENGTH - 1
                for chosen in (~apart, apart):
                    pick = np.flatnonzero(chosen)
                    for x in range(0, len(pick), 20_000):
                        part = pick[x : x + 20_000]
                        ends = np.cumsum(size[part])
                        taken = data[np.repeat(start[part] - (ends - size[part]), size[part]) + np.arange(ends[-1])]
                        owner_k, owner = k[text[part]], row[text[part]]
                        if chosen is not apart:
                            held = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(taken)])
                            yield batch_of(g[part], np.zeros(len(part), np.int64), owner_k, owner, at[part], held, np.zeros(len(part), bool))
                            continue
                        a, b, which, single = _windows(taken, ends - size[part], at[part])
                        which_k, which = owner_k[which], owner[which]
                        known = _later([a, b], [which_k, which, single])
                        a = np.where(known, _mixed(which.view(np.uint64), single.view(np.uint64)), a).view(np.int64)
                        yield batch_of(a, np.where(known, 0, b.view(np.int64)), which_k, which, single, pa.nulls(len(a), pa.binary()), known)

    taken = texts.join(lists.hint("shuffle_hash"), "row").select("k", "row", "text", "runs")
    return taken.mapInArrow(each, _WINDOWS)


def _windows(data: np.ndarray, begins: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both identifiers of each window of runs, whose bytes begin at ``begins`` in ``data``,
    the number of its run, and its own ``at``."""
    grams, n = gram_ids(data), at & 127
    which = np.repeat(np.arange(len(at)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    p = begins[which] + step
    single = (((at[which] >> POSITION_SHIFT) + step) << POSITION_SHIFT) | 1
    return grams[p], grams[p + Q], which, single


def _resolved(contested: DataFrame) -> DataFrame:
    """``(row, at)``: the windows that stand behind an equal one, neighbours as one run.

    Rows of one key come together in a task, in the order of their places. A key is a bucket
    of MANY runs at most, or a single window, of which there is a row for each batch."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            a, b = (held.column(c).to_numpy() for c in ("a", "b"))
            cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            if len(cuts):
                yield from judge(held.slice(0, int(cuts[-1])))
                held = held.slice(int(cuts[-1]))
        if held is not None:
            yield from judge(held)

    def judge(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b, row, at, known = (rows.column(c).to_numpy() for c in ("a", "b", "row", "at", "known"))
        bare = rows.column("bytes").is_null().to_numpy()
        again = np.zeros(len(a), bool)
        again[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        found = bare & (known | again)
        yield out(row[found], at[found])
        runs_at = np.flatnonzero(~bare)
        if not len(runs_at):
            return
        chunk = rows.filter(pa.array(~bare)).column("bytes").to_pylist()
        for i, j in _whole_keys(a[runs_at], 20_000):
            part = chunk[i:j]
            sizes = np.array([len(x) for x in part], np.int64)
            mine = runs_at[i:j]
            x, y, which, single = _windows(np.frombuffer(b"".join(part), np.uint8), np.cumsum(sizes) - sizes, at[mine])
            later = np.flatnonzero(_later([x, y], [np.arange(len(x))]))
            if len(later):
                new = np.flatnonzero((later[1:] != later[:-1] + 1) | (which[later[1:]] != which[later[:-1]])) + 1
                first = later[np.append(0, new)]
                count = np.diff(np.append(np.append(0, new), len(later)))
                yield out(row[mine][which[first]], single[first] - 1 + count)

    def out(row: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(at)], ["row", "at"])

    dealt = contested.repartition(tasks_of(contested), "a", "b").sortWithinPartitions("a", "b", "k", "row", "at")
    return dealt.mapInArrow(each, "row long, at long")


def _whole_keys(key: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` rows that end where a key ends."""
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    begin = 0
    while begin < len(key):
        end = int(ends[min(len(ends) - 1, np.searchsorted(ends, begin + size))])
        yield begin, end
        begin = end


def merged_spans(at: np.ndarray) -> list[tuple[int, int]]:
    """Maximal byte ranges that the packed runs cover."""
    if not len(at):
        return []
    low = at >> POSITION_SHIFT
    order = np.argsort(low, kind="stable")
    low, high = low[order], (low + (at & 127) + LENGTH - 1)[order]
    reach = np.maximum.accumulate(high)
    cut = np.flatnonzero(low[1:] > reach[:-1]) + 1
    return list(zip(low[np.concatenate(([0], cut))].tolist(), reach[np.concatenate((cut - 1, [len(low) - 1]))].tolist(), strict=True))


def _with_leaders(texts: DataFrame) -> DataFrame:
    """``(row, lead)``: the row that stands for a text of one document, null for a copy of a
    text that stands in an earlier document."""
    known = stored(texts.select("row", "k", F.sha2("text", 256).alias("digest")), "suffix-digests")
    first = known.groupBy("digest").agg(F.min(F.struct("k", "row")).alias("first"))
    same = (F.col("first.k") == F.col("k")) & (_unnamed("first.row") == _unnamed("row"))
    return stored(known.join(first, "digest").select("row", F.when(same, F.col("first.row")).alias("lead")), "suffix-leaders")


def _unnamed(row: str) -> Column:
    return F.col(row) >= (1 << UNNAMED)


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, one row per input row.

    A byte goes if some 100-byte string over it also starts earlier: in a smaller doc_id,
    or before in the same document. Strings are judged on the input; matches never cross
    documents; null counts as empty. Rows that repeat a doc_id with the same text count as
    one document; with another text, as documents of that doc_id in no promised order. A
    null doc_id stays null and counts as one doc_id, behind all others.
    ``with_text`` adds ``kept binary``, the bytes that stay. Extra columns are ignored.
    """
    doc_id = F.col("doc_id").cast("long")
    number = F.monotonically_increasing_id() + F.when(doc_id.isNull(), F.lit(1 << UNNAMED)).otherwise(F.lit(0))
    texts = docs.select(F.coalesce(doc_id, F.lit(LAST_ID)).alias("k"), number.alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    texts = bucketed(texts, "suffix_texts", "row")
    leaders = _with_leaders(texts)
    leading = texts.join(leaders.filter("row = lead").select("row").hint("shuffle_hash"), "row")
    judged = stored(_judged(_runs_found(leading, _frequent(texts))), "suffix-judged")
    removed = stored(_resolved(_contested(texts, judged)).unionByName(judged.filter("later").select("row", "at")), "suffix-removed")
    discard(judged)
    spans = removed.groupBy("row").agg(F.collect_list("at").alias("at"))
    # Copies, which may be most rows, are no part of the join.
    led = leaders.filter("lead is not null").join(spans.withColumnRenamed("row", "lead"), "lead", "left").select("row", F.lit(False).alias("copy"), "at")
    fate = led.unionByName(leaders.filter("lead is null").select("row", F.lit(True).alias("copy")), allowMissingColumns=True)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            k, row, copy = (batch.column(c).to_pylist() for c in ("k", "row", "copy"))
            lists = batch.column(4)
            for i, text in enumerate(text_bytes(batch.column(2))):
                at = lists[i].values
                if copy[i]:
                    spans = [(0, len(text))] if len(text) >= LENGTH else []
                else:
                    spans = merged_spans(at.to_numpy(zero_copy_only=False)) if at is not None else []
                kept, last = [], 0
                for a, b in spans:
                    kept.append(text[last:a])
                    last = b
                kept = b"".join([*kept, text[last:]])
                values = (None if row[i] >> UNNAMED else k[i], len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept)
                for column, value in zip(out, values, strict=False):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return texts.join(fate.hint("shuffle_hash"), "row").select("k", "row", "text", "copy", "at").mapInArrow(each, schema)

"""Per-clip ordered sequences: windows over (clip order by frame)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``i`` (from 0) and ``n`` (length of the sequence)."""
    w = Window.partitionBy(key)
    return rows.withColumn("i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count("*").over(w))


def kinematics(rows: DataFrame, key: str, order: list[str], value: str, conf: Column) -> DataFrame:
    """Adds velocity and acceleration, masked by the confidences they use, and the least
    confidence of three frames (0 before the third)."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = rows.withColumn("conf", conf)
    before = lambda c, k=1: F.lag(c, k).over(w)
    rows = rows.withColumn("velocity", F.coalesce((F.col(value) - before(value)) * F.col("conf") * before("conf"), F.lit(0.0)))
    third = F.row_number().over(w) >= 3
    accelerated = (F.col("velocity") - before("velocity")) * F.col("conf") * before("conf") * before("conf", 2)
    rows = rows.withColumn("acceleration", F.when(third, accelerated).otherwise(0.0))
    return rows.withColumn("gate", F.when(third, F.min("conf").over(w.rowsBetween(-2, 0))).otherwise(0.0))


def periodicity(rows: DataFrame, key: str, order: list[str], value: str, block: int = 4096) -> DataFrame:
    """``(key, n, periodicity)``: greatest autocorrelation over all lags 1..n/2-1 over that
    of lag 0, for sequences of four or more. Null values take part in no product.

    Sequences are cut into blocks, every two blocks that lags up to n/2-1 can connect are
    correlated in one task, and the sums of each lag are added up over them.
    """
    w = Window.partitionBy(key)
    seq = ordered(rows, key, order).filter("n >= 4").withColumn("d", F.col(value) - F.avg(value).over(w))
    cut = seq.groupBy(F.col(key).alias("_key"), "n", F.floor(F.col("i") / block).cast("int").alias("b"))
    blocks = cut.agg(F.array_sort(F.collect_list(F.struct("i", "d"))).getField("d").cast("array<double>").alias("d"))
    # Lag n/2-1 from the last row of a block reaches this many blocks on.
    reach = F.floor((F.floor(F.col("n") / 2) + block - 2) / block).cast("int")
    x = blocks.withColumn("step", F.explode(F.sequence(F.lit(0), reach))).withColumn("to", F.col("b") + F.col("step")).alias("x")
    y = blocks.alias("y")
    pairs = x.join(y, F.col("x._key").eqNullSafe(F.col("y._key")) & (F.col("to") == F.col("y.b")))
    pairs = pairs.select("x._key", "x.n", (F.col("step").cast("long") * block).alias("apart"), F.col("x.d").alias("early"), F.col("y.d").alias("late"))
    kind = next(f.dataType.simpleString() for f in pairs.schema if f.name == "_key")
    sums = pairs.mapInArrow(_lag_sums, f"_key {kind}, n long, first long, sums array<double>")
    lags = sums.select("_key", "n", "first", F.posexplode("sums").alias("j", "s")).withColumn("lag", F.col("first") + F.col("j"))
    lags = lags.filter("lag between 0 and floor(n / 2) - 1").groupBy("_key", "n", "lag").agg(F.sum("s").alias("s"))
    found = lags.groupBy("_key", "n").agg(F.max(F.when(F.col("lag") >= 1, F.col("s"))).alias("best"), F.max(F.when(F.col("lag") == 0, F.col("s"))).alias("l0"))
    return found.select(F.col("_key").alias(key), "n", F.coalesce(F.try_divide("best", "l0"), F.lit(0.0)).alias("periodicity"))


def _lag_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of two blocks by the distance of their rows; null where no two meet."""
    for batch in batches:
        first, sums = [], []
        for apart, early, late in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
            (a, on_a), (b, on_b) = ((x.values.fill_null(0.0).to_numpy(), x.values.is_valid().to_numpy(zero_copy_only=False)) for x in (early, late))
            first.append(apart - len(a) + 1)
            met = None if on_a.all() and on_b.all() else np.correlate(on_b.astype(float), on_a.astype(float), "full") < 0.5
            sums.append(pa.array(np.correlate(b, a, "full"), mask=met))
        ends = np.cumsum([0, *map(len, sums)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(sums) if sums else pa.array([], pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first, pa.int64()), lists], ["_key", "n", "first", "sums"])


def peak(rows: DataFrame, key: str, order: str, score: str) -> DataFrame:
    """The first row of the greatest score of each sequence."""
    w = Window.partitionBy(key).orderBy(F.desc(score), F.asc(order))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def peak_by(rows: DataFrame, key: str, order: str, score: str, method: str) -> DataFrame:
    """``(key, frame, score)`` of each sequence's peak, numbered from 0 in ``order``: by
    max_au_intensity the first of the greatest score, by middle the frame at n // 2 with a
    score of 0; attention_pool stands for middle. Any other method is an error."""
    if method not in ("max_au_intensity", "middle", "attention_pool"):
        raise ValueError(f"unknown method {method!r}")
    placed = ordered(rows, key, [F.col(order)])
    if method == "max_au_intensity":
        return peak(placed, key, "i", score).select(key, F.col("i").cast("int").alias("frame"), F.col(score).cast("double").alias("score"))
    return placed.filter(F.col("i") == F.floor(F.col("n") / 2)).select(key, F.col("i").cast("int").alias("frame"), F.lit(0.0).alias("score"))


def z_score(value: str, key: str) -> Column:
    """Population z-score within the sequence; 0 where the spread vanishes."""
    w = Window.partitionBy(key)
    spread = F.stddev_pop(value).over(w)
    return F.when(spread > 1e-8, (F.col(value) - F.avg(value).over(w)) / spread).otherwise(0.0)


def uniform_sample(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """n rows of each sequence at evenly spaced places (floor); a shorter one repeats its
    last row. Adds ``slot`` 0..n-1."""
    seq = ordered(rows, key, order)
    even = F.floor(F.col("slot") * (F.col("n") - 1) / F.lit(max(1, n - 1))) if n > 1 else F.lit(0)
    slots = seq.select(key, "n").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    wanted = slots.withColumn("i", F.when(F.col("n") < n, F.least("slot", F.col("n") - 1)).otherwise(even).cast("int")).drop("n")
    return wanted.join(seq, [key, "i"])


def segments(total: Column, length: float, low: float, high: float, head: float = 0.0, tail_cut: float = 0.0, most: int = 0) -> Column:
    """``array<struct<start, size>>``: full segments of what is left between ``head`` and
    ``tail_cut``, and the rest if its size is in [low, high]; the first ``most`` if it is not 0.
    Too short a recording has none."""
    made = _segments(F.greatest(F.lit(head), total - tail_cut) - head, length, low, high)
    moved = F.transform(made, lambda x: F.struct((x["start"] + head).alias("start"), x["size"].alias("size")))
    return F.slice(moved, 1, most) if most else moved


def _segments(duration: Column, length: float, low: float, high: float) -> Column:
    full = F.floor(duration / length).cast("int")
    rest = duration - full * length
    whole = F.when(full > 0, F.transform(F.sequence(F.lit(0), F.greatest(full, F.lit(1)) - 1), lambda i: F.struct((i * length).alias("start"), F.lit(length).alias("size")))).otherwise(F.array().cast("array<struct<start: double, size: double>>"))
    tail = F.when((rest >= low) & (rest <= high), F.array(F.struct((full * length).cast("double").alias("start"), rest.alias("size")))).otherwise(F.array().cast("array<struct<start: double, size: double>>"))
    return F.concat(whole.cast("array<struct<start: double, size: double>>"), tail.cast("array<struct<start: double, size: double>>"))


def adaptive_pool(v: Column, n: int) -> Column:
    """Means of n buckets [floor(iT/n), ceil((i+1)T/n)) of an array."""
    size = F.size(v)

    def bucket(i: Column) -> Column:
        a = F.floor(i * size / F.lit(n)).cast("int")
        b = F.ceil((i + 1) * size / F.lit(n)).cast("int")
        return F.aggregate(F.slice(v, a + 1, b - a), F.lit(0.0), lambda s, x: s + x) / (b - a)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), bucket)


def linear_resample(v: Column, n: int, align_corners: bool) -> Column:
    """An array stretched to n values by linear interpolation."""
    size = F.size(v)

    def at(i: Column) -> Column:
        place = i * (size - 1) / F.lit(max(1, n - 1)) if align_corners else F.greatest((i + 0.5) * size / F.lit(n) - 0.5, F.lit(0.0))
        low = F.least(F.floor(place).cast("int"), size - 1)
        high = F.least(low + 1, size - 1)
        share = place - low
        return F.element_at(v, low + 1) * (1 - share) + F.element_at(v, high + 1) * share

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def thinned(rows: DataFrame, key: str, order: list[str], rate: Column, wanted: float) -> DataFrame:
    """Every max(1, round(rate / wanted))-th row of each sequence, numbered anew as ``frame``;
    rounding is half to even."""
    step = F.greatest(F.bround(rate / wanted, 0), F.lit(1.0)).cast("int")
    seq = ordered(rows, key, order).withColumn("_step", step)
    return seq.filter(F.col("i") % F.col("_step") == 0).withColumn("frame", (F.col("i") / F.col("_step")).cast("int")).drop("_step")


def early_stopping(epochs: DataFrame, run: str, epoch: str, metric: str, patience: int) -> DataFrame:
    """Adds ``improved`` (strictly better than all before), ``waited`` (epochs since) and
    ``stopped`` (the patience has run out)."""
    w = Window.partitionBy(run).orderBy(epoch)
    best = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = epochs.withColumn("improved", best.isNull() | (F.col(metric) > best)).withColumn("_i", F.row_number().over(w))
    last = F.max(F.when(F.col("improved"), F.col("_i"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("waited", F.col("_i") - last).withColumn("stopped", F.col("waited") >= patience).drop("_i")


def warmup_cosine(step: Column, warmup: int, total: int) -> Column:
    """Learning-rate factor: linear warm-up, then half a cosine."""
    progress = (step - warmup) / F.lit(max(1, total - warmup))
    return F.when(step < warmup, step / F.lit(max(1, warmup))).otherwise(F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.pi() * progress))))


def even_sample(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """min(n, length) evenly spaced rows of each sequence, ends included; adds ``slot``."""
    seq = ordered(rows, key, order)
    slots = seq.select(key, "n").distinct().withColumn("k", F.least(F.lit(n), F.col("n"))).withColumn("slot", F.explode(F.sequence(F.lit(0), (F.col("k") - 1).cast("int"))))
    place = F.when(F.col("k") > 1, F.floor(F.col("slot") * (F.col("n") - 1) / F.greatest(F.col("k") - 1, F.lit(1)))).otherwise(0)
    return slots.withColumn("i", place.cast("int")).drop("n", "k").join(seq, [key, "i"])


def valid_or_all(rows: DataFrame, key: str, valid: str, masked: str) -> DataFrame:
    """Rows that are valid; all rows of a sequence without a mask or without a valid row."""
    some = F.max(F.col(valid)).over(Window.partitionBy(key))
    return rows.withColumn("_some", some).filter(~F.col(masked) | F.col(valid) | ~F.col("_some")).drop("_some")

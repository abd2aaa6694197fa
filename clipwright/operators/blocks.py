"""Every row of one side against every row of another, in blocks.

Each side is dealt out by the hash of its id into blocks; a task gets one block of each and
multiplies them as matrices, tile by tile. What comes out is a row for each pair of blocks,
or for each row and block, never one for each pair of rows. A group of any size, even one
that holds most rows, becomes many blocks, so no task gets more than two of them. The
number of blocks is fixed until they hold ``BLOCK`` rows: up to there what is shuffled grows
with the rows and not with their pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a block holds at most, on average; a task holds two blocks of vectors.
BLOCK = 40_000
#: Blocks of a group, left and right, whose rows fit in so many; those of fewer than SMALL rows are not cut.
PARTS, SMALL = (8, 8), 250
#: Rows and columns of the products that are held at a time.
TILE = (256, 1024)
#: Close pairs that are measured directly at a time.
CLOSE = 1 << 14


def _sized(rows: DataFrame, block: int, parts: int) -> DataFrame:
    """``(by, n, blocks)``: the number of rows and blocks of each group."""
    n = F.count("*")
    return rows.groupBy("by").agg(n.alias("n"), F.greatest(F.ceil(n / block), F.least(F.lit(parts), F.ceil(n / SMALL))).cast("int").alias("blocks"))


def _dealt(rows: DataFrame, sizes: DataFrame, partners: DataFrame, own: str, other: str) -> DataFrame:
    """``rows`` once for each block of each partner group: ``left``, ``right`` name the groups,
    ``i``, ``j`` the blocks of the two sides."""
    placed = rows.join(sizes.select("by", "blocks"), "by").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    met = placed.join(partners.withColumnRenamed(own, "by"), "by")
    spread = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = {"left": ("own", "other"), "right": ("other", "own")}[own]
    return spread.select(F.col("by").alias(own), F.col(other), F.col(blocks[0]).alias("i"), F.col(blocks[1]).alias("j"), "id", "v")


def against(left: DataFrame, right: DataFrame, pairs: DataFrame | None, each: Callable[[tuple, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: str, block: int = BLOCK, parts: tuple[int, int] = PARTS, once: bool = False) -> DataFrame:
    """``each`` on every pair of blocks of ``left`` and ``right (by, id, v array<double>)``.

    ``pairs (left, right)`` names the groups ``by`` that meet; without it all do. ``each``
    gets the groups with the blocks' numbers, and ids and vectors of both sides; rows without
    a vector are left out. Groups are few (a class, a language), rows may be any number.
    ``once``: both sides are the same rows, and of two blocks only one order is formed.
    """
    sides = [side.select("by", "id", "v").filter(F.col("v").isNotNull()) for side in (left, right)]
    sizes = [_sized(side, block, n) for side, n in zip(sides, parts, strict=True)]
    named = [size.select(F.col("by").alias(name), F.col("blocks")) for size, name in zip(sizes, ("left", "right"), strict=True)]
    if pairs is None:
        # One row for each group of a side.
        pairs = named[0].select("left").join(F.broadcast(named[1].select("right")))
    keys, tasks = ["left", "right", "i", "j"], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = _dealt(sides[0], sizes[0], pairs.join(named[1], "right"), "left", "right")
    b = _dealt(sides[1], sizes[1], pairs.join(named[0], "left"), "right", "left")
    if once:
        a, b = (side.filter("left < right OR left = right AND i <= j") for side in (a, b))
    b = b.select(*[F.col(c).alias(f"{c}_") for c in b.columns])
    # A stated number of tasks is not coalesced: few bytes are much work here.
    a, b = a.repartition(tasks, *keys), b.repartition(tasks, *[f"{k}_" for k in keys])

    def one(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        x, y = _matrix(mine.column("v")), _matrix(theirs.column("v_"))
        return each(tuple(k.as_py() for k in key), mine.column("id").to_numpy(), x, theirs.column("id_").to_numpy(), y)

    return a.groupBy(*keys).cogroup(b.groupBy(*[f"{k}_" for k in keys])).applyInArrow(one, schema)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _tiles(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[slice, slice]]:
    for a in range(0, len(x), TILE[0]):
        for b in range(0, len(y), TILE[1]):
            yield slice(a, a + TILE[0]), slice(b, b + TILE[1])


def distance_sums(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the Euclidean distances of each row of ``x`` to all of ``y``, and the other way."""
    rows, columns = np.zeros(len(x)), np.zeros(len(y))
    if not len(x) or not len(y):
        return rows, columns
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    for a, b in _tiles(x, y):
        square = x[a] @ y[b].T
        square *= -2
        square += xx[a, None]
        square += yy[None, b]
        # Close rows lose digits in this form: they are measured directly.
        i, j = np.nonzero(square < 1e-6 * (xx[a].max() + yy[b].max()))
        for k in range(0, len(i), CLOSE):
            p, q = i[k : k + CLOSE], j[k : k + CLOSE]
            gap = x[a][p] - y[b][q]
            square[p, q] = (gap * gap).sum(axis=1)
        np.maximum(square, 0.0, out=square)
        np.sqrt(square, out=square)
        rows[a] += square.sum(axis=1)
        columns[b] += square.sum(axis=0)
    return rows, columns


def best_words(x: np.ndarray, y: np.ndarray, word: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row of x, word, s)`` of the ``k`` rows of ``y`` of the greatest product, rounded to
    ``digits``, with each row of ``x``; ties go to the lesser word, NaN comes last.

    Rows have length one or none. Words come in the order of their names, so a later one has
    to be greater than the k-th of those before: single precision tells which may be, and only
    those few are taken in double precision and sorted.
    """
    order = np.argsort(word, kind="stable")
    y, word, out = y[order], word[order], []
    # What single precision and rounding can be off by, for lengths up to one, with room.
    off, columns, fast = 2.0**-23 * (x.shape[1] + 8) + 10.0**-digits, y.T.astype(np.float32, order="C"), x.astype(np.float32)
    for begin in range(0, len(x), TILE[0]):
        part, quick = x[begin : begin + TILE[0]], fast[begin : begin + TILE[0]]
        row, at, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        floor, a, width = np.full(len(part), -np.inf), 0, max(64, k)
        while a < len(y):
            product = quick @ columns[:, a : a + width]
            if a == 0:
                product = np.where(np.isnan(product), np.float32(-2), product)
            over = np.flatnonzero((product > (floor - off).astype(np.float32)[:, None]).reshape(-1))
            i, j = np.divmod(over, product.shape[1])
            told = np.round(np.einsum("rc,rc->r", part[i], y[j + a]), digits)
            told[np.isnan(told)] = -2.0
            new = told > floor[i]
            row, at, s = np.concatenate([row, i[new]]), np.concatenate([at, j[new] + a]), np.concatenate([s, told[new]])
            best = np.lexsort((at, -s, row))
            place = np.arange(len(best)) - np.searchsorted(row[best], row[best])
            best = best[place < k]
            row, at, s = row[best], at[best], s[best]
            full = np.flatnonzero(np.bincount(row, minlength=len(part)) == k)
            floor[full] = s[np.searchsorted(row, full, "right") - 1]
            a, width = a + width, min(4 * width, 2 * TILE[1])
        out.append((row + begin, word[at], np.where(s == -2.0, np.nan, s)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of zeros stays."""
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def margin_excess(rows: DataFrame, pairs: DataFrame, margin: float, block: int = BLOCK) -> DataFrame:
    """``(left, right, n, loss)``: the mean of what the cosines between the vectors of two classes
    exceed ``margin`` by; pairs of which a class has no vector have no row."""

    def each(key: tuple, _: np.ndarray, x: np.ndarray, __: np.ndarray, y: np.ndarray) -> pa.Table:
        if not len(x) or not len(y):
            return pa.table({"left": [], "right": [], "n": [], "s": []}, schema=kinds)
        x, y = unit(x), unit(y)
        s = sum(float(np.maximum(x[a] @ y[b].T - margin, 0.0).sum()) for a, b in _tiles(x, y))
        return pa.table({"left": [key[0]], "right": [key[1]], "n": [len(x) * len(y)], "s": [s]}, schema=kinds)

    kinds = pa.schema([("left", pa.int64()), ("right", pa.int64()), ("n", pa.int64()), ("s", pa.float64())])
    long = lambda df, *names: df.withColumns({c: F.col(c).cast("long") for c in names})
    side = long(rows, "by")
    sums = against(side, side, long(pairs, "left", "right"), each, "left long, right long, n long, s double", block)
    return sums.groupBy("left", "right").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("loss"))


def silhouettes(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(by, id, silhouette)`` of Euclidean distances, for ``rows (by string, id long, v)``.

    ``(b - a) / max(a, b)`` with a the mean distance to the others of a row's own cluster and
    b the least mean distance to another cluster; 0 for a cluster of one, and without another.
    """

    def told(by: str, ids: np.ndarray, to: str, sums: np.ndarray, n: int) -> pa.Table:
        return pa.table({"by": [by] * len(ids), "id": ids, "to": [to] * len(ids), "s": sums, "n": [n] * len(ids)}, schema=kinds)

    def each(key: tuple, ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray) -> pa.Table:
        left, right, i, j = key
        there, back = distance_sums(x, y)
        out = [told(left, ids, right, there, len(y))]
        # A block with itself has both orders.
        return pa.concat_tables(out if (left, i) == (right, j) else [*out, told(right, others, left, back, len(x))])

    kinds = pa.schema([("by", pa.string()), ("id", pa.int64()), ("to", pa.string()), ("s", pa.float64()), ("n", pa.int64())])
    parts = against(rows, rows, None, each, "by string, id long, to string, s double, n long", block, once=True)
    means = parts.groupBy("by", "id", "to").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = F.col("by") == F.col("to")
    told = means.groupBy("by", "id").agg(
        F.max(F.when(own, F.col("n"))).alias("n"), F.max(F.when(own, F.try_divide(F.col("s"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"),
    )
    value = F.when((F.col("n") > 1) & F.col("b").isNotNull(), F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).otherwise(0.0)
    return told.select("by", "id", value.alias("silhouette"))


def nearest(queries: DataFrame, words: DataFrame, k: int, digits: int = 9, block: int = BLOCK) -> DataFrame:
    """``(id, rank, word, s)``: the ``k`` rows of ``words (id, v)`` of the greatest cosine with each
    of ``queries (id, v)``, over all of both; ties (at ``digits``) go to the lesser id.

    Each pair of blocks yields at most k rows for each query, and those are merged by query.
    A query or word of zeros has cosine 0.
    """

    def each(_: tuple, ids: np.ndarray, x: np.ndarray, word: np.ndarray, y: np.ndarray) -> pa.Table:
        if not len(x) or not len(y):
            return pa.table({"id": [], "word": [], "s": []}, schema=kinds)
        row, found, s = best_words(unit(x), unit(y), word, k, digits)
        return pa.table({"id": ids[row], "word": found, "s": s}, schema=kinds)

    kinds = pa.schema([("id", pa.int64()), ("word", pa.int64()), ("s", pa.float64())])
    one: Column = F.lit(0)
    side = lambda df: df.select(one.alias("by"), F.col("id").cast("long").alias("id"), "v")
    # Few blocks of words: each gives k rows for every query.
    parts = against(side(queries), side(words), None, each, "id long, word long, s double", block, (32, 2))
    # Only the k best of each block are held; their number grows with the blocks, not the words.
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("minus"), "word"))), 1, k)
    merged = parts.groupBy("id").agg(ranked.alias("best"))
    return merged.select("id", F.posexplode("best").alias("at", "b")).select("id", (F.col("at") + 1).alias("rank"), F.col("b.word").alias("word"), (-F.col("b.minus")).alias("s"))

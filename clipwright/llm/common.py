"""Helpers shared by the corpus operators: tables, durable intermediates, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipwright.sources.tables import discard, fresh_path, stored, table

__all__ = [
    "bucketed", "connected_components", "discard", "drop_rows", "flat_bytes", "in_blocks", "keyed", "merged_roots", "pairs", "passes", "residue_filter", "stored", "table", "tasks_of",
    "text_bytes", "whole_groups",
]

#: Bytes of text that one numpy pass takes at a time inside a Python task. Arrays of some megabytes
#: are cut from a heap that the worker keeps, so larger passes stay with it as idle memory.
PASS_BYTES = 1 << 20


def tasks_of(df: DataFrame) -> int:
    """The session's number of shuffle partitions: a stated number is not coalesced."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, tag: str, key: str) -> DataFrame:
    """Write ``df`` into the shared folder in buckets of ``key`` and read it back as a table:
    joins on ``key`` leave it where it is. The session's catalog lists it under ``tag``."""
    spark, tasks = df.sparkSession, tasks_of(df)
    path = fresh_path(spark, tag)
    name = path.rpartition("/")[2].replace("-", "_")
    df.repartition(tasks, key).write.bucketBy(tasks, key).format("parquet").option("path", path).saveAsTable(name)
    return spark.table(name)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key ``_row`` of each row, stored so that every use sees the same keys."""
    return stored(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


def drop_rows(rows: DataFrame, others: DataFrame) -> DataFrame:
    """A table of ``keyed`` without the rows of ``others (_row)`` and without the key."""
    return rows.join(others.select("_row"), "_row", "left_anti").drop("_row")


def passes(sizes: list[int], limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose summed sizes stay within ``limit`` (one larger row stands alone)."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > limit:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(data, offsets)``: the UTF-8 bytes of all texts of a column, one after the other, and
    where each begins (one offset more than texts). Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a long, b long)``.

    ``component`` is the smallest node reachable. Large-star and small-star rounds
    alternate: each hangs a node's neighbours on its least neighbour, so hubs cost one
    min-aggregate with map-side combining and one equi-join that adaptive execution can
    split. Every round is written to the shared folder. An empty table gives an empty
    result; self loops give the node itself.
    """
    tied = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = stored(tied.distinct(), "cc")
    mark = _mark(now)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        now = stored(_small_star(_large_star(now)), "cc")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.filter("node <> component").unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return both.join(least, "u").filter("v >= u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    # A root keeps its loop (u = v), so that lone nodes stay in the table.
    return hung.unionByName(own).distinct()


#: Residues that ``residue_filter`` can broadcast at most: 2**20 longs, some 20 MB hashed.
RESIDUES = 1 << 20


def residue_filter(rows: DataFrame, needed: DataFrame, keys: list[str], residues: int = RESIDUES) -> DataFrame:
    """Rows that may match ``needed`` on ``keys``, before anything is shuffled.

    What is broadcast are residues of the key's hash, of which there are ``residues`` at
    most whatever the size of ``needed``. Rows that pass by chance are for the caller's own
    exact join to drop; none that matches is lost.
    """
    residue = F.pmod(F.xxhash64(*keys), F.lit(residues))
    wanted = needed.select(residue.alias("_residue")).distinct()
    return rows.join(F.broadcast(wanted), residue == F.col("_residue"), "left_semi")


#: Pairs compared at once.
PAIRS = 100_000


def whole_groups(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches regrouped so that no group is cut: (rows, place of each row's group)."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        if len(held) == 0:
            continue
        group = _group_numbers(held, n_keys)
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield held.slice(0, cut), group[:cut]
            held = held.slice(cut).combine_chunks()
    if held is not None and len(held):
        yield held, _group_numbers(held, n_keys)


def _group_numbers(rows: pa.Table, n_keys: int) -> np.ndarray:
    new = np.zeros(len(rows), bool)
    for i in range(n_keys):
        key = rows.column(i).to_numpy()
        new[1:] |= key[1:] != key[:-1]
    return np.cumsum(new)


def pairs(group: np.ndarray, side: np.ndarray, cross: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows in one group; of a group of two blocks, pairs across them."""
    ends = np.searchsorted(group, group, "right")
    left = np.arange(len(group))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, step = 0, 1
    while True:
        left = left[left + step < ends[left]]
        if not len(left):
            break
        fits = ~cross[left] | (side[left] != side[left + step])
        held.append((left[fits], left[fits] + step))
        size += int(fits.sum())
        step += 1
        if size >= PAIRS:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def merged_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after joining rows i to rows j: the least row reachable."""
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def in_blocks(rows: DataFrame, bucket: list[str], key: str, block: int) -> DataFrame:
    """``rows`` with ``bi``, ``bj`` and ``own``: each bucket of over ``block`` rows is dealt
    out in blocks of about that size, each against each, so that no task gets it whole."""
    sizes = rows.groupBy(*bucket).count().filter(F.col("count") > block)
    blocks = F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int")
    dealt = rows.join(sizes, bucket, "left").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(*rows.columns, F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own")

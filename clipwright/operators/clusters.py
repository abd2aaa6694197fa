"""Density clusters of points in the plane, for groups of any size.

A key of few points is clustered within one task, by all its distances: one shuffle of the
points. Equal points of a larger key are counted first, and if it has few places they are
clustered the same way. The places of a key of many are dealt out over many tasks. They lie
in cells narrower than eps by more than the root of two, so those of one cell are all near
each other. A cell with enough points is dense: all are cores of one cluster, and none of
their pairs is formed. Only the few points of other cells meet their neighbours, in the five
by five cells about them: cells are joined by tiles of them, and a point goes to each tile
that these reach, mostly one or two. Whether two dense cells touch is told by the boxes of
their points: boxes that are wholly near link the cells, boxes that are wholly apart do not,
and the rest are cut in four and compared again, or point by point where they hold few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from clipwright.sources.tables import stored

#: Width of a cell in units of eps: below the root of one half, so that two cells reach past eps.
WIDTH = 0.7
#: Cuts of a cell's box; after so many halvings boxes are single points in double precision.
#: Pairs of points below which two parts are compared point by point.
DEPTH, PAIRS = 60, 10_000
#: Points of a key, or places of equal ones, that one task clusters by all their distances, 8 MB of them.
WHOLE = 1_000
#: Cells on the side of a tile.
TILE = 8


def least_reachable(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``(node, least)`` for every node of ``edges (a, b)``: the least node that links lead to.

    Each round hangs every node under the least that it or its neighbours hang under, and
    then shortens the way by one step; both are equi-joins and a minimum, so a node of many
    links is combined before it is shuffled.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")), "labels")
    for _ in range(rounds):
        seen = both.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("l").alias("m"))
        near = label.join(seen, "a").select("a", F.least("l", "m").alias("l"), F.col("l").alias("old"))
        onward = near.select(F.col("a").alias("l"), F.col("l").alias("further"))
        step = near.join(onward, "l", "left").select("a", F.least("l", F.coalesce("further", "l")).alias("l"), "old")
        label = stored(step, "labels")
        if label.filter("l <> old").isEmpty():
            return label.select(F.col("a").alias("node"), F.col("l").alias("least"))
        label = label.select("a", "l")
    raise RuntimeError("components did not settle; raise rounds")


def _around(cells: DataFrame, reach: int = 2) -> DataFrame:
    steps = F.array(*[F.lit(k) for k in range(-reach, reach + 1)])
    spread = cells.withColumn("_di", F.explode(steps)).withColumn("_dj", F.explode(steps))
    return spread.withColumns({"ni": F.col("i") + F.col("_di"), "nj": F.col("j") + F.col("_dj")}).drop("_di", "_dj")


def _gaps(a: str, b: str) -> tuple[Column, Column]:
    """Squared least and greatest distance between points of two boxes."""
    c = lambda side, name: F.col(f"{side}.{name}")
    apart = lambda lo, hi: F.greatest(F.lit(0.0), c(a, lo) - c(b, hi), c(b, lo) - c(a, hi))
    wide = lambda lo, hi: F.greatest(c(a, hi) - c(b, lo), c(b, hi) - c(a, lo))
    square = lambda x, y: x * x + y * y
    return square(apart("x0", "x1"), apart("y0", "y1")), square(wide("x0", "x1"), wide("y0", "y1"))


def _parted(points: DataFrame, depth: int, eps: float) -> DataFrame:
    """Points with the part ``(p, q)`` of their cell that ``depth`` halvings put them in."""
    n = float(2**depth)
    part = lambda c, k: F.floor((F.col(c) / (eps * WIDTH) - F.col(k)) * n)
    return points.select("node", "x", "y", part("x", "i").alias("p"), part("y", "j").alias("q"))


def _side(rows: DataFrame, side: str, depth: int) -> DataFrame:
    """The columns of one side of a pair, with the part that its part was cut from."""
    half = lambda c: F.floor(F.col(c) / 2) if depth else F.lit(0).cast("long")
    known = {"node": side, "p": f"{side}p", "q": f"{side}q"}
    return rows.select(*[F.col(c).alias(known.get(c, f"{side}{c}")) for c in rows.columns], half("p").alias(f"{side}p0"), half("q").alias(f"{side}q0"))


def _touching(dense: DataFrame, eps: float) -> DataFrame:
    """``(a, b)``: nodes of dense cells of which two points lie within ``eps``."""
    cells = dense.groupBy("key", "i", "j").agg(F.first("node").alias("node"))
    ahead = _around(cells).select("key", F.col("ni").alias("i"), F.col("nj").alias("j"), F.col("node").alias("a"))
    pairs = ahead.join(cells.withColumnRenamed("node", "b"), ["key", "i", "j"]).filter("a < b").select("a", "b")
    zero = F.lit(0).cast("long")
    undecided = stored(pairs.select("a", "b", *[zero.alias(f"{s}{c}") for s in ("a", "b") for c in ("p", "q")]), "cell-pairs")
    linked, limit = undecided.select("a", "b").limit(0), eps * eps
    for depth in range(DEPTH):
        if undecided.isEmpty():
            break
        nodes = undecided.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        parted = _parted(dense.join(nodes, "node", "left_semi"), depth, eps)
        box = F.struct(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
        boxes = parted.groupBy("node", "p", "q").agg(box.alias("box"), F.count("*").alias("n"))
        before = undecided.select("a", "b", *[F.col(f"{s}{c}").alias(f"{s}{c}0") for s in ("a", "b") for c in ("p", "q")])
        met = before.join(_side(boxes, "a", depth), ["a", "ap0", "aq0"]).join(_side(boxes, "b", depth), ["b", "bp0", "bq0"])
        least, most = _gaps("abox", "bbox")
        judged = met.filter(least <= limit).select("a", "b", "ap", "aq", "bp", "bq", (most <= limit).alias("near"), (F.col("an") * F.col("bn") <= PAIRS).alias("few"))
        judged = stored(judged, "cell-boxes")
        found = judged.filter("near").select("a", "b").distinct()
        # Parts of few points are compared point by point.
        few = judged.filter("few AND NOT near").join(found, ["a", "b"], "left_anti").select("a", "b", "ap", "aq", "bp", "bq")
        points = lambda s: parted.select(F.col("node").alias(s), F.col("p").alias(f"{s}p"), F.col("q").alias(f"{s}q"), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"))  # noqa: E731, B023
        both = few.join(points("a"), ["a", "ap", "aq"]).join(points("b"), ["b", "bp", "bq"])
        dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
        found = stored(found.unionByName(both.filter(dx * dx + dy * dy <= limit).select("a", "b")).distinct(), "cell-links")
        linked = linked.unionByName(found)
        undecided = judged.filter("NOT few").join(found, ["a", "b"], "left_anti")
    return linked


def _first_cores(x: np.ndarray, y: np.ndarray, n_equal: np.ndarray | None, eps: float, least: int) -> np.ndarray:
    """For each point of a key its cluster's first core, by position; -1 for noise."""
    n = len(x)
    dx, dy = x[:, None] - x, y[:, None] - y
    near = dx * dx + dy * dy <= eps * eps
    core = (near.sum(axis=1) if n_equal is None else near @ n_equal) >= least
    # A core hangs under the first that it or its neighbours hang under; n is none.
    label, before = np.where(core, np.arange(n), n), None
    while before is None or (label != before).any():
        before, reached = label, np.where(near, label, n).min(axis=1)
        step = np.append(np.where(core, reached, n), n)
        label = step[step[:-1]]
    return np.where(reached < n, reached, -1)


def _whole_keys(eps: float, least: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds ``cluster`` to points that are in order of key and id; ``n_equal`` is how many points one stands for."""

    def clustered(points: pa.Table, ends: np.ndarray) -> list[pa.RecordBatch]:
        x, y, first = points["x"].to_numpy(), points["y"].to_numpy(), np.full(len(points), -1)
        n_equal = points["n_equal"].to_numpy() if "n_equal" in points.column_names else None
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            if n_equal is not None or b - a >= least:
                own = _first_cores(x[a:b], y[a:b], None if n_equal is None else n_equal[a:b], eps, least)
                first[a:b] = np.where(own < 0, -1, own + a)
        cluster = points["id"].take(pa.array(first, mask=first < 0))
        return points.drop_columns(["x", "y"]).append_column("cluster", cluster).to_batches()

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, rows]).combine_chunks() if held else rows
            ends = pc.run_end_encode(held["key"].chunk(0)).run_ends.to_numpy()
            # The last key may go on in the next batch.
            if len(ends) > 1:
                yield from clustered(held.slice(0, ends[-2]), ends[:-1])
                held, ends = held.slice(ends[-2]), ends[-1:] - ends[-2]
        if held:
            yield from clustered(held, ends)

    return each


def density_clusters(points: DataFrame, eps: float, least: int, whole: int = WHOLE) -> DataFrame:
    """``(key, id, ..., cluster)`` for ``points (key, id long, x, y, ...)``; noise has a null cluster.

    A core has ``least`` points of its key within ``eps``, itself included; a cluster is named
    by its least core; a point at the border goes to the least cluster that reaches it. Ids
    are unique over all keys. Points without a key or a finite place are noise. Of a key
    of up to ``whole`` points, or places where they lie, one task compares all pairs; a larger
    one of any size, and any number of equal points, are dealt out over many tasks.
    """
    points = stored(points.withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")}), "points")
    placed = F.col("key").isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    noise = points.filter(~F.coalesce(placed, F.lit(False))).drop("x", "y").withColumn("cluster", F.lit(None).cast("long"))
    small, large = _parted_by_size(points.filter(placed), whole, "large-keys")
    found = _whole(small, eps, least).unionByName(noise)
    if large is None:
        return found
    labels = stored(_at_places(large, eps, least, whole), "place-clusters")
    return found.unionByName(large.join(labels, ["key", "x", "y"]).select(found.columns))


def _parted_by_size(points: DataFrame, whole: int, tag: str) -> tuple[DataFrame, DataFrame | None]:
    """The points of keys of up to ``whole`` rows, and of larger ones if there are any."""
    large = stored(points.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > whole).select("key"), tag)
    if large.isEmpty():
        return points, None
    return points.join(large, "key", "left_anti").select(points.columns), points.join(large, "key", "left_semi").select(points.columns)


def _whole(points: DataFrame, eps: float, least: int) -> DataFrame:
    """``density_clusters`` of keys that a task holds."""
    named = StructType([f for f in points.schema if f.name not in ("x", "y")] + [StructField("cluster", LongType())])
    return points.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_whole_keys(eps, least), named)


def _at_places(points: DataFrame, eps: float, least: int, whole: int) -> DataFrame:
    """``(key, x, y, cluster)``: equal points share their neighbours and with them their
    cluster, so each place counts once, by its least id and the number of its points."""
    places = stored(points.groupBy("key", "x", "y").agg(F.min("id").alias("id"), F.count("*").alias("n_equal")), "places")
    few, many = _parted_by_size(places, whole, "wide-keys")
    found = _whole(few.withColumns({"at_x": F.col("x"), "at_y": F.col("y")}), eps, least).select("key", F.col("at_x").alias("x"), F.col("at_y").alias("y"), "cluster")
    return found if many is None else found.unionByName(_dealt(many, eps, least))


def _dealt(places: DataFrame, eps: float, least: int) -> DataFrame:
    """``(key, x, y, cluster)`` for ``places (key, x, y, id, n_equal)`` of keys of any size."""
    width = eps * WIDTH
    placed = places.withColumns({"i": F.floor(F.col("x") / width), "j": F.floor(F.col("y") / width)})
    cells = placed.groupBy("key", "i", "j").agg(F.sum("n_equal").alias("n"), F.min("id").alias("first"))
    known = placed.join(cells, ["key", "i", "j"]).select("key", "i", "j", "id", "x", "y", "n_equal", F.when(F.col("n") >= least, F.col("first")).alias("node"))
    known = stored(known, "cells")
    dense = known.filter("node IS NOT NULL")

    tile = lambda c, by=0: F.floor((F.col(c) + by) / TILE)
    thin = known.filter("node IS NULL").select("key", F.col("id").alias("one"), F.col("x").alias("x1"), F.col("y").alias("y1"), "i", "j")
    for c in ("i", "j"):
        thin = thin.withColumn(c, F.explode(F.array_distinct(F.array(tile(c, -2), tile(c, 2)))))
    dx, dy = F.col("x") - F.col("x1"), F.col("y") - F.col("y1")
    # The few thin points of a tile are the side that a join holds; the others pass by.
    met = known.select("key", tile("i").alias("i"), tile("j").alias("j"), "id", "x", "y", "n_equal", "node").join(thin, ["key", "i", "j"])
    near = stored(met.filter(dx * dx + dy * dy <= eps * eps).select("one", "id", "n_equal", "node"), "near-points")
    cores = near.groupBy("one").agg(F.sum("n_equal").alias("n")).filter(F.col("n") >= least).select("one")
    other = cores.select(F.col("one").alias("id"), F.col("one").alias("own"))
    to_core = stored(near.join(other, "id", "left").select("one", F.coalesce("node", "own").alias("core")).filter("core IS NOT NULL").distinct(), "near-cores")
    edges = to_core.join(cores, "one", "left_semi").select(F.col("one").alias("a"), F.col("core").alias("b"))
    edges = edges.unionByName(dense.select(F.col("node").alias("a"), F.col("node").alias("b")).distinct()).unionByName(_touching(dense, eps))
    label = stored(least_reachable(edges), "clusters")
    # A component's least node is the first point of a cell or a core itself: its least core.
    inner = dense.select("key", "x", "y", "node").join(label, "node").select("key", "x", "y", F.col("least").alias("cluster"))
    reached = to_core.join(label.withColumnRenamed("node", "core"), "core").groupBy(F.col("one").alias("id")).agg(F.min("least").alias("cluster"))
    return inner.unionByName(known.filter("node IS NULL").join(reached, "id", "left").select("key", "x", "y", "cluster"))

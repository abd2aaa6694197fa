"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation of the principal components is learned (on a bounded sample) so that the signs
of the rotated vectors are balanced codes of least quantisation error; several such codes,
from different starts, are set side by side and cut into equal substrings, each the key of
one table. Substring length is the logarithm of the largest label's size, so buckets keep a
size that does not grow with the data; the number of tables is what pairs just at the
threshold need to be found with probability ``recall``, given how often their bits were
measured to differ.

Exact copies are one class with a weight from the start. In a bucket, rows whose whole
codes are close to some other row's stay; only those fetch their vectors, and cosines in
double precision decide. A bucket is dealt in blocks of ``BLOCK`` rows against each other,
so no task holds more than two blocks, and a block pair returns a row for each of its
vectors (links counted, one edge of a spanning forest), never its pairs. A pair that meets
in several tables counts in the first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipwright.llm.common import connected_components, merged_roots, pairs, stored, whole_groups

THRESHOLD = 0.93
RECALL = 0.97
#: Bounds of the sample that the rotations are learned on: vectors and bytes.
SAMPLE, SAMPLE_BYTES = 8192, 64 << 20
BLOCK = 256
#: Tables that are aimed at; substrings are shortened until so many reach the recall.
MOST_TABLES = 64
#: Bits of a substring: one int of the row.
MOST_BITS = 30
KEYS = ["label", "dim", "t", "chunk", "bi", "bj"]


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, safe from overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def thinned(sample: np.ndarray, threshold: float) -> np.ndarray:
    """The unit vectors without an earlier one as close as the threshold: a group of near
    copies counts once, and does not pull the centre to itself."""
    keep = np.ones(len(sample), bool)
    for i in range(0, len(sample), 512):
        near = sample[i : i + 512] @ sample[: i + 512].T >= threshold
        keep[i : i + 512] = ~np.tril(near, i - 1).any(axis=1)
    return sample[keep]


class Codes:
    """Rotations for one vector size, learned by iterative quantisation."""

    def __init__(self, sample: np.ndarray, threshold: float, rounds: int = 20, seed: int = 1):
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        self.principal = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :64]
        self.reduced, self.rounds, self.rng = centred @ self.principal, rounds, np.random.default_rng(seed)
        self.projection = self._rotation()
        # Pairs just at the threshold, to measure how often their bits differ.
        aside = self.rng.standard_normal(sample.shape)
        aside = unit(aside - (aside * sample).sum(axis=1, keepdims=True) * sample)
        other = threshold * sample + sqrt(1 - threshold * threshold) * aside
        self.differing = (self.signs(sample) != self.signs(other)).mean(axis=1)

    def _rotation(self) -> np.ndarray:
        width = self.principal.shape[1]
        rotation = np.linalg.qr(self.rng.standard_normal((width, width)))[0]
        for _ in range(self.rounds):
            u, _, v = np.linalg.svd(np.where(self.reduced @ rotation >= 0, 1.0, -1.0).T @ self.reduced)
            rotation = (u @ v).T
        return self.principal @ rotation

    def widen(self, n_bits: int) -> None:
        """Sets further codes beside the first until there are ``n_bits``."""
        while self.projection.shape[1] < n_bits:
            self.projection = np.concatenate([self.projection, self._rotation()], axis=1)
        self.projection = self.projection[:, :n_bits]

    def signs(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors - self.mean) @ self.projection >= 0


class _Projection:
    """What a task needs of ``Codes``."""

    def __init__(self, mean: np.ndarray, projection: np.ndarray):
        self.mean, self.projection = mean, projection

    signs = Codes.signs


def tables_needed(differing: np.ndarray, bits: int, recall: float) -> tuple[int, int]:
    """(bits, tables) that find the measured pairs at the threshold with probability
    ``recall``: substrings of ``bits`` or fewer, so that MOST_TABLES suffice. Shorter ones
    make buckets larger, which blocks bound; substrings of one bit need no more than the
    pairs' own bits to agree once, so some length always does, or there is none to find."""
    for b in range(bits, 0, -1):
        alike = (1 - differing) ** b
        for t in range(1, MOST_TABLES + 1):
            if (1 - (1 - alike) ** t).mean() >= recall:
                return b, t
    raise ValueError("no number of tables reaches the recall: codes of these vectors tell nothing")


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _codes(classes: DataFrame, models: dict[int, Codes], bits: int, tables: int) -> DataFrame:
    """``(rep, label, dim, mult, code binary, chunks array<int>)``."""
    names = ["rep", "label", "dim", "mult", "code", "chunks"]
    weights = 1 << np.arange(bits, dtype=np.int64)
    projected = {dim: _Projection(m.mean, m.projection) for dim, m in models.items()}

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                signs = projected[dim].signs(unit(_matrix(part.column(4))))
                packed = np.packbits(signs, axis=1)
                chunks = signs.reshape(len(part), tables, bits) @ weights
                columns = [part.column(i) for i in range(4)]
                columns += [pa.array([c.tobytes() for c in packed], pa.binary()), pa.array(chunks.tolist(), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = classes.select("rep", "label", "dim", "mult", "embedding")
    return rows.mapInArrow(each, "rep long, label long, dim int, mult long, code binary, chunks array<int>")


def _code_matrix(column: pa.ChunkedArray) -> np.ndarray:
    codes = column.to_pylist()
    return np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)


def _dealt(rows: DataFrame, order: list[str]) -> DataFrame:
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, *order)


def _active(codes: DataFrame, most: int) -> DataFrame:
    """``(label, dim, t, chunk, bi, bj, rep, mult, block, code)``: rows of block pairs that
    have another row at most ``most`` bits away."""
    listed = codes.select("rep", "label", "dim", "mult", "code", F.posexplode("chunks").alias("t", "chunk"))
    bucket = ["label", "dim", "t", "chunk"]
    sizes = listed.groupBy(*bucket).count().filter("count > 1")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    shared = listed.join(sizes, bucket).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    shared = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    shared = shared.select(*bucket, F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "rep", "mult", "block", "code")

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, len(KEYS)):
            code, side = _code_matrix(rows.column("code")), rows.column("block").to_numpy()
            cross = rows.column("bi").to_numpy() != rows.column("bj").to_numpy()
            keep = np.zeros(len(rows), bool)
            for i, j in pairs(group, side, cross):
                near = np.bitwise_count(code[i] ^ code[j]).sum(axis=1) <= most
                keep[i[near]] = True
                keep[j[near]] = True
            yield from rows.filter(pa.array(keep)).to_batches()

    return _dealt(shared, ["rep"]).mapInArrow(each, shared.schema)


def _judged(active: DataFrame, threshold: float, bits: int) -> DataFrame:
    """``(rep, root, links)`` for each row of each block pair with a link."""
    schema = "rep long, root long, links long"

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, len(KEYS)):
            rep, mult, side, t = (rows.column(c).to_numpy() for c in ("rep", "mult", "block", "t"))
            cross = rows.column("bi").to_numpy() != rows.column("bj").to_numpy()
            dims = rows.column("dim").to_numpy()
            bit = np.unpackbits(_code_matrix(rows.column("code")), axis=1)
            lists = rows.column("embedding").combine_chunks()
            vectors = np.zeros((len(rows), int(dims.max())))
            for dim in np.unique(dims):
                here = np.flatnonzero(dims == dim)
                vectors[here, :dim] = unit(_matrix(lists.take(pa.array(here))))
            links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
            for i, j in pairs(group, side, cross):
                linked = np.einsum("ij,ij->i", vectors[i], vectors[j]) >= threshold
                i, j = i[linked], j[linked]
                if not len(i):
                    continue
                differs = bit[i] != bit[j]
                earlier = np.zeros(len(i), bool)
                for s in range(int(t[i].max())):
                    earlier |= (s < t[i]) & ~differs[:, s * bits : (s + 1) * bits].any(axis=1)
                i, j = i[~earlier], j[~earlier]
                np.add.at(links, i, mult[j])
                np.add.at(links, j, mult[i])
                root = merged_roots(root, i, j)
            out = np.flatnonzero(links)
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(rep[out]), pa.array(rep[root[out]]), pa.array(links[out])], ["rep", "root", "links"])

    return active.mapInArrow(each, schema)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row.

    Vectors are compared if labels are equal and not null, sizes equal, and both are
    neither null nor zero and hold no null or non-finite component; others link with
    nothing. Links found have a cosine of at least ``threshold`` in double precision.
    Rows that repeat a ``vec_id`` are one node (their links add up). An empty table gives
    no rows; other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    usable = F.col("label").isNotNull() & _usable(F.col("embedding"))
    classes = rows.filter(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"))
    classes = stored(classes.withColumn("dim", F.size("embedding")), "vectors")
    sizes = classes.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("largest")).collect()
    models: dict[int, Codes] = {}
    for r in sizes:  # one model for each vector size that occurs
        some = classes.filter(F.col("dim") == r.dim).orderBy(F.xxhash64("rep"), "rep").limit(max(64, min(SAMPLE, SAMPLE_BYTES // (8 * r.dim))))
        sample = unit(np.array([x.embedding for x in some.select("embedding").toLocalIterator()], np.float64))
        models[r.dim] = Codes(thinned(sample, threshold), threshold)
    bits = max(8, min(MOST_BITS, round(log2(max([2, *(r.largest for r in sizes)])))))
    differing = np.concatenate([np.zeros(1), *(m.differing for m in models.values())])
    bits, tables = tables_needed(differing, bits, recall)
    for m in models.values():
        m.widen(bits * tables)
    mean, spread = differing.mean(), differing.std()
    most = ceil(bits * tables * (mean + 4 * max(spread, sqrt(mean * (1 - mean) / (bits * tables)))))
    active = stored(_active(_codes(classes, models, bits, tables), most), "vectors-active")
    with_vectors = active.join(classes.select("rep", "label", "dim", "embedding"), ["rep", "label", "dim"])
    with_vectors = with_vectors.select(*KEYS, "rep", "mult", "block", "code", "embedding")
    judged = stored(_judged(_dealt(with_vectors, ["rep"]), threshold, bits), "vectors-links")
    component = connected_components(judged.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = judged.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.join(links, "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    found = rows.withColumn("usable", usable).join(named.withColumn("usable", F.lit(True)), ["usable", "label", "embedding"], "left")
    component_id = F.coalesce("c", "vec_id")
    return found.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), (F.col("vec_id") == component_id).alias("kept"))

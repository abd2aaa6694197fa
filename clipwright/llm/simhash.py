"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two fingerprints at most four bits apart differ in at most
four of them, so they share at least four (byte position, byte value) entries: the
guaranteed minimum. An inverted list of a single entry holds 1/256 of a corpus, which makes
a plain tally quadratic, so a list here is that of three positions at once. Of any four
positions, three are those of one of twenty lists (``families``), so a pair that shares four
entries meets in one list at least. Where pairs meet, their shared positional bytes are
tallied; those that reach the minimum are kept, and the Hamming distance verifies them.
Lists hold N / 2**24 rows, and the index has 20 rows per distinct fingerprint at every size.

Lists of over BLOCK rows are dealt out in blocks against each other, and what comes back are
the edges of a forest for each, not the pairs: a family of near copies costs a row each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipwright.llm.common import connected_components, drop_rows, in_blocks, keyed, merged_roots, pairs, stored, tasks_of, text_bytes, whole_groups

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: Shingles whose 64 bits are counted at once.
COUNT_BLOCK = 1 << 16
#: Rows of a list that one task compares with each other.
BLOCK = 1024


def fingerprint(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text.

    ASCII letters are lowered and words split at ASCII white space (what ``bytes.lower``
    and ``bytes.split`` do); fewer words than a shingle make one shingle, no word gives 0.
    """
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: 1 - words].tolist() if words > 1 else starts.tolist(), ends[words - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(tokens) - words + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), COUNT_BLOCK):
        block = hashes[i : i + COUNT_BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, fp long)`` of every row; a null text counts as empty. Other columns are ignored."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words, seed) for t in text_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, fp long")


def families(least: int) -> list[tuple[int, ...]]:
    """Sets of ``least - 1`` byte positions such that any ``least`` positions hold one of them.

    For four: the positions are put into three classes; three of a class, and two of a class
    with one of the next, are the lists. Else all sets from the first seven positions."""
    if least < 2:
        return [()]
    if least != 4:
        return list(combinations(range(7), least - 1))
    place = [0, 0, 0, 1, 1, 1, 2, 2]

    def listed(three: tuple[int, ...]) -> bool:
        counts = [sum(place[p] == c for p in three) for c in range(3)]
        return max(counts) == 3 or any(counts[c] == 2 and counts[(c + 1) % 3] == 1 for c in range(3))

    return [g for g in combinations(range(8), 3) if listed(g)]


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges ``(a, b)`` that join the ``nodes (rep long, fp long)`` at most ``max_bits`` (0..7)
    bits apart into the components that all such pairs make. ``fp`` must be distinct."""
    least = 8 - max_bits
    masks = [sum(255 << (8 * p) for p in g) for g in families(least)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    lists = nodes.select("rep", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("g", "entry"))
    keys = ["g", "entry", "bi", "bj"]
    dealt = in_blocks(lists, ["g", "entry"], "rep", BLOCK).select(*keys, "own", "rep", "fp")

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, len(keys)):
            rep, fp, side = (rows.column(c).to_numpy() for c in ("rep", "fp", "own"))
            cross = rows.column("bi").to_numpy() != rows.column("bj").to_numpy()
            values = np.ascontiguousarray(fp).view(np.uint64)
            held, root = values.view(np.uint8).reshape(-1, 8), np.arange(len(rows))
            for i, j in pairs(group, side, cross):
                tally = (held[i] == held[j]).sum(axis=1) >= least
                i, j = i[tally], j[tally]
                near = np.bitwise_count(values[i] ^ values[j]) <= max_bits
                if near.any():
                    root = merged_roots(root, i[near], j[near])
            out = np.flatnonzero(root != np.arange(len(rows)))
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(rep[out]), pa.array(rep[root[out]])], ["a", "b"])

    return dealt.repartition(tasks_of(dealt), *keys).sortWithinPartitions(*keys).mapInArrow(each, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row.

    Equal fingerprints form one class, represented by its least ``doc_id``; classes are
    linked by ``links`` and joined into components named by the least ``doc_id`` reachable.
    Null, empty and white-space texts share fingerprint zero and are linked like any other.
    An empty table gives no rows; repeated ``doc_id`` values give repeated rows.
    """
    fps = stored(fingerprints(docs, words, seed), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = connected_components(links(nodes, max_bits))
    named = nodes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    named = stored(named, "simhash-classes")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_component(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` for each component; columns stay as they are.

    Rows are linked one by one, whatever their ``doc_id``. The row of the least doc_id of a
    component stays; null comes after any other, of rows that repeat it any one stays.
    """
    rows = keyed(docs)
    found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), words, max_bits)
    found = stored(found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("group")), "simhash-groups")
    found = found.join(rows.select("_row", F.col("doc_id").cast("long").alias("doc_id")), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row"))
    kept = found.groupBy("group").agg(first.alias("first")).select("first._row")
    return drop_rows(rows, found.join(kept, "_row", "left_anti"))

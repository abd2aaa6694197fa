"""Reproducible splits and resumable joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipwright.operators.running import running


def seeded(key: str, seed: int) -> Column:
    """A pseudo-random order that any engine can repeat."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def proportional(rows: DataFrame, order: list[Column], names: list[str], shares: list[float], *by: str) -> DataFrame:
    """Adds ``split``: boundaries prev + int(n * share) in the given (total) order, the last
    takes the rest. Places come from prefix sums over ranges, so a stratum, or all rows
    where there is no ``by``, may be of any size."""
    ranked = running(rows, list(by), order, {"place": F.lit(1)}).withColumnsRenamed({"place_before": "_i", "place_all": "_n"})
    split, edge = F.lit(names[-1]), F.lit(0)
    edges = []
    for share in shares[:-1]:
        edge = edge + F.floor(F.col("_n") * share)
        edges.append(edge)
    for name, edge in list(zip(names, edges, strict=False))[::-1]:
        split = F.when(F.col("_i") < edge, name).otherwise(split)
    return ranked.withColumn("split", split).drop("_i", "_n")


def todo(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(key), key, "left_anti")


def merge_cache(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full outer merge; new values win where they are not null."""
    columns = [c for c in old.columns if c != key]
    return old.alias("o").join(new.alias("n"), key, "full").select(key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in columns])


def pick_variant(variants: DataFrame, base: str, variant: str, seed: int) -> DataFrame:
    """One variant of each base, by the least seeded hash."""
    return variants.groupBy(base).agg(F.min_by(F.col(variant), F.struct(seeded(variant, seed), F.col(variant))).alias(variant))


def positional_zip(left: DataFrame, right: DataFrame, order_left: str, order_right: str, key: str, strict: bool = False) -> DataFrame:
    """Rows of equal rank within ``key``; unmatched rows stay with nulls. ``strict`` raises where
    the lists of a key differ in length."""
    number = lambda df, order: df.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    a, b = number(left, order_left).withColumn("_a", F.lit(1)), number(right, order_right).withColumn("_b", F.lit(1))
    both = a.join(b, [key, "position"], "full")
    if strict:
        told = F.concat(F.lit("lists of different length for "), F.col(key).cast("string"))
        both = both.withColumn("position", F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(told).cast("int")).otherwise(F.col("position")))
    return both.drop("_a", "_b")


def combined_folds(rows: DataFrame, key: str, labels: list[str], names: list[str], shares: list[float], seed: int) -> DataFrame:
    """Adds ``split``, balanced over several labels at once.

    Rows are dealt in turn, in the order of their label combination and then of their seeded
    hash, to k = round(1 / (1 - shares[0])) folds (two at least). So every combination, and
    every label, is spread evenly over the folds, but for one row each. The last fold is the
    rest, which is divided in proportion, in a seeded order; all others are ``names[0]``.
    Places come from prefix sums over ranges of rows. Null labels are a label.
    """
    order = [*[F.asc_nulls_first(c) for c in labels], seeded(key, seed), F.col(key)]
    folds = max(2, round(1 / (1 - shares[0])))
    placed = running(rows, [], order, {"place": F.lit(1)}).withColumn("_fold", F.col("place_before") % folds).drop("place_before", "place_all")
    rest = placed.filter(F.col("_fold") == folds - 1).drop("_fold")
    total = sum(shares[1:])
    divided = proportional(rest, [seeded(key, seed + 1), F.col(key)], names[1:], [s / total for s in shares[1:]])
    return placed.filter(F.col("_fold") < folds - 1).drop("_fold").withColumn("split", F.lit(names[0])).unionByName(divided)


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``place``, 0 and up in the order of ``key``, by prefix sums over ranges."""
    return running(rows, [], [F.col(key)], {"place": F.lit(1)}).withColumnRenamed("place_before", "place").drop("place_all")

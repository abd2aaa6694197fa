"""Prefix sums over an order of any length, without a window over a whole group.

Rows are dealt out by ranges of (group, order) and stored; each range adds up its rows on
its own, and the totals of the ranges before it, one row for each range and group, are
joined on. A group that fills many ranges is summed by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipwright.sources.tables import stored


def running(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each of ``sums``, ``<name>_before`` (the sum over all rows that stand before
    it in the group) and ``<name>_all``. Rows that tie in ``order`` stand in no promised
    order: make it total. An empty table stays one; null groups are a group."""
    ranges = rows.withColumns({f"_{n}": c for n, c in sums.items()}).repartitionByRange(*[F.col(c) for c in by], *order)
    dealt = stored(ranges.withColumn("_range", F.spark_partition_id()), "running")
    totals = dealt.groupBy(*by, "_range").agg(*[F.sum(f"_{n}").alias(f"_{n}_sum") for n in sums])
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_range").alias("_at"),
        *[F.coalesce(F.sum(f"_{n}_sum").over(earlier), F.lit(0)).alias(f"_{n}_offset") for n in sums],
        *[F.sum(f"_{n}_sum").over(group).alias(f"{n}_all") for n in sums],
    )
    same = F.col("_range") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({f"_{n}_local": F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)) for n in sums})
    both = local.join(offsets, same)
    added = {f"{n}_before": F.col(f"_{n}_local") + F.col(f"_{n}_offset") for n in sums}
    return both.select(*rows.columns, *[c.alias(n) for n, c in added.items()], *[f"{n}_all" for n in sums])

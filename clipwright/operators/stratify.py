"""Folds balanced over several labels at once, rarest label first.

Rows with the same labels can stand for each other, so folds are decided over the table of
label combinations: the label with the fewest rows left is dealt out, each of its
combinations to the folds that still want it most. The table is an aggregate with one row
for each combination that occurs; rows are then placed by one prefix sum over ranges.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipwright.operators.running import running
from clipwright.operators.splits import proportional, seeded

#: Combinations of labels that one plan takes.
MOST_COMBINATIONS = 1_000_000


def dealt(wanted: list[float], n: int, overall: list[float]) -> list[int]:
    """How many of ``n`` rows each fold gets if each row goes to the fold that wants most at that
    time; ties by what the folds want otherwise, then by number.

    The wants are levelled at once: all whole steps above the common level, and the rest to
    the folds that are left with the most.
    """
    order = sorted(range(len(wanted)), key=lambda f: -wanted[f])
    level, total = 0.0, 0.0
    for k, f in enumerate(order, 1):
        total += wanted[f]
        level = (total - n) / k
        if k == len(order) or wanted[order[k]] <= level:
            break
    given = [max(0, int((w - level) // 1)) for w in wanted]
    # Rounding of the level may overshoot by one.
    while sum(given) > n:
        last = min((f for f in range(len(wanted)) if given[f]), key=lambda f: wanted[f] - given[f])
        given[last] -= 1
    for _ in range(n - sum(given)):
        f = max(range(len(wanted)), key=lambda f: (round(wanted[f] - given[f], 9), round(overall[f] - given[f], 9), -f))
        given[f] += 1
    return given


def plan(combinations: pd.DataFrame, labels: list[str], shares: list[float]) -> list[list[int]]:
    """For each combination (labels, n) the number of its rows in each fold."""
    rows = [tuple(r) for r in combinations[labels].itertuples(index=False, name=None)]
    left = combinations["n"].tolist()
    holds: dict[tuple, list[int]] = {}
    for i, row in enumerate(rows):
        for pair in enumerate(row):
            holds.setdefault(pair, []).append(i)
    remaining = {pair: sum(left[i] for i in of) for pair, of in holds.items()}
    wants = {pair: [n * s for s in shares] for pair, n in remaining.items()}
    given: list[list[int]] = [[0] * len(shares) for _ in rows]
    while remaining:
        label = min(remaining, key=lambda p: (remaining[p], p[0], str(p[1])))
        # Combinations of which few are left come first: the others can make up for them.
        for i in sorted((i for i in holds[label] if left[i]), key=lambda i: (left[i], i)):
            # Of folds that want the label alike, those that want the other labels more come first.
            others = [sum(w) / len(rows[i]) for w in zip(*(wants[pair] for pair in enumerate(rows[i])), strict=True)]
            counts = dealt(wants[label], left[i], others)
            given[i] = [g + n for g, n in zip(given[i], counts, strict=True)]
            for pair in enumerate(rows[i]):
                wants[pair] = [w - n for w, n in zip(wants[pair], counts, strict=True)]
                if pair in remaining:
                    remaining[pair] -= left[i]
            left[i] = 0
        del remaining[label]
        for pair in [p for p, n in remaining.items() if n <= 0]:
            del remaining[pair]
    return given


def iterative_folds(rows: DataFrame, key: str, labels: list[str], shares: list[float], seed: int) -> DataFrame:
    """Adds ``fold`` (0 and up), with about ``shares`` of every label in each.

    Which rows of a combination go where follows from their seeded hash. Null labels are a
    label; an empty table stays one. More than ``MOST_COMBINATIONS`` combinations raise.
    """
    text = rows.withColumns({f"_l{k}": F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for k, c in enumerate(labels)})
    names = [f"_l{k}" for k in range(len(labels))]
    counts = text.groupBy(*names).agg(F.count("*").alias("n"))

    def each(table: pd.DataFrame) -> pd.DataFrame:
        if len(table) > MOST_COMBINATIONS:
            raise ValueError(f"{len(table)} combinations of labels, {MOST_COMBINATIONS} at most")
        table = table.sort_values(names, kind="stable").reset_index(drop=True)
        ends = [[sum(g[: f + 1]) for f in range(len(shares))] for g in plan(table, names, shares)]
        return table[names].assign(ends=ends)

    schema = ", ".join(f"{n} string" for n in names) + ", ends array<long>"
    # One group of one row for each combination, not of rows.
    planned = counts.groupBy().applyInPandas(each, schema)
    placed = running(text, names, [seeded(key, seed), F.col(key)], {"place": F.lit(1)})
    fold = F.size(F.filter("ends", lambda e: e <= F.col("place_before"))).cast("int")
    return placed.join(planned, names).select(*rows.columns, fold.alias("fold"))


def multilabel_split(rows: DataFrame, key: str, labels: list[str], names: list[str], shares: list[float], seed: int) -> DataFrame:
    """Adds ``split``: of k = round(1 / (1 - shares[0])) equal folds (two at least) the last is the
    rest, divided in proportion in a seeded order; all others are ``names[0]``."""
    k = max(2, round(1 / (1 - shares[0])))
    folds = iterative_folds(rows, key, labels, [1 / k] * k, seed)
    total = sum(shares[1:])
    rest = proportional(folds.filter(F.col("fold") == k - 1).drop("fold"), [seeded(key, seed + 1), F.col(key)], names[1:], [s / total for s in shares[1:]])
    return folds.filter(F.col("fold") < k - 1).drop("fold").withColumn("split", F.lit(names[0])).unionByName(rest)

"""The first fitting rows in an order, without reading the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipwright.sources.tables import stored

#: Rounds that a scan of everything would take if the range of the first were kept, and the
#: factor that ranges grow by.
PARTS, GROWTH = 64, 4


def first_fitting(rows: DataFrame, key: str, fits: Column | Callable[[DataFrame], DataFrame], n: int, *ties: str, parts: int = PARTS) -> DataFrame:
    """The first ``n`` rows that fit, in the order of ``key`` (a whole number) and ``ties``.

    The range of keys is taken in rounds that grow, each as a filter that reaches the scan,
    until ``n`` rows were found; ``fits`` is a condition, or costly work on the rows of a
    round. Equal to working on all rows, sorting and taking ``n``, whatever the rounds are.
    Rows without a key never fit; fewer than ``n`` are returned if there are no more.
    """
    work = fits if callable(fits) and not isinstance(fits, Column) else lambda part: part.filter(fits)
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if n <= 0 or low is None:
        return work(rows.limit(0)).limit(0)
    width, begin, found, held = max(1, -(-(high - low + 1) // parts)), low, None, 0
    while begin <= high and held < n:
        end = begin + width
        part = stored(work(rows.filter((F.col(key) >= begin) & (F.col(key) < end))).orderBy(key, *ties).limit(n - held), "fitting")
        found = part if found is None else found.unionByName(part)
        held += part.count()
        begin, width = end, width * GROWTH
    return found

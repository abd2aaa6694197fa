"""Vector arithmetic as higher-order functions, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often, and in whatever lambda, it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(v: Column) -> Column:
    return bound(F.array_max(v), lambda top: bound(F.transform(v, lambda x: F.exp(x - top)), _shares))


def _shares(parts: Column) -> Column:
    return bound(total(parts), lambda whole: F.transform(parts, lambda x: x / whole))


def masked_softmax(v: Column, present: Column) -> Column:
    """Missing entries get 0; if all are missing, none is masked."""
    kept = lambda top, none: F.zip_with(v, present, lambda x, p: F.when(p | none, F.exp(x - top)).otherwise(0.0))
    return bound(F.array_max(v), lambda top: bound(~F.exists(present, lambda x: x), lambda none: bound(kept(top, none), _shares)))


def argmax(v: Column) -> Column:
    """First index of the maximum, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def mean(v: Column) -> Column:
    return F.try_divide(total(v), F.size(v))


def block(v: Column, index: int, width: int) -> Column:
    return F.slice(v, index * width + 1, width)


def cross_entropy(logits: Column, target: Column) -> Column:
    return bound(F.array_max(logits), lambda top: F.log(total(F.transform(logits, lambda x: F.exp(x - top)))) + top) - F.element_at(logits, target + 1)


def focal(logits: Column, target: Column, gamma: float) -> Column:
    ce = cross_entropy(logits, target)
    return F.pow(1 - F.exp(-ce), F.lit(gamma)) * ce


def kl_divergence(teacher: Column, student: Column, temperature: float) -> Column:
    """KL of softened distributions, times the squared temperature."""
    p, q = (softmax(F.transform(x, lambda y: y / temperature)) for x in (teacher, student))
    apart = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * (F.log(x) - F.log(y))))
    return temperature**2 * bound(p, lambda a: bound(q, lambda b: apart(a, b)))


def smooth_l1(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return mean(F.transform(gaps, lambda d: F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5)))


def mix(a: Column, b: Column, share: float) -> Column:
    return F.zip_with(a, b, lambda x, y: share * x + (1 - share) * y)


def all_zero(v: Column) -> Column:
    return F.forall(v, lambda x: x == 0)


def zero_if(gone: Column, v: Column) -> Column:
    return F.when(gone, F.transform(v, lambda x: x * 0)).otherwise(v)


def weighted_focal(logits: Column, target: Column, gamma: float, weights: list[float]) -> Column:
    """Focal loss times the target's class weight; gamma 0 is weighted cross-entropy."""
    alpha = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), target + 1)
    return alpha * (focal(logits, target, gamma) if gamma else cross_entropy(logits, target))


def log_softmax(v: Column) -> Column:
    scale = lambda top: F.log(total(F.transform(v, lambda y: F.exp(y - top)))) + top
    return bound(bound(F.array_max(v), scale), lambda whole: F.transform(v, lambda x: x - whole))


def hierarchical(group: Column, easy: Column, hard: Column, easy_classes: list[int], hard_classes: list[int]) -> Column:
    """Log-probabilities of all classes from those of two groups and of the classes in each."""
    g, e, h = log_softmax(group), log_softmax(easy), log_softmax(hard)
    at = {c: F.get(g, F.lit(0)) + F.get(e, F.lit(i)) for i, c in enumerate(easy_classes)} | {c: F.get(g, F.lit(1)) + F.get(h, F.lit(i)) for i, c in enumerate(hard_classes)}
    return F.array(*[at[c] for c in sorted(at)])


def rows_of(v: Column, steps: int, width: int) -> Column:
    """A flat array as ``steps`` rows of ``width``."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda t: F.slice(v, t * width + 1, width))


def squeezed(batch: Column) -> Column:
    """The one element of an outer array of size one."""
    return F.when(F.size(batch) == 1, F.get(batch, F.lit(0)))


def padded(tokens: Column, steps: Column, width: int) -> Column:
    """Rows of zeros behind ``tokens`` up to ``steps`` rows."""
    empty = F.array_repeat(F.array_repeat(F.lit(0.0), width), F.greatest(steps - F.size(tokens), F.lit(0)).cast("int"))
    return F.concat(tokens, empty)


def pooled(tokens: Column, how: str, scores: Column | None = None) -> Column:
    """One row of several: mean, max, cls (the first), or attention by ``scores`` of the rows."""
    first = F.get(tokens, F.lit(0))
    if how == "cls":
        return first
    places = F.sequence(F.lit(0), F.size(first) - 1)
    if how == "max":
        return F.transform(places, lambda d: F.array_max(F.transform(tokens, lambda r: F.get(r, d))))
    if how == "mean":
        return F.transform(places, lambda d: mean(F.transform(tokens, lambda r: F.get(r, d))))
    if how == "attention":
        return bound(softmax(scores), lambda weights: F.transform(places, lambda d: total(F.zip_with(weights, tokens, lambda w, r: w * F.get(r, d)))))
    raise ValueError(f"unknown pooling {how!r}")


def grid_pool(v: Column, grid: int, high: int, wide: int) -> Column:
    """Means of a square grid's cells in ``high`` x ``wide`` buckets, row by row; a bucket spans
    floor(i * grid / n) to ceil((i + 1) * grid / n)."""
    span = lambda i, n: range(i * grid // n, -(-(i + 1) * grid // n))
    cells = lambda i, j: [r * grid + c for r in span(i, high) for c in span(j, wide)]
    at = lambda picked: sum((F.get(v, F.lit(k)) for k in picked[1:]), F.get(v, F.lit(picked[0]))) / len(picked)
    return F.array(*[at(cells(i, j)) for i in range(high) for j in range(wide)])


def time_masked(tokens: Column, start: Column, length: Column) -> Column:
    """Rows from ``start`` on, ``length`` of them, set to zero."""
    return F.transform(tokens, lambda r, t: F.when((t >= start) & (t < start + length), F.transform(r, lambda x: x * 0)).otherwise(r))

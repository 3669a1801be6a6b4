"""Expressions over dense arrays; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkgauge.functions.vocab import CLIP


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def log_sum_exp(a: Column) -> Column:
    return let(a, lambda z: let(F.array_max(z), lambda m: m + F.log(total(F.transform(z, lambda x: F.exp(x - m))))))


def softmax(a: Column) -> Column:
    return let(a, lambda z: let(F.array_max(z), lambda m: let(F.transform(z, lambda x: F.exp(x - m)), lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))))


def log_softmax(a: Column) -> Column:
    return let(a, lambda z: let(log_sum_exp(z), lambda n: F.transform(z, lambda x: x - n)))


def argmax(a: Column) -> Column:
    """First place of the greatest value, from 0."""
    return let(a, lambda z: F.array_position(z, F.array_max(z)) - 1).cast("int")


def argmin(a: Column) -> Column:
    return let(a, lambda z: F.array_position(z, F.array_min(z)) - 1).cast("int")


def loss_bits(p_true: Column, clip: float = CLIP) -> Column:
    return -F.log2(F.least(F.greatest(p_true, F.lit(clip)), F.lit(1.0)))


def cell_bits(y: Column, p: Column, clip: float = CLIP) -> Column:
    """Loss of one 0/1 cell."""
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1.0 - clip))
    return -(y * F.log2(q) + (1 - y) * F.log2(1 - q))


def multilabel_bits(y: Column, p: Column, clip: float = CLIP) -> Column:
    """Mean over the labels of a row."""
    return total(F.zip_with(y, p, lambda a, b: cell_bits(a, b, clip))) / F.size(p)


def true_gap(p: Column, truth: Column) -> Column:
    """The true class's probability less the greatest other; null for one class. ``truth`` counts from 0."""
    rest = F.filter(p, lambda x, i: i != truth)
    return F.when(F.size(p) > 1, F.element_at(p, truth + 1) - F.array_max(rest))


def top_margin(p: Column) -> Column:
    return let(F.sort_array(p, asc=False), lambda s: F.when(F.size(s) > 1, s[0] - s[1]))


def brier(p: Column, truth: Column) -> Column:
    """Summed over classes."""
    return total(F.transform(p, lambda x, i: F.pow(x - F.when(i == truth, 1.0).otherwise(0.0), F.lit(2.0))))


def over(p: Column, threshold: Column) -> Column:
    return F.transform(p, lambda x: (x >= threshold).cast("int"))


def entropy_bits(counts: Column) -> Column:
    """Of an array of supports; empty supports add nothing."""
    n = total(F.transform(counts, lambda x: x.cast("double")))
    return let(n, lambda t: -total(F.transform(F.filter(counts, lambda x: x > 0), lambda x: (x / t) * F.log2(x / t))))


def masked_mean(vectors: Column, keep: Column) -> Column:
    """Mean of the vectors whose flag is true; null if none is."""
    chosen = F.filter(vectors, lambda v, i: F.element_at(keep, i + 1).cast("boolean"))
    n = F.size(chosen)
    first = chosen[0]
    summed = F.aggregate(F.slice(chosen, 2, F.greatest(n - 1, F.lit(0))), F.transform(first, lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.when(n > 0, F.transform(summed, lambda x: x / n))


def unit_sums(p: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(total(p) - 1) <= tolerance

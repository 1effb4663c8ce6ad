"""Expressions on quantile vectors: one array of levels a row, never exploded to compute a score."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = tuple(round(i / 10, 1) for i in range(1, 10))


def level_array(levels) -> Column:
    return F.array(*(F.lit(float(x)) for x in levels))


def of_sorted(values: Column, levels) -> Column:
    """Quantiles of a sorted array, interpolated as percentile() does; null if it is empty.

    A loop over levels: written out, they make a method that the JVM doesn't compile.
    """
    def one(x: Column) -> Column:
        at = (F.size(values) - 1) * x
        low, high = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return F.when(F.size(values) > 0, F.transform(level_array(levels), one))


def repaired(q: Column) -> Column:
    """Sorted quantiles: no crossing.  Every forecast passes through here."""
    return F.array_sort(q)


def crossings(q: Column) -> Column:
    """Neighbours that are out of order."""
    return F.size(F.filter(F.sequence(F.lit(0), F.size(q) - 2), lambda i: F.get(q, i) > F.get(q, i + 1)))


def pinball(p: Column, y: Column, level: float) -> Column:
    """Quantile score of one level; null if either is null."""
    return (p - y) * (F.when(y < p, 1.0).otherwise(0.0) - F.lit(level))


def crps(q: Column, y: Column, levels) -> Column:
    """Twice the mean pinball loss; scalar terms, so it stays inside generated code."""
    return 2 * reduce(lambda a, b: a + b, (pinball(q[i], y, x) for i, x in enumerate(levels))) / len(levels)


def pit(q: Column, y: Column, levels) -> Column:
    """Level at ``y`` by linear interpolation between knots; 0 below the first knot, 1 above the last."""
    n = len(levels)
    value = F.when(y > q[n - 1], 1.0).when(y == q[n - 1], F.lit(float(levels[-1])))
    inside = value
    for i in range(n - 2, -1, -1):
        lo, hi = levels[i], levels[i + 1]
        share = F.when(q[i + 1] > q[i], (y - q[i]) / (q[i + 1] - q[i])).otherwise(0.0)
        inside = F.when((y >= q[i]) & (y < q[i + 1]), lo + (hi - lo) * share).otherwise(inside)
    return F.when(y < q[0], 0.0).otherwise(inside)


def complete(q: Column, y: Column) -> Column:
    """Rows that calibration and coverage use: a target and no missing level."""
    return y.isNotNull() & q.isNotNull() & F.forall(q, lambda x: x.isNotNull())


def normal_scores(levels) -> list[float]:
    return [NormalDist().inv_cdf(x) for x in levels]


def normal_quantiles(mu: Column, sigma: Column, levels) -> Column:
    return F.array(*(mu + sigma * F.lit(z) for z in normal_scores(levels)))

"""Arithmetic on classic histograms: JSON arrays of bounds and of counts per bucket."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def number_array(text: Column) -> Column:
    """A JSON array of numbers; ``NaN``, ``+Inf`` and ``-Inf`` may be strings. Null for anything else."""
    parsed = F.from_json(text, "array<string>")
    special = lambda x: F.when(x.isin("+Inf", "Inf"), _INF).when(x == "-Inf", -_INF).when(x == "NaN", float("nan"))
    numbers = F.transform(parsed, lambda x: F.coalesce(special(x), x.try_cast("double")))
    return F.when(~F.exists(numbers, lambda x: x.isNull()), numbers)


def valid(bounds: Column, counts: Column) -> Column:
    """One count more than bounds, and some bound."""
    return bounds.isNotNull() & counts.isNotNull() & (F.size(bounds) > 0) & (F.size(counts) == F.size(bounds) + 1)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def risen(first: Column, last: Column) -> Column:
    """What each bucket has gained, never less than nothing."""
    return F.zip_with(last, first, lambda x, y: F.greatest(x - y, F.lit(0.0)))


def running(counts: Column) -> Column:
    return F.transform(counts, lambda _, i: F.aggregate(F.slice(counts, 1, i + 1), F.lit(0.0), lambda acc, x: acc + x))


def quantile(phi: float, bounds: Column, counts: Column) -> Column:
    """The phi-quantile, linear within a bucket; the first begins at zero, the last is its lower bound.

    NaN phi gives NaN, below 0 -Inf, above 1 +Inf; no counts or malformed arrays give NaN.
    """
    if phi != phi:
        return F.lit(float("nan"))
    if phi < 0 or phi > 1:
        return F.lit(-_INF if phi < 0 else _INF)
    cumulative = running(counts)
    total = F.element_at(cumulative, -1)
    rank = F.lit(float(phi)) * total
    at = F.array_position(F.transform(cumulative, lambda c: c >= rank), True).cast("int")  # from 1
    upper = F.get(bounds, at - 1)
    lower = F.when(at == 1, F.lit(0.0)).otherwise(F.get(bounds, at - 2))
    before = F.when(at == 1, F.lit(0.0)).otherwise(F.get(cumulative, at - 2))
    inside = F.get(counts, at - 1)
    value = (
        F.when(at > F.size(bounds), F.element_at(bounds, -1))
        .when((at == 1) & (upper <= 0), upper)
        .when(inside <= 0, upper)
        .otherwise(lower + (upper - lower) * F.try_divide(rank - before, inside))
    )
    return F.when(valid(bounds, counts) & (total > 0), value).otherwise(F.lit(float("nan")))


def below(limit: float, bounds: Column, counts: Column) -> Column:
    """How many observations lie below a limit, linear within a bucket."""
    edges = F.concat(bounds, F.array(F.lit(_INF)))
    share = F.transform(
        counts,
        lambda c, i: F.when(F.lit(limit) >= F.get(edges, i), c)
        .when(F.lit(limit) <= F.when(i == 0, F.lit(0.0)).otherwise(F.get(edges, i - 1)), F.lit(0.0))
        .when(i >= F.size(bounds), F.lit(0.0))
        .otherwise(c * F.try_divide(F.lit(limit) - F.when(i == 0, F.lit(0.0)).otherwise(F.get(edges, i - 1)), F.get(edges, i) - F.when(i == 0, F.lit(0.0)).otherwise(F.get(edges, i - 1)))),
    )
    return F.aggregate(share, F.lit(0.0), lambda acc, x: acc + x)


def fraction(lower: float, upper: float, bounds: Column, counts: Column) -> Column:
    """The share of observations between two limits."""
    if lower != lower or upper != upper:
        return F.lit(float("nan"))
    if lower >= upper:
        return F.lit(0.0)
    total = F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(valid(bounds, counts) & (total > 0), (below(upper, bounds, counts) - below(lower, bounds, counts)) / total).otherwise(F.lit(float("nan")))

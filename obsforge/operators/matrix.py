"""A lazy matrix of series, and what query languages do with it.

Rows are (``bucket_ns``, label columns, ``value``). PromQL and LogQL differ in the labels that
tell their series apart and in those that they match on; the operations are the same.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import TooManyGroups, Unsupported
from ..functions.timeutil import steps

_INF = float("inf")


@dataclass(frozen=True)
class Matrix:
    frame: DataFrame
    labels: tuple[str, ...]

    def select(self, value: Column, *labels: str, where: Column | None = None) -> Matrix:
        keep = labels or self.labels
        frame = self.frame if where is None else self.frame.where(where)
        return Matrix(frame.select("bucket_ns", *keep, value.cast("double").alias("value")), tuple(keep))


def aggregate(op: str, x: Column, param: float | None = None) -> Column:
    """An aggregate of values by its PromQL or LogQL name."""
    simple = {
        "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "stddev": F.stddev_pop, "stdvar": F.var_pop,
        "group": lambda _: F.max(F.lit(1.0)), "present": lambda _: F.max(F.lit(1.0)),
    }
    if op == "quantile":
        return approximate_quantile(x, float(param))
    if op not in simple:
        raise Unsupported(f"aggregation {op}")
    return simple[op](x)


#: A quantile's rank is off by a share of 1 / ACCURACY at most; the state of a group is bounded by it.
ACCURACY = 100_000


def approximate_quantile(x: Column, phi: float) -> Column:
    """A value of the group whose rank is within n / ACCURACY of phi * n, from a sketch of bounded size."""
    return F.percentile_approx(x, F.lit(phi), F.lit(ACCURACY)).cast("double")


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null; the keys of the left side stay."""
    named = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] or [F.lit(True)]
    return a.join(named, on, how).drop(*[f"__{k}" for k in keys])


def exact_quantile(frame: DataFrame, keys: list[str], value: str, phi: float) -> DataFrame:
    """``keys`` and ``value``: the phi-quantile, linear between the two values next to its rank.

    A sketch tells two values that the rank lies between; of the rows, those below are counted and
    only those in between, some n / ACCURACY of a group, are put in order. Nulls do not count; groups of
    nothing else are null. The frame is read twice.
    """
    rows = frame.select(*keys, F.col(value).cast("double").alias("__v"))
    edge = lambda at: F.percentile_approx("__v", F.lit(at), F.lit(ACCURACY)).cast("double")
    margin = 2.0 / ACCURACY
    # A group so small that the margin is no more than a few rows is put in order as a whole.
    many = F.count("__v") > 4 * ACCURACY
    low, high = edge(max(phi - margin, 0.0)), edge(min(phi + margin, 1.0))
    bracket = rows.groupBy(*keys).agg(F.count("__v").alias("__n"), F.when(many & F.lit(phi > margin), low).otherwise(F.min("__v")).alias("__low"), F.when(many & F.lit(phi < 1 - margin), high).otherwise(F.max("__v")).alias("__high"))
    rank = F.lit(float(phi)) * (F.col("__n") - 1)
    bracket = bracket.withColumns({"__floor": F.floor(rank).cast("long"), "__part": rank - F.floor(rank)})
    placed = same_keys(rows, F.broadcast(bracket), keys).where("__v <= __high")
    inside = F.when(F.col("__v") >= F.col("__low"), F.col("__v"))  # null: below
    counted = placed.groupBy(*keys, inside.alias("__v"), "__floor", "__part", "__n").agg(F.count(F.lit(1)).alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ordered = counted.withColumn("__upto", upto).where((F.col("__upto") > F.col("__floor")) & F.col("__v").isNotNull())
    at = F.min(F.struct("__upto", "__v"))
    after = F.min(F.when(F.col("__upto") > F.col("__floor") + 1, F.struct("__upto", "__v")))
    found = ordered.groupBy(*keys, "__part").agg(at.alias("__a"), after.alias("__b"))
    low, high = F.col("__a.__v"), F.coalesce(F.col("__b.__v"), F.col("__a.__v"))
    found = found.select(*keys, F.when(F.col("__part") == 0, low).otherwise(low + (high - low) * F.col("__part")).alias(value))
    return same_keys(bracket.select(*keys), found, keys, "left").select(*keys, value)


def divided(a: Column, b: Column) -> Column:
    """Division as floating point does it: by zero gives an infinity of the dividend's sign, or NaN."""
    zero = F.when(a > 0, F.lit(_INF)).when(a < 0, F.lit(-_INF)).otherwise(F.lit(float("nan")))
    return F.when(b == 0, F.when(F.isnan(a), F.lit(float("nan"))).otherwise(zero)).otherwise(F.try_divide(a, b))


def arithmetic(op: str, a: Column, b: Column) -> Column:
    if op == "%":
        return F.when(b == 0, F.lit(float("nan"))).otherwise(F.try_mod(a, b))
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: divided(a, b), "^": lambda: F.pow(a, b)}[op]()


def compare(op: str, a: Column, b: Column) -> Column:
    """Comparison in which NaN is unlike everything."""
    numbers = ~F.isnan(a) & ~F.isnan(b)
    out = {"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]
    return (out & numbers) | (~numbers) if op == "!=" else out & numbers


COMPARE = {"==", "!=", ">", "<", ">=", "<="}


def fold(m: Matrix, op: str, labels: tuple[str, ...], param: float | None = None) -> Matrix:
    if op == "quantile":
        return Matrix(exact_quantile(m.frame, ["bucket_ns", *labels], "value", _phi(param)), labels) if 0 <= param <= 1 else Matrix(m.frame.groupBy("bucket_ns", *labels).agg(F.lit(_phi(param)).alias("value")), labels)
    return Matrix(m.frame.groupBy("bucket_ns", *labels).agg(aggregate(op, F.col("value"), param).cast("double").alias("value")), labels)


def _phi(param: float) -> float:
    """Quantiles below 0 and above 1 are infinite."""
    return param if 0 <= param <= 1 else -_INF if param < 0 else _INF if param > 1 else float("nan")


def top(m: Matrix, n: int, largest: bool, by: tuple[str, ...] = ()) -> Matrix:
    """The n largest or smallest series of each bucket; ties fall to the smaller labels."""
    v = F.col("value")
    rank = F.row_number().over(Window.partitionBy("bucket_ns", *by).orderBy(v.desc_nulls_last() if largest else v.asc_nulls_last(), *m.labels))
    return Matrix(m.frame.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank"), m.labels)


def with_scalar(m: Matrix, op: str, number: float, scalar_left: bool, as_bool: bool = False) -> Matrix:
    v, s = F.col("value"), F.lit(float(number))
    a, b = (s, v) if scalar_left else (v, s)
    if op in COMPARE:
        holds = compare(op, a, b)
        return m.select(holds.cast("double")) if as_bool else m.select(v, where=holds)
    return m.select(arithmetic(op, a, b))


def _one_each(m: Matrix, on: tuple[str, ...]) -> DataFrame:
    """One row for each match key: of several, that with the largest other labels."""
    others = [c for c in m.labels if c not in on]
    pick = F.max_by("value", F.struct(*others, "value")) if others else F.max("value")
    named = m.frame.withColumns({f"__{c}": F.col(c) for c in others})
    return named.groupBy("bucket_ns", *on).agg(pick.alias("__right"))


def matched(left: Matrix, right: Matrix, on: tuple[str, ...], op: str, as_bool: bool = False, keep_left: bool = False) -> Matrix:
    """Arithmetic or comparison of series that agree in ``on``; without a partner a series falls out."""
    other = _one_each(right, on)
    condition = [left.frame["bucket_ns"] == other["bucket_ns"], *[left.frame[c].eqNullSafe(other[c]) for c in on]]
    if keep_left or op in COMPARE and not as_bool:
        base, labels = left.frame, left.labels
    else:
        base, labels = _one_each(left, on).withColumnRenamed("__right", "value"), on
        condition = [base["bucket_ns"] == other["bucket_ns"], *[base[c].eqNullSafe(other[c]) for c in on]]
    joined = base.join(other, condition).select(base["bucket_ns"], *[base[c] for c in labels], base["value"], other["__right"])
    v, w = F.col("value"), F.col("__right")
    if op in COMPARE:
        out = joined.withColumn("value", compare(op, v, w).cast("double")) if as_bool else joined.where(compare(op, v, w))
    else:
        out = joined.withColumn("value", arithmetic(op, v, w))
    return Matrix(out.select("bucket_ns", *labels, "value"), labels)


def set_operation(left: Matrix, right: Matrix, on: tuple[str, ...], op: str) -> Matrix:
    def joined(a: Matrix, b: Matrix, how: str) -> DataFrame:
        keys = b.frame.select("bucket_ns", *on).distinct()
        return a.frame.join(keys, [a.frame["bucket_ns"] == keys["bucket_ns"], *[a.frame[c].eqNullSafe(keys[c]) for c in on]], how)

    if op == "and":
        return Matrix(joined(left, right, "left_semi"), left.labels)
    if op == "unless":
        return Matrix(joined(left, right, "left_anti"), left.labels)
    rest = joined(right, left, "left_anti")
    labels = (*left.labels, *[c for c in right.labels if c not in left.labels])
    return Matrix(left.frame.unionByName(rest, allowMissingColumns=True).select("bucket_ns", *labels, "value"), labels)


def by_series(m: Matrix, descending: bool) -> Matrix:
    """Series in order of their value in their latest bucket."""
    last = m.frame.groupBy(*m.labels).agg(F.max_by("value", "bucket_ns").alias("__last"))
    joined = same_keys(m.frame, last, list(m.labels))
    return Matrix(joined.orderBy(F.desc("__last") if descending else F.asc("__last"), *m.labels, "bucket_ns").drop("__last"), m.labels)


def constant(spark, value: float | Column, start: int, end: int, step: int, labels: dict[str, str]) -> Matrix:
    """A value at every step of the window."""
    frame = spark.range(1).select(F.explode(steps(start, end, step)).alias("bucket_ns"))
    out = value if isinstance(value, Column) else F.lit(float(value))
    return Matrix(frame.select("bucket_ns", *[F.lit(v).alias(k) for k, v in labels.items()], out.cast("double").alias("value")), tuple(labels))


def label_replace(m: Matrix, target: str, replacement: str, source: Column, regex: str) -> Matrix:
    """Where the whole source matches, the target label gets the replacement; an empty one takes it away."""
    java = replacement.replace("\\", "\\\\")
    new = F.regexp_replace(F.coalesce(source, F.lit("")), f"^(?:{regex})$", java)
    held = F.col(target) if target in m.labels else F.lit(None).cast("string")
    out = F.when(F.coalesce(source, F.lit("")).rlike(f"^(?:{regex})$"), F.nullif(new, F.lit(""))).otherwise(held)
    labels = m.labels if target in m.labels else (*m.labels, target)
    return Matrix(m.frame.withColumn(target, out).select("bucket_ns", *labels, "value"), labels)


def guard(m: Matrix, most: int = 100_000) -> Matrix:
    """For callers that collect: refuse a matrix of more series than they allow."""
    groups = m.frame.select(*m.labels).distinct().limit(most + 1).count()
    if groups > most:
        raise TooManyGroups(f"more than {most} series")
    return m


def series(m: Matrix) -> DataFrame:
    """A row for each series, its points in order of time."""
    return m.frame.groupBy(*m.labels).agg(F.array_sort(F.collect_list(F.struct("bucket_ns", "value"))).alias("points"))

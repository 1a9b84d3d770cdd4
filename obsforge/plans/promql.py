"""PromQL: a parser, and its lowering to lazy matrices.

Buckets are epoch-aligned steps; the range of a range vector sets the divisor of a rate alone.
Rates take the last sample less the first, without correction for counter resets. Binary operators
match on the service.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidInput, Unsupported
from ..functions import histogram
from ..functions.predicate import check_regex
from ..functions.timeutil import bucket, duration_ns, steps, within
from ..operators import matrix as mx
from ..operators import stats
from ..operators.matrix import COMPARE, Matrix
from ..sources.catalog import Catalog
from .ir import merged_histograms

MAP_COLUMNS = ("attributes", "resource_attributes")
AGGREGATES = {"sum", "avg", "min", "max", "count", "stddev", "stdvar", "group", "topk", "bottomk", "quantile", "count_values"}
RANGE = {"rate", "increase", "delta", "deriv", "irate", "idelta", "resets", "changes", "absent_over_time", "quantile_over_time"} | {f"{f}_over_time" for f in ("avg", "sum", "min", "max", "count", "last", "stddev", "stdvar", "present")}
LOOKBACK_NS = 300 * 10**9
INSTANT_NS = 3600 * 10**9
#: Slices of a bucket whose samples are put in order one by one.
SLICES = 64


@dataclass(frozen=True)
class Num:
    value: float


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Selector:
    matchers: tuple[tuple[str, str, str], ...]
    range_ns: int | None = None
    offset_ns: int = 0
    at_ns: int | None = None


@dataclass(frozen=True)
class Subquery:
    expr: object
    range_ns: int
    step_ns: int


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Aggregation:
    op: str
    expr: object
    param: object = None
    by: tuple[str, ...] | None = None
    without: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object
    as_bool: bool = False


_TOKEN = re.compile(
    r"""\s*(?:\#[^\n]*\n)?\s*(?:(?P<dur>\d+(?:\.\d+)?(?:ms|[smhdwy])(?:\d+(?:ms|[smhdwy]))*)|(?P<num>0x[0-9a-fA-F]+|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
    |(?P<id>(?:[A-Za-z_]|:(?=[A-Za-z_:]))[A-Za-z0-9_:]*)|(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`[^`]*`)|(?P<op>=~|!~|!=|==|<=|>=|[-+*/%^<>=(){}\[\],:@]))""",
    re.VERBOSE,
)
_PRECEDENCE = {"or": 1, "and": 2, "unless": 2, **dict.fromkeys(COMPARE, 3), "+": 4, "-": 4, "*": 5, "/": 5, "%": 5, "^": 6}


def unquote(s: str) -> str:
    if s[0] == "`":
        return s[1:-1]
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1] if m[1] in "\\\"'" else "\\" + m[1]), s[1:-1])


class Parser:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise InvalidInput(f"unexpected {text[at : at + 12]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if not got or want is not None and got != want:
            raise InvalidInput(f"expected {want or 'more'}, found {got or 'the end'!r}")
        self.at += 1
        return got

    def accept(self, want: str) -> bool:
        if self.peek() == want and self.kind() != "str":
            self.at += 1
            return True
        return False

    def parse(self):
        out = self.expr(0)
        if self.peek():
            raise InvalidInput(f"unexpected {self.peek()!r}")
        return out

    def expr(self, least: int):
        left = self.unary()
        while (op := self.peek()) in _PRECEDENCE and self.kind() in ("op", "id") and _PRECEDENCE[op] >= max(least, 1):
            self.take()
            as_bool = self.accept("bool")
            for word in ("on", "ignoring", "group_left", "group_right"):  # matching is on the service whatever they say
                if self.accept(word) and self.peek() == "(":
                    self.names()
            right = self.expr(_PRECEDENCE[op] + (op != "^"))
            left = Binary(op, left, right, as_bool)
        return left

    def unary(self):
        if self.accept("-"):
            inner = self.expr(_PRECEDENCE["^"])
            return Num(-inner.value) if isinstance(inner, Num) else Binary("*", Num(-1.0), inner)
        if self.accept("+"):
            return self.unary()
        return self.postfix(self.primary())

    def postfix(self, e):
        while True:
            if self.accept("["):
                span = duration_ns(self.take())
                if self.accept(":"):
                    step = 60 * 10**9 if self.peek() == "]" else duration_ns(self.take())
                    self.take("]")
                    e = Subquery(e, span, step)
                else:
                    self.take("]")
                    if not isinstance(e, Selector) or e.range_ns:
                        raise InvalidInput("a range goes with a selector")
                    e = replace(e, range_ns=span)
            elif self.accept("offset"):
                sign = -1 if self.accept("-") else 1
                if not isinstance(e, Selector):
                    raise Unsupported("offset of an expression")
                e = replace(e, offset_ns=sign * duration_ns(self.take()))
            elif self.accept("@"):
                if not isinstance(e, Selector) or self.kind() not in ("num", "op"):
                    raise Unsupported("@ takes a selector and seconds")
                sign = -1 if self.accept("-") else 1
                e = replace(e, at_ns=round(sign * float(self.take()) * 1e9))
            else:
                return e

    def names(self) -> tuple[str, ...]:
        self.take("(")
        out = []
        while not self.accept(")"):
            out.append(self.take())
            if not self.accept(","):
                self.take(")")
                break
        return tuple(out)

    def arguments(self) -> tuple:
        self.take("(")
        out = []
        while not self.accept(")"):
            out.append(self.expr(0))
            if not self.accept(","):
                self.take(")")
                break
        return tuple(out)

    def matchers(self) -> list[tuple[str, str, str]]:
        self.take("{")
        out = []
        while not self.accept("}"):
            name, op = self.take(), self.take()
            if op not in ("=", "!=", "=~", "!~") or self.kind() != "str":
                raise InvalidInput(f"not a matcher: {name}{op}")
            out.append((name, op, unquote(self.take())))
            if not self.accept(","):
                self.take("}")
                break
        return out

    def primary(self):
        kind, token = self.kind(), self.peek()
        if kind == "num":
            return Num(float(int(self.take(), 16)) if token.startswith("0x") else float(self.take()))
        if kind == "str":
            return Text(unquote(self.take()))
        if self.accept("("):
            inner = self.expr(0)
            self.take(")")
            return inner
        if token == "{":
            return self.selector([])
        if kind != "id":
            raise InvalidInput(f"unexpected {token or 'end'!r}")
        name = self.take()
        if name.lower() in ("inf", "nan") and self.peek() not in ("{", "("):
            return Num(float(name))
        if name in AGGREGATES and self.peek() in ("(", "by", "without"):
            return self.aggregation(name)
        if self.peek() == "(":
            return Call(name, self.arguments())
        return self.selector([("__name__", "=", name)])

    def selector(self, matchers: list[tuple[str, str, str]]) -> Selector:
        matchers = matchers + (self.matchers() if self.peek() == "{" else [])
        if not matchers:
            raise InvalidInput("a selector names something")
        return Selector(tuple(matchers))

    def aggregation(self, op: str) -> Aggregation:
        by = without = None

        def grouping() -> None:
            nonlocal by, without
            if self.accept("by"):
                by = self.names()
            elif self.accept("without"):
                without = self.names()

        grouping()
        args = self.arguments()
        if by is None and without is None:
            grouping()
        needs = op in ("topk", "bottomk", "quantile", "count_values")
        if len(args) != 1 + needs:
            raise InvalidInput(f"{op} takes {1 + needs} arguments")
        return Aggregation(op, args[-1], args[0] if needs else None, by, without)


def parse(text: str):
    return Parser(text).parse()


_MATH = {
    "abs": F.abs, "ceil": lambda v: F.ceil(v), "floor": lambda v: F.floor(v), "round": lambda v: F.floor(v + 0.5), "sqrt": F.sqrt, "exp": F.exp, "sgn": F.signum,
    "ln": lambda v: _log(v, F.ln), "log2": lambda v: _log(v, F.log2), "log10": lambda v: _log(v, F.log10),
}


def _log(v: Column, f) -> Column:
    return F.when(v == 0, F.lit(float("-inf"))).when(v < 0, F.lit(float("nan"))).otherwise(f(v))


def number_text(v: Column) -> Column:
    """A number as its shortest decimal text, never with an exponent; whole numbers without a point."""
    text = v.cast("string")
    plain = F.when(F.abs(v) >= 1e19, text.try_cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(text.try_cast("decimal(38,18)").cast("string"), "0+$", ""))
    spelled = F.when(F.isnan(v), "NaN").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf").when(text.contains("E"), F.coalesce(plain, text)).otherwise(text)
    return F.regexp_replace(spelled, r"\.0*$", "")


_CALENDAR = {
    "day_of_week": lambda t: F.dayofweek(t) - 1, "day_of_month": F.dayofmonth, "day_of_year": F.dayofyear, "days_in_month": lambda t: F.day(F.last_day(t)),
    "hour": F.hour, "minute": F.minute, "month": F.month, "year": F.year,
}
_SERVICE = {"service_name", "service", "job", "service.name"}


def matcher_column(frame: DataFrame, matchers, maps: tuple[str, ...] = MAP_COLUMNS) -> Column:
    """Label matchers as one condition.

    A label is a column of its own, a materialised one, or a key that any of the maps may hold:
    a positive matcher then asks if one does, a negative one that none does, so absent ones pass.
    Patterns are unanchored.
    """
    out = F.lit(True)
    for name, op, value in matchers:
        if op in ("=~", "!~"):
            check_regex(value)
        test = {"=": lambda c, v=value: c == v, "!=": lambda c, v=value: c != v, "=~": lambda c, v=value: c.rlike(v), "!~": lambda c, v=value: ~c.rlike(v)}[op]
        if name == "__name__":
            out &= test(F.col("metric_name"))
        elif name in _SERVICE:
            out &= test(F.col("service_name"))
        elif f"label_{name}" in frame.columns:
            c = F.col(f"label_{name}")
            out &= (c.isNull() | test(c)) if op.startswith("!") else test(c)
        else:
            held = F.lit(op.startswith("!"))
            for m in maps:
                if m in frame.columns:
                    v = F.col(m)[name]
                    held = held & (v.isNull() | test(v)) if op.startswith("!") else held | F.coalesce(test(v), F.lit(False))
            out &= held
    return out


@dataclass
class Evaluation:
    catalog: Catalog
    tenant: str
    dataset: str
    start: int
    end: int
    step: int
    spark: object
    labels: tuple[str, ...] = field(default=())

    def scan(self) -> DataFrame | None:
        return self.catalog.union(self.tenant, self.dataset, ("metrics_gauge", "metrics_sum"))

    # Samples of a selector: bucket, ns, labels, value.
    def samples(self, s: Selector) -> Matrix | None:
        frame = self.scan()
        if frame is None:
            return None
        at = F.col("timestamp_ns") + F.lit(s.offset_ns)
        labels = ("metric_name", "service_name", *sorted(c for c in frame.columns if c.startswith("label_")))
        rows = within(frame, "timestamp_ns", self.start - s.offset_ns, self.end - s.offset_ns).where(matcher_column(frame, s.matchers))
        return Matrix(rows.select(bucket(at, self.step).alias("bucket_ns"), at.alias("ns"), *labels, F.col("value").cast("double").alias("value")), labels)

    def empty(self) -> Matrix:
        labels = ("metric_name", "service_name")
        return Matrix(self.spark.createDataFrame([], "bucket_ns long, metric_name string, service_name string, value double"), labels)

    def group_labels(self, m: Matrix, a: Aggregation) -> tuple[str, ...]:
        """The metric's name is always a label of the groups that a reduction of samples makes."""

        def column(label: str) -> str:
            return "service_name" if label in _SERVICE else "metric_name" if label == "__name__" else f"label_{label}"

        natural = tuple(c for c in m.labels if c != "metric_name")
        if a.by is not None:
            if missing := [c for c in map(column, a.by) if c not in m.labels]:
                raise Unsupported(f"grouping by {missing[0]}")
            keep = tuple(dict.fromkeys(c for c in map(column, a.by) if c != "metric_name"))
        else:
            keep = () if a.without is None else tuple(c for c in natural if c not in {column(w) for w in a.without})
        return (("metric_name",) if "metric_name" in m.labels else ()) + keep

    def run(self, e) -> Matrix | float:
        if isinstance(e, Num):
            return e.value
        if isinstance(e, Text):
            raise InvalidInput("a string is not a query")
        if isinstance(e, Subquery) or isinstance(e, Selector) and e.range_ns:
            raise Unsupported("a range needs a function over it")
        if isinstance(e, Selector):
            return self.selector(e)
        if isinstance(e, Aggregation):
            return self.aggregation(e)
        if isinstance(e, Binary):
            return self.binary(e)
        return self.call(e)

    def selector(self, s: Selector) -> Matrix:
        if s.at_ns is not None:
            return self.pinned(s)
        m = self.samples(s)
        if m is None:
            return self.empty()
        return Matrix(m.frame.groupBy("bucket_ns", *m.labels).agg(F.max_by("value", F.struct("ns", "value")).alias("value")), m.labels)

    def pinned(self, s: Selector) -> Matrix:
        """The latest value at an instant, within five minutes, at every step."""
        inner = replace_window(self, s.at_ns - LOOKBACK_NS, s.at_ns)
        m = inner.samples(replace(s, at_ns=None))
        if m is None:
            return self.empty()
        last = m.frame.groupBy(*m.labels).agg(F.max_by("value", F.struct("ns", "value")).alias("value"))
        return Matrix(last.select(F.explode(steps(self.start, self.end, self.step)).alias("bucket_ns"), *m.labels, "value"), m.labels)

    def aggregation(self, a: Aggregation) -> Matrix:
        if a.op in ("topk", "bottomk"):
            if a.by is not None or a.without is not None:
                raise Unsupported(f"{a.op} with groups")
            return mx.top(self.matrix(a.expr), int(self.number(a.param)), a.op == "topk")
        if a.op == "count_values":
            m = self.matrix(a.expr)
            return Matrix(m.frame.groupBy("bucket_ns", number_text(F.col("value")).alias("service_name")).agg(F.count(F.lit(1)).cast("double").alias("value")), ("service_name",))
        param = self.number(a.param) if a.param is not None else None
        if isinstance(a.expr, Selector) and not a.expr.range_ns and a.expr.at_ns is None:
            m = self.samples(a.expr)  # an aggregate of a selector takes all samples of the step
            if m is None:
                return self.empty()
            return mx.fold(m, a.op, self.group_labels(m, a), param)
        m = self.matrix(a.expr)
        return mx.fold(m, a.op, self.group_labels(m, a), param)

    def number(self, e) -> float:
        out = self.run(e)
        if isinstance(out, Matrix):
            raise InvalidInput("a number is wanted")
        return out

    def matrix(self, e) -> Matrix:
        out = self.run(e)
        if not isinstance(out, Matrix):
            raise InvalidInput("a vector is wanted")
        return out

    def binary(self, b: Binary) -> Matrix | float:
        left, right = self.run(b.left), self.run(b.right)
        if b.op in ("and", "or", "unless"):
            if not isinstance(left, Matrix) or not isinstance(right, Matrix):
                raise InvalidInput(f"{b.op} takes two vectors")
            return mx.set_operation(left, right, ("service_name",), b.op)
        if not isinstance(left, Matrix) and not isinstance(right, Matrix):
            if b.op in COMPARE:
                return float({"==": left == right, "!=": left != right, ">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[b.op])
            try:
                return float({"+": lambda: left + right, "-": lambda: left - right, "*": lambda: left * right, "/": lambda: left / right, "%": lambda: left % right, "^": lambda: left**right}[b.op]())
            except ZeroDivisionError:
                return float("nan") if b.op == "%" or left == 0 else float("inf") if left > 0 else float("-inf")
        if isinstance(left, Matrix) and isinstance(right, Matrix):
            on = tuple(c for c in ("service_name",) if c in left.labels and c in right.labels)
            return mx.matched(left, right, on, b.op, b.as_bool)
        return mx.with_scalar(right, b.op, left, True, b.as_bool) if isinstance(right, Matrix) else mx.with_scalar(left, b.op, right, False, b.as_bool)

    def call(self, c: Call) -> Matrix | float:
        name, args = c.name, c.args
        if name in RANGE:
            return self.over_time(name, args)
        if name in _MATH and len(args) in (1, 2):
            if name == "round" and len(args) == 2:
                to = self.number(args[1])
                return self.matrix(args[0]).select(F.floor(F.col("value") / to + 0.5) * to)
            return self.matrix(args[0]).select(_MATH[name](F.col("value")))
        if name in ("clamp", "clamp_min", "clamp_max"):
            m, bounds = self.matrix(args[0]), [F.lit(self.number(a)) for a in args[1:]]
            v = F.col("value")
            low = bounds[0] if name in ("clamp", "clamp_min") else None
            high = bounds[-1] if name in ("clamp", "clamp_max") else None
            v = F.when(v < low, low).otherwise(v) if low is not None else v
            return m.select(F.when(v > high, high).otherwise(v) if high is not None else v)
        if name in ("sort", "sort_desc"):
            m, v = self.matrix(args[0]), F.col("value")
            return Matrix(m.frame.orderBy("bucket_ns", v.desc() if name == "sort_desc" else v.asc(), *m.labels), m.labels)
        if name in ("label_replace", "label_join"):
            return self.relabel(name, args)
        if name in ("vector", "time") or name in _CALENDAR and not args:
            seconds = F.col("bucket_ns") / F.lit(1e9)
            value = F.lit(self.number(args[0])) if name == "vector" else seconds
            m = mx.constant(self.spark, value, self.start, self.end, self.step, {"metric_name": "", "service_name": ""})
            return m if name in ("vector", "time") else m.select(_CALENDAR[name](F.timestamp_seconds(F.col("value"))))
        if name in _CALENDAR:
            return self.matrix(args[0]).select(_CALENDAR[name](F.timestamp_seconds(F.col("value"))))
        if name == "scalar":
            m = self.matrix(args[0])
            one = F.when(F.count(F.lit(1)) == 1, F.max("value")).otherwise(F.lit(float("nan")))
            return Matrix(m.frame.groupBy("bucket_ns").agg(one.alias("value")).select("bucket_ns", F.lit("").alias("metric_name"), F.lit("").alias("service_name"), "value"), ("metric_name", "service_name"))
        if name == "timestamp":
            m = self.samples(args[0]) if isinstance(args[0], Selector) else None
            if m is None:
                raise Unsupported("timestamp takes a selector")
            return Matrix(m.frame.groupBy("bucket_ns", *m.labels).agg((F.max("ns") / F.lit(1e9)).alias("value")), m.labels)
        if name == "absent":
            return self.absent(args[0])
        if name in ("histogram_quantile", "histogram_fraction", "histogram_count", "histogram_sum"):
            return self.histograms(name, args)
        raise Unsupported(f"function {name}")

    def over_time(self, name: str, args: tuple) -> Matrix:
        over = args[-1]
        if isinstance(over, Subquery):
            return self.subquery(name, over, self.number(args[0]) if len(args) > 1 else None)
        if not isinstance(over, Selector) or not over.range_ns:
            raise InvalidInput(f"{name} takes a range")
        if name == "absent_over_time":
            return self.absent(replace(over, range_ns=None))
        m = self.samples(replace(over, range_ns=None))
        if m is None:
            return self.empty()
        v, at = F.col("value"), F.struct("ns", "value")
        first, last = F.min_by("value", at), F.max_by("value", at)
        if name in ("rate", "increase", "delta"):
            out = (last - first) / F.lit(over.range_ns / 1e9) if name == "rate" else last - first
        elif name == "deriv":
            out = F.regr_slope("value", F.col("ns") / F.lit(1e9))
        elif name in ("irate", "idelta"):
            # The last two samples of each series, which need no sort of all of them.
            ranked = m.frame.withColumn("k", F.row_number().over(Window.partitionBy("bucket_ns", *m.labels).orderBy(F.desc("ns"), F.desc("value")))).where("k <= 2")
            two = ranked.groupBy("bucket_ns", *m.labels).agg(F.max(F.when(F.col("k") == 1, F.struct("ns", "value"))).alias("b"), F.max(F.when(F.col("k") == 2, F.struct("ns", "value"))).alias("a"))
            delta = F.col("b.value") - F.col("a.value")
            out = mx.divided(delta, (F.col("b.ns") - F.col("a.ns")) / F.lit(1e9)) if name == "irate" else delta
            return Matrix(two.where("a is not null").select("bucket_ns", *m.labels, out.alias("value")), m.labels)
        elif name in ("resets", "changes"):
            return self.events(m, name)
        elif name == "quantile_over_time":
            return mx.fold(m, "quantile", m.labels, self.number(args[0]))
        elif name == "last_over_time":
            out = last
        else:
            out = mx.aggregate(name.removesuffix("_over_time"), v)
        return Matrix(m.frame.groupBy("bucket_ns", *m.labels).agg(out.cast("double").alias("value")), m.labels)

    def events(self, m: Matrix, name: str) -> Matrix:
        """Decreases or changes between samples next to each other, of each metric and service.

        A bucket's samples are looked at in slices of its time, each in order by itself; then the
        last of a slice is held against the first of the next one that has any.
        """
        keys = ["bucket_ns", "metric_name", "service_name"]
        differs = lambda a, b: a > b if name == "resets" else a != b
        width = max(1, self.step // SLICES)
        sliced = m.frame.withColumn("slice", F.call_function("div", F.col("ns") - F.col("bucket_ns"), F.lit(width)))
        before = F.lag("value").over(Window.partitionBy(*keys, "slice").orderBy("ns", "value"))
        at = F.struct("ns", "value")
        each = sliced.withColumn("before", before).groupBy(*keys, "slice").agg(F.count_if(differs(F.col("before"), F.col("value"))).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
        last = F.lag("last").over(Window.partitionBy(*keys).orderBy("slice"))
        joined = each.withColumn("n", F.col("n") + F.coalesce(differs(last["value"], F.col("first.value")).cast("long"), F.lit(0)))
        return Matrix(joined.groupBy(*keys).agg(F.sum("n").cast("double").alias("value")), ("metric_name", "service_name"))

    def subquery(self, name: str, q: Subquery, param: float | None) -> Matrix:
        """Each inner point goes to all steps whose window (step - range, step] it is in, then steps are reduced."""
        inner = replace_window(self, self.start - q.range_ns, self.end)
        inner.step = max(q.step_ns, 1)
        m = inner.matrix(q.expr)
        first = self.start - self.start % self.step
        low = F.greatest(F.ceil(F.col("bucket_ns") / F.lit(self.step)).cast("long") * self.step, F.lit(first))
        high = F.least(F.col("bucket_ns") + F.lit(q.range_ns - 1), F.lit(self.end))
        covered = F.when(low <= high, F.sequence(low, high, F.lit(self.step)))
        points = m.frame.select(F.col("bucket_ns").alias("ns"), "service_name", "value", F.explode(covered).alias("bucket_ns"))
        op = name.removesuffix("_over_time")
        if op == "quantile":
            found = mx.exact_quantile(points, ["bucket_ns", "service_name"], "value", param)
            return Matrix(found.select("bucket_ns", F.lit("").alias("metric_name"), "service_name", "value"), ("metric_name", "service_name"))
        v = F.max_by("value", "ns") if op == "last" else mx.aggregate(op, F.col("value"), param)
        out = points.groupBy("bucket_ns", "service_name").agg(v.cast("double").alias("value"))
        return Matrix(out.select("bucket_ns", F.lit("").alias("metric_name"), "service_name", "value"), ("metric_name", "service_name"))

    def absent(self, e) -> Matrix:
        m = self.matrix(e)
        service = next((v for n, op, v in getattr(e, "matchers", ()) if n in _SERVICE and op == "="), "")
        every = mx.constant(self.spark, 1.0, self.start, self.end, self.step, {"metric_name": "", "service_name": service})
        return Matrix(every.frame.join(m.frame.select("bucket_ns").distinct(), "bucket_ns", "left_anti"), every.labels)

    def relabel(self, name: str, args: tuple) -> Matrix:
        m = self.matrix(args[0])
        text = [a.value for a in args[1:]]
        column = lambda label: "service_name" if label in _SERVICE else "metric_name" if label == "__name__" else f"label_{label}"
        target = column(text[0])
        if target not in ("service_name", "metric_name"):
            raise Unsupported(f"{name} writes the service or the metric's name, not {text[0]}")
        source = lambda label: F.col(column(label)) if column(label) in m.labels else F.lit("")
        if name == "label_replace":
            return mx.label_replace(m, target, text[1], source(text[2]), check_regex(text[3]))
        return Matrix(m.frame.withColumn(target, F.concat_ws(text[1], *[source(s) for s in text[2:]])).select("bucket_ns", *m.labels, "value"), m.labels)

    def histograms(self, name: str, args: tuple) -> Matrix:
        over, rate = args[-1], False
        if isinstance(over, Aggregation):
            raise Unsupported(f"{name} over an aggregation")
        if isinstance(over, Call) and over.name in ("rate", "increase"):
            over, rate = replace(over.args[0], range_ns=None), True
        if not isinstance(over, Selector):
            raise Unsupported(f"{name} takes a metric")
        frame = self.catalog.find(self.tenant, self.dataset, "metrics_histogram")
        if frame is None:
            return self.empty()
        frame = within(frame, "timestamp_ns", self.start, self.end).where(matcher_column(frame, over.matchers))
        labels = ("metric_name", "service_name")
        if name in ("histogram_count", "histogram_sum"):
            out = frame.groupBy(bucket(F.col("timestamp_ns"), self.step).alias("bucket_ns"), *labels).agg(F.sum(name.removeprefix("histogram_")).cast("double").alias("value"))
            return Matrix(out, labels)
        merged = merged_histograms(frame, self.step, [("service_name", F.col("service_name"))], rate)
        numbers = [self.number(a) for a in args[:-1]]
        value = histogram.quantile(numbers[0], F.col("bounds"), F.col("counts")) if name == "histogram_quantile" else histogram.fraction(numbers[0], numbers[1], F.col("bounds"), F.col("counts"))
        return Matrix(merged.select("bucket_ns", *labels, value.alias("value")), labels)


def replace_window(e: Evaluation, start: int, end: int) -> Evaluation:
    return Evaluation(e.catalog, e.tenant, e.dataset, start, end, e.step, e.spark)


def query_range(spark, catalog: Catalog, text: str, start: int, end: int, step: int, tenant: str = "acme", dataset: str = "prod") -> Matrix:
    """A range query; a query that is a number gives it at every step."""
    if step <= 0 or start > end:
        raise InvalidInput("a window and a step above zero")
    e = Evaluation(catalog, tenant, dataset, start, end, step, spark)
    out = e.run(parse(text))
    return out if isinstance(out, Matrix) else mx.constant(spark, out, start, end, step, {"metric_name": "", "service_name": ""})


def query(spark, catalog: Catalog, text: str, at: int, tenant: str = "acme", dataset: str = "prod") -> Matrix:
    """An instant query: the latest value of each series in the hour before."""
    m = query_range(spark, catalog, text, at - INSTANT_NS, at, INSTANT_NS, tenant, dataset)
    last = m.frame.groupBy(*m.labels).agg(F.max_by("value", "bucket_ns").alias("value"))
    return Matrix(last.select(F.lit(at).alias("bucket_ns"), *m.labels, "value"), m.labels)


def _metrics(catalog: Catalog, start: int | None, end: int | None, tenant: str, dataset: str) -> DataFrame | None:
    frame = catalog.union(tenant, dataset, ("metrics_gauge", "metrics_sum"))
    return frame if frame is None or start is None or end is None else within(frame, "timestamp_ns", start, end)


def labels(catalog: Catalog, start: int | None = None, end: int | None = None, tenant: str = "acme", dataset: str = "prod") -> DataFrame | None:
    """Label names of the metrics: the fixed ones and the keys of both maps."""
    frame = _metrics(catalog, start, end, tenant, dataset)
    if frame is None:
        return None
    keys = frame.select(F.explode(F.array_union(F.map_keys("attributes"), F.map_keys("resource_attributes"))).alias("label"))
    return keys.unionByName(frame.sparkSession.createDataFrame([("__name__",), ("job",), ("service_name",)], "label string")).distinct()


def label_values(catalog: Catalog, name: str, start: int | None = None, end: int | None = None, tenant: str = "acme", dataset: str = "prod") -> DataFrame | None:
    frame = _metrics(catalog, start, end, tenant, dataset)
    if frame is None:
        return None
    column = F.col("metric_name") if name == "__name__" else F.col("service_name") if name in _SERVICE else F.coalesce(F.col("attributes")[name], F.col("resource_attributes")[name])
    return frame.select(column.alias("value")).where("value is not null").distinct()


def series(catalog: Catalog, selector: str, start: int, end: int, tenant: str = "acme", dataset: str = "prod") -> DataFrame | None:
    """The different ``metric_name`` and ``service_name`` of the samples that a selector takes; empty ones are null."""
    e = parse(selector)
    if not isinstance(e, Selector) or e.range_ns:
        raise InvalidInput("a selector is wanted")
    frame = _metrics(catalog, start, end, tenant, dataset)
    if frame is None:
        return None
    named = [F.nullif(c, F.lit("")).alias(c) for c in ("metric_name", "service_name")]
    return frame.where(matcher_column(frame, e.matchers)).select(*named).where("metric_name is not null or service_name is not null").distinct()


def label_stats(catalog: Catalog, start: int | None = None, end: int | None = None, tenant: str = "acme", dataset: str = "prod") -> DataFrame | None:
    """How many values each label of the metrics has, about how many, and on what share of points it stands."""
    frame = _metrics(catalog, start, end, tenant, dataset)
    if frame is None:
        return None
    return stats.label_stats(stats.attribute_stats(frame, MAP_COLUMNS), frame.count())

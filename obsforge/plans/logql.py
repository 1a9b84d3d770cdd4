"""LogQL: a parser, and its lowering to streams of lines or to lazy matrices.

Range aggregates without groups keep (service, severity); line-shaping stages are read and have no
effect; ``offset`` is read and has none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput, Unsupported
from ..functions.predicate import check_regex
from ..functions.timeutil import HOUR_NS, bucket, duration_ns, within
from ..operators import matrix as mx
from ..operators.matrix import COMPARE, Matrix
from ..sources.catalog import Catalog
from .promql import unquote

MAPS = ("log_attributes", "resource_attributes", "scope_attributes")
SERIES = ("service_name", "severity_text")
_COLUMNS = {"service_name": "service_name", "service": "service_name", "service.name": "service_name", "job": "service_name", "level": "severity_text", "severity": "severity_text", "severity_text": "severity_text", "detected_level": "severity_text", "trace_id": "trace_id", "span_id": "span_id"}
_PASS = {"json", "logfmt", "regexp", "pattern", "unpack", "decolorize", "line_format", "label_format", "drop", "keep", "distinct"}
_UNWRAPPED = {f"{f}_over_time" for f in ("sum", "avg", "min", "max", "stddev", "stdvar", "first", "last", "quantile")}
_COUNTS = {"count_over_time", "rate", "bytes_over_time", "bytes_rate"}
_REFUSED = {"rate_counter", "absent_over_time"}
_AGGREGATES = {"sum", "avg", "min", "max", "count", "stddev", "stdvar", "topk", "bottomk", "sort", "sort_desc"}
_TOKEN = re.compile(
    r"""\s*(?:\#[^\n]*\n\s*)?(?:(?P<dur>\d+(?:\.\d+)?(?:ns|us|µs|ms|s|m|h|d|w|y)(?:\d+(?:\.\d+)?(?:ms|[smhdwy]))*)(?![A-Za-z])|(?P<bytes>\d+(?:\.\d+)?(?:[KMGT]i?B|B))|(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?)
    |(?P<id>[A-Za-z_][A-Za-z0-9_.]*)|(?P<str>"(?:\\.|[^"\\])*"|`[^`]*`)|(?P<op>\|=|\|~|!=|!~|=~|==|>=|<=|[-+*/%^<>=(){}\[\],|]))""",
    re.VERBOSE,
)
_PRECEDENCE = {"or": 1, "and": 2, "unless": 2, **dict.fromkeys(COMPARE, 3), "+": 4, "-": 4, "*": 5, "/": 5, "%": 5, "^": 6}
_BYTES = {"B": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12, "KiB": 2**10, "MiB": 2**20, "GiB": 2**30, "TiB": 2**40}


@dataclass(frozen=True)
class LogQuery:
    matchers: tuple[tuple[str, str, str], ...]
    stages: tuple[tuple, ...] = ()  # ("line", op, text) or ("label", tree)
    unwrap: str | None = None


@dataclass(frozen=True)
class RangeAgg:
    fn: str
    query: LogQuery
    range_ns: int
    param: float | None = None
    by: tuple[str, ...] | None = None


@dataclass(frozen=True)
class VectorAgg:
    op: str
    expr: object
    param: float | None = None
    by: tuple[str, ...] | None = None


@dataclass(frozen=True)
class LabelReplace:
    expr: object
    target: str
    replacement: str
    source: str
    regex: str


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object
    as_bool: bool = False
    on: tuple[str, ...] | None = None
    ignoring: tuple[str, ...] = ()


@dataclass(frozen=True)
class Number:
    value: float
    vector: bool = False


class Parser:
    def __init__(self, text: str) -> None:
        self.tokens, at = [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise InvalidInput(f"unexpected {text[at : at + 12]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else ""

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if not got or want is not None and got != want:
            raise InvalidInput(f"expected {want or 'more'}, found {got or 'the end'!r}")
        self.at += 1
        return got

    def accept(self, *want: str) -> str:
        if self.kind() != "str" and self.peek() in want:
            return self.take()
        return ""

    def text(self) -> str:
        if self.kind() != "str":
            raise InvalidInput(f"expected a string, found {self.peek()!r}")
        return unquote(self.take())

    def parse(self):
        out = self.query() if self.peek() == "{" else self.expr(0)
        if self.peek():
            raise InvalidInput(f"unexpected {self.peek()!r}")
        return out

    def names(self) -> tuple[str, ...]:
        self.take("(")
        out = []
        while not self.accept(")"):
            out.append(self.take())
            if not self.accept(","):
                self.take(")")
                break
        return tuple(out)

    def query(self) -> LogQuery:
        self.take("{")
        matchers = []
        while not self.accept("}"):
            name = self.take()
            op = self.take()
            if op not in ("=", "!=", "=~", "!~"):
                raise InvalidInput(f"not a matcher: {name}{op}")
            matchers.append((name, op, self.text()))
            if not self.accept(","):
                self.take("}")
                break
        if not matchers:
            raise InvalidInput("a selector needs a matcher")
        stages, unwrap = [], None
        while self.peek() in ("|=", "|~", "!=", "!~", "|") and self.kind() == "op":
            op = self.take()
            if op != "|":
                if self.peek() == "ip":
                    raise Unsupported("ip() filters")
                stages.append(("line", op, self.text()))
                continue
            if self.accept("unwrap"):
                unwrap = self.take()
                if self.accept("("):  # a conversion, which has no effect
                    unwrap = self.take()
                    self.take(")")
            elif self.peek() in _PASS and self.peek(1) not in ("=", "!=", "=~", "!~", "==", ">", "<", ">=", "<="):
                self.take()
                while self.peek() and self.peek() not in ("|", "|=", "|~", "[", ")"):
                    self.take()
            else:
                stages.append(("label", self.label(0)))
        return LogQuery(tuple(matchers), tuple(stages), unwrap)

    def label(self, least: int):
        if self.accept("("):
            left = self.label(0)
            self.take(")")
        else:
            name, op = self.take(), self.take()
            if op not in ("=", "!=", "=~", "!~", "==", ">", ">=", "<", "<="):
                raise InvalidInput(f"not a label filter: {name} {op}")
            kind = self.kind()
            if kind == "str":
                value = self.text()
            elif kind == "dur":
                value = float(duration_ns(self.take()))
            elif kind == "bytes":
                m = re.fullmatch(r"([\d.]+)(\w+)", self.take())
                value = float(m[1]) * _BYTES[m[2]]
            elif self.peek() == "ip":
                raise Unsupported("ip() filters")
            else:
                value = (-1.0 if self.accept("-") else 1.0) * float(self.take())
            left = ("test", name, op, value)
        while True:
            if self.peek() in ("and", ",") and least <= 2:
                self.take()
                left = ("and", left, self.label(3))
            elif self.peek() == "or" and least <= 1:
                self.take()
                left = ("or", left, self.label(2))
            else:
                return left

    def expr(self, least: int):
        left = self.unary()
        while (op := self.peek()) in _PRECEDENCE and self.kind() in ("op", "id") and _PRECEDENCE[op] >= max(least, 1):
            self.take()
            as_bool, on, ignoring = bool(self.accept("bool")), None, ()
            if word := self.accept("on", "ignoring"):
                if word == "on":
                    on = self.names()
                else:
                    ignoring = self.names()
            if self.accept("group_left", "group_right") and self.peek() == "(":
                self.names()
            left = Binary(op, left, self.expr(_PRECEDENCE[op] + 1), as_bool, on, ignoring)
        return left

    def unary(self):
        if self.accept("-"):
            inner = self.unary()
            return Number(-inner.value) if isinstance(inner, Number) else Binary("*", Number(-1.0), inner)
        if self.kind() == "num":
            return Number(float(self.take()))
        if self.accept("("):
            inner = self.expr(0)
            self.take(")")
            return inner
        name = self.take()
        if name in _REFUSED:
            raise Unsupported(name)
        if name in _COUNTS or name in _UNWRAPPED:
            self.take("(")
            param = None
            if name == "quantile_over_time":
                param = float(self.take())
                self.take(",")
            query = self.query()
            self.take("[")
            span = duration_ns(self.take())
            self.take("]")
            if self.peek() == "|":  # unwrap may stand after the range
                self.take()
                self.take("unwrap")
                query = LogQuery(query.matchers, query.stages, self.take())
            if self.accept("offset"):
                self.take()
            self.take(")")
            by = self.grouping()
            return RangeAgg(name, query, span, param, by)
        if name in _AGGREGATES:
            by = self.grouping()
            self.take("(")
            param = None
            if name in ("topk", "bottomk"):
                param = float(self.take())
                self.take(",")
            inner = self.expr(0)
            self.take(")")
            return VectorAgg(name, inner, param, by if by is not None else self.grouping())
        if name == "vector":
            self.take("(")
            value = float(self.take())
            self.take(")")
            return Number(value, True)
        if name == "label_replace":
            self.take("(")
            inner, rest = self.expr(0), []
            while self.accept(","):
                rest.append(self.text())
            self.take(")")
            return LabelReplace(inner, *rest)
        raise InvalidInput(f"unexpected {name!r}")

    def grouping(self) -> tuple[str, ...] | None:
        if self.accept("by"):
            return self.names()
        if self.accept("without"):
            if self.names():
                raise Unsupported("without labels")
            return ()
        return None


def parse(text: str):
    return Parser(text).parse()


def column_of(frame: DataFrame, name: str) -> str | None:
    if name in _COLUMNS:
        return _COLUMNS[name]
    label = "label_" + re.sub(r"[^A-Za-z0-9]", "_", name)
    return label if label in frame.columns else None


def _test(c: Column, op: str, value) -> Column:
    if op in ("=~", "!~"):
        check_regex(value)
        return c.rlike(value) if op == "=~" else ~c.rlike(value)
    if isinstance(value, str):
        if op not in ("=", "==", "!="):
            raise InvalidInput(f"{op} compares numbers")
        return c != value if op == "!=" else c == value
    n, v = c.try_cast("double"), F.lit(float(value))
    return {"=": n == v, "==": n == v, "!=": n != v, ">": n > v, ">=": n >= v, "<": n < v, "<=": n <= v}[op]


def label_test(frame: DataFrame, name: str, op: str, value) -> Column:
    """A label filter. A key of the maps: one that has it for positive tests, none for negative ones, which absent keys pass."""
    negative = op in ("!=", "!~")
    column = column_of(frame, name)
    if column:
        if op in (">", ">=", "<", "<=") and not column.startswith("label_"):
            raise Unsupported(f"{op} on {name}")
        c = F.col(column)
        return (c.isNull() | _test(c, op, value)) if negative and column.startswith("label_") else _test(c, op, value)
    out = F.lit(negative)
    for m in MAPS:
        if m in frame.columns:
            c = F.col(m)[name]
            out = out & (c.isNull() | _test(c, op, value)) if negative else out | F.coalesce(_test(c, op, value), F.lit(False))
    return out


def _tree(frame: DataFrame, node: tuple) -> Column:
    if node[0] == "test":
        return label_test(frame, *node[1:])
    a, b = _tree(frame, node[1]), _tree(frame, node[2])
    return a & b if node[0] == "and" else a | b


def filtered(frame: DataFrame, q: LogQuery) -> DataFrame:
    for name, op, value in q.matchers:
        frame = frame.where(label_test(frame, name, op, value))
    for stage in q.stages:
        if stage[0] == "line":
            _, op, text = stage
            body = F.col("body")
            if op.endswith("~"):
                check_regex(text)
            frame = frame.where({"|=": body.contains(text), "!=": ~body.contains(text), "|~": body.rlike(text), "!~": ~body.rlike(text)}[op])
        else:
            frame = frame.where(_tree(frame, stage[1]))
    return frame


@dataclass
class Evaluation:
    catalog: Catalog
    tenant: str
    dataset: str
    start: int
    end: int
    step: int
    spark: object

    def run(self, e) -> Matrix | float:
        if isinstance(e, Number):
            return mx.constant(self.spark, e.value, self.start, self.end, self.step, {}) if e.vector else e.value
        if isinstance(e, RangeAgg):
            return self.range(e, e.by)
        if isinstance(e, LabelReplace):
            m = self.run(e.expr)
            name = lambda n: _COLUMNS.get(n, n)
            source = F.col(name(e.source)) if name(e.source) in m.labels else F.lit("")
            return mx.label_replace(m, name(e.target), e.replacement, source, check_regex(e.regex))
        if isinstance(e, VectorAgg):
            return self.vector(e)
        if isinstance(e, Binary):
            return self.binary(e)
        raise InvalidInput("not a metric query")

    def range(self, e: RangeAgg, by: tuple[str, ...] | None) -> Matrix:
        frame = self.catalog.find(self.tenant, self.dataset, "logs")
        if frame is None:
            empty = self.spark.createDataFrame([], "bucket_ns long, service_name string, severity_text string, value double")
            return Matrix(empty, SERIES)
        frame = filtered(within(frame, "timestamp_ns", self.start, self.end), e.query)
        labels = SERIES if by is None else tuple(column_of(frame, b) or b for b in by)
        keys = [F.col(c) if c in frame.columns else F.coalesce(*[F.col(m)[c] for m in MAPS if m in frame.columns]) for c in labels]
        at = F.col("timestamp_ns")
        if e.fn in _COUNTS:
            value = F.sum(F.char_length("body")) if e.fn.startswith("bytes") else F.count(F.lit(1))
            value = value / F.lit(e.range_ns / 1e9) if e.fn in ("rate", "bytes_rate") else value
        else:
            if not e.query.unwrap:
                raise InvalidInput(f"{e.fn} needs unwrap")
            if e.query.unwrap not in frame.columns:
                raise Unsupported(f"unwrap of {e.query.unwrap}")
            x = F.col(e.query.unwrap).try_cast("double")
            op = e.fn.removesuffix("_over_time")
            value = F.min_by(x, F.struct(at, x)) if op == "first" else F.max_by(x, F.struct(at, x)) if op == "last" else mx.aggregate(op, x, e.param)
        out = frame.groupBy(bucket(at, self.step).alias("bucket_ns"), *[k.alias(c) for k, c in zip(keys, labels, strict=True)]).agg(value.cast("double").alias("value"))
        return Matrix(out, labels)

    def vector(self, e: VectorAgg) -> Matrix:
        if e.op in ("topk", "bottomk"):
            if e.by:
                raise Unsupported(f"{e.op} with groups")
            return mx.top(self.run(e.expr), int(e.param), e.op == "topk")
        if e.op in ("sort", "sort_desc"):
            return mx.by_series(self.run(e.expr), e.op == "sort_desc")
        by = e.by or ()
        if isinstance(e.expr, RangeAgg) and e.op == "sum" and e.expr.by is None and (e.expr.fn in _COUNTS or e.expr.fn == "sum_over_time"):
            return self.range(e.expr, by)  # sums of sums are one aggregation
        inner = self.range(e.expr, tuple(dict.fromkeys((*SERIES, *(_COLUMNS.get(b, b) for b in by))))) if isinstance(e.expr, RangeAgg) and e.expr.by is None else self.run(e.expr)
        frame = self.catalog.find(self.tenant, self.dataset, "logs")
        labels = tuple((column_of(frame, b) or b) if frame is not None else b for b in by)
        return mx.fold(inner, e.op, labels)

    def binary(self, e: Binary) -> Matrix | float:
        left, right = self.run(e.left), self.run(e.right)
        if isinstance(left, Matrix) and isinstance(right, Matrix):
            shared = tuple(c for c in left.labels if c in right.labels)
            on = tuple(_COLUMNS.get(c, c) for c in e.on) if e.on is not None else tuple(c for c in shared if c not in {_COLUMNS.get(i, i) for i in e.ignoring})
            if e.op in ("and", "or", "unless"):
                return mx.set_operation(left, right, on, e.op)
            if e.op in ("%", "^"):
                raise Unsupported(f"{e.op} between vectors")
            return mx.matched(left, right, on, e.op, e.as_bool, keep_left=True)
        if not isinstance(left, Matrix) and not isinstance(right, Matrix) or e.op in ("and", "or", "unless"):
            raise Unsupported("arithmetic of literals")
        return mx.with_scalar(right, e.op, left, True, e.as_bool) if isinstance(right, Matrix) else mx.with_scalar(left, e.op, right, False, e.as_bool)


def query_range(spark, catalog: Catalog, text: str, start: int, end: int, step: int, tenant: str = "acme", dataset: str = "prod") -> Matrix:
    out = Evaluation(catalog, tenant, dataset, start, end, step, spark).run(parse(text))
    if not isinstance(out, Matrix):
        raise InvalidInput("a number is not a query")
    return out


def lines(catalog: Catalog, text: str, start: int, end: int, limit: int = 100, forward: bool = False, tenant: str = "acme", dataset: str = "prod") -> DataFrame | None:
    """The lines of a log query, newest first unless ``forward``; ties by body, so the limit is settled."""
    q = parse(text)
    if not isinstance(q, LogQuery):
        raise InvalidInput("a log query is wanted")
    frame = catalog.find(tenant, dataset, "logs")
    if frame is None:
        return None
    frame = filtered(within(frame, "timestamp_ns", start, end), q)
    at = F.col("timestamp_ns").asc_nulls_first() if forward else F.col("timestamp_ns").desc_nulls_first()
    return frame.orderBy(at, *[c for c in ("body", "span_id") if c in frame.columns]).limit(limit).drop("hour_bucket")


def query(catalog: Catalog, text: str, at: int, limit: int = 100, tenant: str = "acme", dataset: str = "prod") -> DataFrame | None:
    """An instant query: the newest lines of the hour before; metric queries have no instant form."""
    if not isinstance(parse(text), LogQuery):
        raise Unsupported("an instant query takes lines; a metric query takes a range")
    return lines(catalog, text, at - HOUR_NS, at, limit, tenant=tenant, dataset=dataset)


def streams(rows: DataFrame) -> DataFrame:
    """Lines gathered by service and level, newest first, each with its attributes as JSON; a caller bounds them with ``lines`` first.

    Of a key that several maps have, the record's value is told.
    """
    held = [m for m in MAPS if m in rows.columns]
    entries = F.flatten(F.array(*[F.map_entries(F.coalesce(F.col(m), F.create_map().cast("map<string,string>"))) for m in held])) if held else F.array().cast("array<struct<key:string,value:string>>")
    first = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda x: x["key"] == e["key"]))
    entry = F.struct("timestamp_ns", "body", F.to_json(F.map_from_entries(F.array_sort(first))).alias("metadata"))
    return rows.groupBy("service_name", F.col("severity_text").alias("level")).agg(F.sort_array(F.collect_list(entry), asc=False).alias("entries"))


def detected_fields(catalog: Catalog, start: int, end: int, sample: int = 1000, tenant: str = "acme", dataset: str = "prod") -> DataFrame | None:
    """Attribute keys of the newest ``sample`` lines: the narrowest type that all values have, and how many there are."""
    frame = catalog.find(tenant, dataset, "logs")
    if frame is None:
        return None
    rows = within(frame, "timestamp_ns", start, end).orderBy(F.desc("timestamp_ns"), "span_id").limit(sample)
    each = rows.select(F.explode("log_attributes").alias("label", "v"))
    is_ = lambda p: F.bool_and(F.col("v").rlike(p))
    kind = F.when(is_("^(true|false)$"), "bool").when(is_(r"^-?\d+$"), "int").when(is_(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "float").otherwise("string")
    return each.groupBy("label").agg(kind.alias("type"), F.count_distinct("v").alias("cardinality"))


def label_values(catalog: Catalog, name: str, start: int, end: int, tenant: str = "acme", dataset: str = "prod") -> DataFrame | None:
    frame = catalog.find(tenant, dataset, "logs")
    if frame is None:
        return None
    column = column_of(frame, name)
    value = F.col(column) if column else F.coalesce(*[F.col(m)[name] for m in MAPS])
    return within(frame, "timestamp_ns", start, end).select(value.alias("value")).where("value is not null").distinct()


#: Labels that lines always have.
KNOWN = ("detected_level", "level", "service_name", "span_id", "trace_id")


def labels(catalog: Catalog, start: int, end: int, tenant: str = "acme", dataset: str = "prod") -> DataFrame | None:
    """Label names: the fixed ones and the keys of the lines' and resources' maps."""
    frame = catalog.find(tenant, dataset, "logs")
    if frame is None:
        return None
    keys = [F.map_keys(F.coalesce(F.col(m), F.create_map().cast("map<string,string>"))) for m in ("log_attributes", "resource_attributes")]
    found = within(frame, "timestamp_ns", start, end).select(F.explode(F.array_union(*keys)).alias("label"))
    return found.unionByName(frame.sparkSession.createDataFrame([(k,) for k in KNOWN], "label string")).distinct()


def series(catalog: Catalog, selector: str, start: int, end: int, tenant: str = "acme", dataset: str = "prod") -> DataFrame | None:
    """The different ``service_name`` and ``level`` of the lines that a selector takes."""
    q = parse(selector)
    if not isinstance(q, LogQuery):
        raise InvalidInput("a selector is wanted")
    frame = catalog.find(tenant, dataset, "logs")
    if frame is None:
        return None
    return filtered(within(frame, "timestamp_ns", start, end), q).select("service_name", F.col("severity_text").alias("level")).distinct()

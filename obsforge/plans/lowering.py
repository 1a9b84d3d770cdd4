"""TraceQL and LogQL as query documents, where a document can say the same; ``Unsupported`` where it cannot."""

from __future__ import annotations

from ..errors import Unsupported
from . import logql as logql_
from . import traceql as traceql_

_STATUS = {"ok": "Ok", "error": "Error", "unset": "Unspecified"}


def _eq(field: str, value) -> dict:
    return {"field": field, "op": "eq", "value": value}


def _span_condition(name: str, value: str) -> dict:
    if name in ("name", "span.name"):
        return _eq("name", value)
    if name in ("service.name", "resource.service.name", ".service.name"):
        return _eq("service.name", value)
    if name == "rootServiceName":
        return {"and": [_eq("service.name", value), _eq("is_root", True)]}
    if name == "status":
        if value not in _STATUS:
            raise Unsupported(f"status {value!r}")
        return _eq("status.code", _STATUS[value])
    if name == "kind":
        return _eq("span.kind", value.title())
    if name.startswith(("span.", "resource.")):
        return _eq(name, value)
    key = name.removeprefix(".")
    return {"or": [_eq(f"span.{key}", value), _eq(f"resource.{key}", value)]}


def traceql(text: str, start: int, end: int) -> dict:
    """The spans that a selector takes."""
    where = [{"where": {"and": [_span_condition(n, v) for n, v in traceql_.parse(text)]}}]
    return {"irVersion": 1, "from": "traces", "range": {"from": start, "to": end}, "result": "rows", "pipeline": where}


_FIELDS = {"service_name": "service.name", "severity_text": "severity_text", "trace_id": "trace_id", "span_id": "span_id"}


def _field(name: str) -> str:
    return _FIELDS.get(logql_._COLUMNS.get(name, ""), name)


def _matcher(name: str, op: str, value: str) -> dict:
    field = _field(name)
    test = {"field": field, "op": "regex" if op.endswith("~") else "eq", "value": value}
    if not op.startswith("!"):
        return test
    # Lines without an attribute pass negative matchers on it; a document's tests they pass never.
    negated = {"not": test}
    return negated if field in _FIELDS.values() else {"or": [negated, {"not": {"field": field, "op": "exists"}}]}


def logql(text: str, start: int, end: int, step: str) -> dict:
    """``sum by (...)`` of ``count_over_time`` or ``rate`` of lines that matchers take, as a stepped aggregate."""
    e = logql_.parse(text)
    if isinstance(e, logql_.VectorAgg) and e.op == "sum" and isinstance(e.expr, logql_.RangeAgg):
        by, inner = e.by or (), e.expr
    elif isinstance(e, logql_.RangeAgg):
        by, inner = logql_.SERIES, e
    else:
        raise Unsupported("not a sum of counts")
    if inner.fn not in ("count_over_time", "rate") or any(s[0] == "line" for s in inner.query.stages) or inner.query.stages or inner.query.unwrap:
        raise Unsupported(f"{inner.fn} over such lines")
    agg = {"fn": "count", "as": "value"} | ({"divisor": inner.range_ns / 1e9} if inner.fn == "rate" else {})
    where = [{"where": {"and": [_matcher(*m) for m in inner.query.matchers]}}]
    return {"irVersion": 5, "from": "logs", "range": {"from": start, "to": end}, "result": "series", "pipeline": [*where, {"aggregate": {"by": [_field(b) for b in by], "step": step, "aggs": [agg]}}]}

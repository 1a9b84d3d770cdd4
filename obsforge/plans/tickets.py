"""One entry for all queries: a ticket names what is asked, of which tenant and dataset, and the rest."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidInput
from ..functions.timeutil import duration_ns
from ..operators import matrix, profiles
from ..operators.transforms import profile_samples
from ..sources.catalog import Catalog
from . import ir, logql, promql, sql, traceql

#: What a ticket may ask, and the query for (spark, catalog, arguments, {tenant, dataset}).
Handler = Callable[[SparkSession, Catalog, dict, dict], DataFrame | None]


def _profiles(catalog: Catalog, of: dict) -> DataFrame | None:
    return catalog.find(of["tenant"], of["dataset"], "profiles")


def _logs(spark: SparkSession, c: Catalog, a: dict, of: dict) -> DataFrame | None:
    if isinstance(logql.parse(a["query"]), logql.LogQuery):
        return logql.lines(c, a["query"], a["start"], a["end"], a.get("limit", 100), a.get("direction") == "forward", **of)
    return logql.query_range(spark, c, a["query"], a["start"], a["end"], duration_ns(a.get("step", "1m")), **of).frame


def _promql(spark: SparkSession, c: Catalog, a: dict, of: dict) -> DataFrame:
    if "time" in a:
        return promql.query(spark, c, a["query"], a["time"], **of).frame
    m = promql.query_range(spark, c, a["query"], a["start"], a["end"], duration_ns(a["step"]), **of)
    return (matrix.guard(m) if a.get("guard", True) else m).frame


def _search(spark: SparkSession, c: Catalog, a: dict, of: dict) -> DataFrame | None:
    conditions = traceql.parse(a["query"]) if a.get("query") else traceql.tags(a.get("tags", ""))
    bounds = {k: duration_ns(a[k]) for k in ("min_duration", "max_duration") if k in a}
    return traceql.search(c, conditions, *traceql.bounds(a["start"], a["end"]), a.get("limit", traceql.DEFAULT_LIMIT), **bounds, **of)


def _flamegraph(spark: SparkSession, c: Catalog, a: dict, of: dict) -> DataFrame | None:
    found = _profiles(c, of)
    if found is None:
        return None
    found = profiles.within(found, "timestamp_ns", a["start"], a["end"])
    return profiles.prefixes(profile_samples(found) if "samples_json" in found.columns else found)


def _profile(query: Callable[[DataFrame, dict], DataFrame]) -> Handler:
    def handle(spark: SparkSession, c: Catalog, a: dict, of: dict) -> DataFrame | None:
        found = _profiles(c, of)
        return None if found is None else query(found, a)

    return handle


_bounds = lambda a: (a.get("start"), a.get("end"))
HANDLERS: dict[str, Handler] = {
    "query_ir": lambda s, c, a, of: ir.run(a["document"], c, of["tenant"], of["dataset"], a.get("now_ns", 0)).frame,
    "query_promql": _promql,
    "query_logs": _logs,
    "sql": lambda s, c, a, of: sql.query(s, c, a["query"], **of, most=a.get("most", sql.MAX_ROWS)),
    "find_trace": lambda s, c, a, of: traceql.trace(c, a["trace_id"], *traceql.bounds(a.get("start"), a.get("end")), **of),
    "search_traces": _search,
    "trace_tags": lambda s, c, a, of: traceql.tag_names(c, *traceql.bounds(a.get("start"), a.get("end")), **of),
    "trace_tag_values": lambda s, c, a, of: traceql.tag_values(c, a["tag"], **of),
    "query_logs_labels": lambda s, c, a, of: logql.labels(c, a["start"], a["end"], **of),
    "query_logs_label_values": lambda s, c, a, of: logql.label_values(c, a["label"], a["start"], a["end"], **of),
    "query_logs_series": lambda s, c, a, of: logql.series(c, a["selector"], a["start"], a["end"], **of),
    "query_logs_detected_fields": lambda s, c, a, of: logql.detected_fields(c, a["start"], a["end"], **of),
    "query_metric_labels": lambda s, c, a, of: promql.labels(c, *_bounds(a), **of),
    "query_metric_label_values": lambda s, c, a, of: promql.label_values(c, a["label"], *_bounds(a), **of),
    "query_metric_series": lambda s, c, a, of: promql.series(c, a["selector"], a["start"], a["end"], **of),
    "label_stats": lambda s, c, a, of: promql.label_stats(c, *_bounds(a), **of),
    "search_profiles": _profile(lambda f, a: profiles.search(f, *_bounds(a), a.get("service"), a.get("sample_type"), a.get("limit"))),
    "find_profile": _profile(lambda f, a: profiles.by_id(f, a["profile_id"])),
    "profiles_by_trace": _profile(lambda f, a: profiles.by_trace(f, a["trace_id"], a.get("span_id"), a.get("limit"))),
    "profile_types": _profile(lambda f, a: profiles.types(f)),
    "profile_label_names": _profile(lambda f, a: profiles.label_names(f, *_bounds(a))),
    "profile_label_values": _profile(lambda f, a: profiles.label_values(f, a["label"], *_bounds(a))),
    "profile_flamegraph": _flamegraph,
}


def run(spark: SparkSession, catalog: Catalog, ticket: str) -> DataFrame | None:
    """A ticket, ``what:tenant:dataset:{arguments as JSON}``, as a lazy DataFrame; none where there is no table."""
    parts = ticket.split(":", 3)
    if len(parts) != 4 or parts[0] not in HANDLERS:
        raise InvalidInput(f"not a ticket: {ticket[:40]!r}")
    what, tenant, dataset, rest = parts
    try:
        arguments = json.loads(rest)
    except ValueError:
        raise InvalidInput(f"{what}: the arguments are no JSON") from None
    if not isinstance(arguments, dict):
        raise InvalidInput(f"{what}: the arguments are no object")
    try:
        return HANDLERS[what](spark, catalog, arguments, {"tenant": tenant, "dataset": dataset})
    except KeyError as missing:
        raise InvalidInput(f"{what}: {missing.args[0]} is missing") from None

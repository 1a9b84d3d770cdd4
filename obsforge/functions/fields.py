"""Logical field names of each source, resolved to columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput


@dataclass(frozen=True)
class Source:
    """A registered source: its tables, time column, attribute maps (record first) and named fields."""

    tables: tuple[str, ...]
    time: str
    containers: tuple[tuple[str, str], ...]
    fields: dict[str, tuple[str, str]]
    rows: tuple[str, ...]
    retrieval_only: frozenset[str] = field(default_factory=frozenset)


_RESOURCE = (("scope", "scope_attributes"), ("resource", "resource_attributes"))
SOURCES = {
    "logs": Source(("logs",), "timestamp_ns", (("log", "log_attributes"), *_RESOURCE), {"timestamp": ("timestamp_ns", "timestamp_ns"), "service.name": ("service_name", "string"), "severity_text": ("severity_text", "string"), "severity_number": ("severity_number", "int64"), "body": ("body", "string"), "trace_id": ("trace_id", "string"), "span_id": ("span_id", "string"), "duration": ("duration", "float64")}, ("timestamp", "service.name", "severity_text", "severity_number", "body", "trace_id", "span_id"), frozenset({"body", "log.attributes", "scope.attributes", "resource.attributes"})),
    "traces": Source(("traces",), "start_ns", (("span", "span_attributes"), *_RESOURCE), {"timestamp": ("start_ns", "timestamp_ns"), "trace.id": ("trace_id", "string"), "span.id": ("span_id", "string"), "parent.span.id": ("parent_span_id", "string"), "name": ("span_name", "string"), "service.name": ("service_name", "string"), "duration": ("duration_nanos", "duration_ns"), "status.code": ("status_code", "string"), "span.kind": ("span_kind", "string"), "is_root": ("is_root", "bool")}, ("timestamp", "trace.id", "span.id", "name", "service.name", "duration", "status.code"), frozenset({"span_events", "span.attributes", "scope.attributes", "resource.attributes"})),
    "metrics": Source(("metrics_gauge", "metrics_sum"), "timestamp_ns", (("metric", "attributes"), *_RESOURCE), {"timestamp": ("timestamp_ns", "timestamp_ns"), "metric.name": ("metric_name", "string"), "service.name": ("service_name", "string"), "value": ("value", "float64")}, ("timestamp", "metric.name", "service.name", "value"), frozenset({"metric.attributes", "scope.attributes", "resource.attributes"})),
    "metrics_histogram": Source(("metrics_histogram",), "timestamp_ns", (), {"timestamp": ("timestamp_ns", "timestamp_ns"), "metric.name": ("metric_name", "string"), "service.name": ("service_name", "string"), "count": ("count", "int64"), "sum": ("sum", "float64")}, ("timestamp", "metric.name", "service.name", "count", "sum")),
    "profiles": Source(("profiles",), "timestamp_ns", (), {"timestamp": ("timestamp_ns", "timestamp_ns"), "service.name": ("service_name", "string"), "sample.type": ("sample_type", "string"), "sample.unit": ("sample_unit", "string"), "value": ("value", "int64")}, ("timestamp", "service.name", "sample.type", "sample.unit")),
}
_EVENTS = "array<struct<name:string,timestamp_unix_nano:bigint,attributes:map<string,string>>>"


def ident(name: str) -> str:
    """A column name for a logical name: what is not a letter or digit becomes ``_``."""
    return re.sub(r"[^A-Za-z0-9]", "_", name)


class Resolver:
    """Field names to columns of one scanned source, with the type their literals take."""

    def __init__(self, source: Source, frame: DataFrame, derived: dict[str, str] | None = None) -> None:
        self.source, self.columns, self.derived = source, set(frame.columns), derived or {}

    def column(self, name: str) -> tuple[Column, str]:
        if name in self.derived:
            return F.col(f"`{ident(name)}`"), self.derived[name]
        if name in self.source.fields:
            physical, kind = self.source.fields[name]
            return F.col(physical), kind
        if name.startswith("exception.") and "events" in self.columns:
            thrown = F.filter(F.from_json("events", _EVENTS), lambda e: e["name"] == "exception")
            return F.get(thrown, F.lit(0))["attributes"][name], "string"
        if name == "span_events" and "events" in self.columns:
            return F.when(F.size(F.from_json("events", _EVENTS)) > 0, F.to_json(F.from_json("events", _EVENTS))), "string"
        for prefix, container in self.source.containers:
            if name == f"{prefix}.attributes":
                return F.col(container), "map"
        # A materialised label holds the resource's value first, so it is read for that scope alone.
        if name in {c for c in self.columns if not c.endswith(("_ns", "_json"))}:
            if name in {p for p, _ in self.source.fields.values()} or name.endswith("attributes") or name.startswith("label_"):
                raise InvalidInput(f"{name!r} is a physical column; use its logical name")
        return self.attribute(name), "string"

    def attribute(self, name: str) -> Column:
        """A qualified name reads one container; another the first of record, scope and resource that has it."""
        for prefix, container in self.source.containers:
            if name.startswith(prefix + ".") and container in self.columns:
                return F.col(container)[name[len(prefix) + 1 :]]
        held = [F.col(c)[name] for _, c in self.source.containers if c in self.columns]
        return F.coalesce(*held) if held else F.lit(None).cast("string")

    def known(self, name: str) -> bool:
        return name in self.derived or name in self.source.fields or name.startswith("exception.") or name == "span_events"

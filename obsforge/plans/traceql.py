"""TraceQL, the subset of equalities joined by ``&&``, and the search of traces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput, Unsupported
from ..functions.timeutil import seconds_ns, within
from ..sources.catalog import Catalog

DEFAULT_LIMIT, MAX_LIMIT, SPANS_A_TRACE = 20, 1000, 50
_STATUS = {"ok": "Ok", "error": "Error", "unset": "Unspecified"}
_TERM = re.compile(r"""\s*([.A-Za-z_][\w.:-]*)\s*(=~|!~|!=|>=|<=|=|>|<)\s*("(?:\\.|[^"\\])*"|`[^`]*`|[\w.+-]+)\s*""")


def parse(text: str) -> list[tuple[str, str]]:
    """(attribute, value) pairs that must all hold; ``{}`` holds for every span."""
    body = text.strip()
    if not (body.startswith("{") and body.endswith("}")):
        raise InvalidInput("a query stands in braces")
    body = body[1:-1]
    if "||" in re.sub(r'"[^"]*"', "", body) or re.search(r"}\s*(?:&&|\|\||>>|\|)", text):
        raise Unsupported("only conditions joined by && in one selector")
    out, at = [], 0
    while body[at:].strip():
        if out:
            if not body[at:].lstrip().startswith("&&"):
                raise InvalidInput(f"expected && at {body[at : at + 10]!r}")
            at = body.index("&&", at) + 2
        m = _TERM.match(body, at)
        if not m:
            raise InvalidInput(f"not a condition: {body[at : at + 20]!r}")
        name, op, value = m[1], m[2], m[3]
        if op != "=" or name in ("duration", "traceDuration"):
            raise Unsupported(f"{name} {op}")
        out.append((name, value[1:-1].replace('\\"', '"') if value[0] in "\"`" else value))
        at = m.end()
    return out


def bounds(start: int | None, end: int | None) -> tuple[int | None, int | None]:
    """Bounds of a search, in epoch seconds, as nanoseconds; milliseconds are refused, not taken for seconds."""
    low, high = (None if t is None else seconds_ns(t) for t in (start, end))
    if low is not None and high is not None and low > high:
        raise InvalidInput("the range ends before it begins")
    return low, high


def tags(text: str) -> list[tuple[str, str]]:
    """Conditions of a ``key=value key="two words"`` filter."""
    out = [(m[1], m[2].strip('"')) for m in re.finditer(r'([^\s=]+)=("[^"]*"|\S*)', text)]
    if re.sub(r'([^\s=]+)=("[^"]*"|\S*)', "", text).strip():
        raise InvalidInput(f"not tags: {text!r}")
    return out


def condition(name: str, value: str) -> Column:
    if name in ("name", "span.name"):
        return F.col("span_name") == value
    if name in ("service.name", "resource.service.name", ".service.name", "rootServiceName"):
        return F.col("service_name") == value
    if name == "status":
        if value not in _STATUS:
            raise InvalidInput(f"status {value!r}")
        return F.col("status_code") == _STATUS[value]
    if name == "kind":
        return F.col("span_kind") == value.title()
    if name.startswith("span."):
        return F.col("span_attributes")[name[5:]] == value
    if name.startswith("resource."):
        return F.col("resource_attributes")[name[9:]] == value
    key = name.removeprefix(".")
    return F.coalesce(F.col("span_attributes")[key] == value, F.lit(False)) | F.coalesce(F.col("resource_attributes")[key] == value, F.lit(False))


def matching_spans(catalog: Catalog, conditions: list[tuple[str, str]], start: int, end: int, min_duration: int | None = None, max_duration: int | None = None, tenant: str = "acme", dataset: str = "prod") -> DataFrame | None:
    frame = catalog.find(tenant, dataset, "traces")
    if frame is None:
        return None
    frame = within(frame, "start_ns", start, end)
    for name, value in conditions:
        frame = frame.where(condition(name, value))
    if min_duration is not None:
        frame = frame.where(F.col("duration_nanos") >= min_duration)
    if max_duration is not None:
        frame = frame.where(F.col("duration_nanos") <= max_duration)
    return frame


def search(catalog: Catalog, conditions: list[tuple[str, str]], start: int, end: int, limit: int = DEFAULT_LIMIT, **more) -> DataFrame | None:
    """The traces of the newest matching spans: id, newest and number of those spans; newest first."""
    limit = min(max(limit, 1), MAX_LIMIT)
    spans = matching_spans(catalog, conditions, start, end, **more)
    if spans is None:
        return None
    newest = spans.select("trace_id", "span_id", "start_ns", "duration_nanos").orderBy(F.desc("start_ns"), "trace_id", "span_id").limit(limit * SPANS_A_TRACE)
    found = newest.groupBy("trace_id").agg(F.max("start_ns").alias("newest_ns"), F.count(F.lit(1)).alias("n_spans"), F.max("duration_nanos").alias("longest_ns"))
    return found.orderBy(F.desc("newest_ns"), "trace_id").limit(limit)


def trace(catalog: Catalog, trace_id: str, start: int | None = None, end: int | None = None, tenant: str = "acme", dataset: str = "prod") -> DataFrame | None:
    """The spans of a trace; times, where known, keep the scan to their partitions."""
    frame = catalog.find(tenant, dataset, "traces")
    if frame is None:
        return None
    frame = frame.where(F.col("trace_id") == trace_id)
    frame = frame if start is None or end is None else within(frame, "start_ns", start, end)
    return frame.drop("hour_bucket")


def hierarchy(spans: list[dict]) -> list[tuple[str, int]]:
    """(span, depth) of one trace, parents first.

    Roots are marked so, or have no parent, or one that is not there; siblings stand by start and id.
    Spans that no root leads to hang below a cycle of parents; each cycle is entered at its earliest
    member, so all that hangs below it keeps its parent. Of rows with the same span id one counts.
    """
    by_id = {s["span_id"]: s for s in spans}
    key = lambda s: (s["start_ns"], s["span_id"])
    ordered = sorted(by_id.values(), key=key)
    children: dict[str, list[dict]] = {}
    roots = []
    for s in ordered:
        parent = s["parent_span_id"]
        if s.get("is_root") or not parent or not parent.strip("0") or parent not in by_id:
            roots.append(s)
        else:
            children.setdefault(parent, []).append(s)
    out, seen = [], set()

    def walk(top: dict) -> None:
        stack = [(top, 0)]
        while stack:
            s, depth = stack.pop()
            if s["span_id"] not in seen:
                seen.add(s["span_id"])
                out.append((s["span_id"], depth))
                stack += [(c, depth + 1) for c in reversed(children.get(s["span_id"], []))]

    for s in roots:
        walk(s)
    # From any span left, the way up ends in a cycle; a way that meets an earlier one ends in the same.
    entries, climbed = [], set(seen)
    for s in ordered:
        way: dict[str, None] = {}
        at = s["span_id"]
        while at not in climbed and at not in way:
            way[at] = None
            at = by_id[at]["parent_span_id"]
        if at in way:
            path = list(way)
            entries.append(min((by_id[i] for i in path[path.index(at) :]), key=key))
        climbed |= way.keys()
    for s in sorted(entries, key=key):
        walk(s)
    return out


def span_trees(spans: DataFrame) -> DataFrame:
    """``trace_id``, ``span_id`` and ``depth`` of every span, see ``hierarchy``; a task holds one trace at a time.

    Spans without a trace id belong to none: each is a root, in the task that read it.
    """

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trace: list[dict] = []
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["trace_id", "span_id", "depth"])

        for batch in batches:
            for span in batch.to_pylist():
                if trace and span["trace_id"] != trace[0]["trace_id"]:
                    out += [(trace[0]["trace_id"], i, d) for i, d in hierarchy(trace)]
                    trace = []
                trace.append(span)
            if len(out) >= 4096:
                yield flush()
        if trace:
            out += [(trace[0]["trace_id"], i, d) for i, d in hierarchy(trace)]
        if out:
            yield flush()

    spans = spans.select("trace_id", "span_id", "parent_span_id", "start_ns", "is_root")
    known = spans.where(F.col("trace_id").isNotNull()).repartition("trace_id").sortWithinPartitions("trace_id")
    loose = spans.where(F.col("trace_id").isNull()).select("trace_id", "span_id", F.lit(0).cast("long").alias("depth"))
    return known.mapInArrow(trees, "trace_id string, span_id string, depth long").unionByName(loose)


#: Tags that every trace has, besides the attributes of spans and resources.
INTRINSIC = ("duration", "kind", "name", "rootName", "rootServiceName", "service.name", "status", "traceDuration")


def tag_names(catalog: Catalog, start: int | None = None, end: int | None = None, tenant: str = "acme", dataset: str = "prod") -> DataFrame | None:
    """``scope`` (intrinsic, span or resource) and ``tag``, each once."""
    frame = catalog.find(tenant, dataset, "traces")
    if frame is None:
        return None
    if start is not None and end is not None:
        frame = within(frame, "start_ns", start, end)
    own = frame.sparkSession.createDataFrame([("intrinsic", t) for t in INTRINSIC], "scope string, tag string")

    def keys(scope: str) -> Column:
        held = F.coalesce(f"{scope}_attributes", F.create_map().cast("map<string,string>"))
        return F.transform(F.map_keys(held), lambda k: F.struct(F.lit(scope).alias("scope"), k.alias("tag")))

    found = frame.select(F.explode(F.concat(keys("span"), keys("resource"))).alias("t"))
    return own.unionByName(found.select("t.*").distinct())


def tag_values(catalog: Catalog, name: str, tenant: str = "acme", dataset: str = "prod") -> DataFrame | None:
    frame = catalog.find(tenant, dataset, "traces")
    if frame is None:
        return None
    fixed = {"status": ["error", "ok", "unset"], "kind": ["client", "consumer", "internal", "producer", "server", "unspecified"]}
    if name in fixed:
        return frame.sparkSession.createDataFrame([(v,) for v in fixed[name]], "value string")
    if name in ("rootName", "rootServiceName"):
        frame = frame.where("is_root")
    column = {"name": F.col("span_name"), "rootName": F.col("span_name"), "service.name": F.col("service_name"), "rootServiceName": F.col("service_name")}.get(name)
    if column is None:
        key = name.removeprefix("span.").removeprefix("resource.").removeprefix(".")
        column = F.coalesce(F.col("span_attributes")[key], F.col("resource_attributes")[key])
    return frame.select(column.alias("value")).where("value is not null").distinct()

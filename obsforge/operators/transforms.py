"""Wire rows turned into the rows that are stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCOPES = ("resource_attributes", "scope_attributes", "log_attributes", "span_attributes", "attributes")
#: Columns of a metric that each of its points keeps, where the wire row has them.
_METRIC = ("description", "unit", "aggregation_temporality", "is_monotonic", "resource_attributes", "scope_attributes")
UNKNOWN = "unknown"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row; the optimizer copies a plain expression to every place that names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def empty_map(c: str) -> Column:
    return F.coalesce(F.col(c), F.create_map().cast("map<string,string>"))


def instant(ns: Column) -> Column:
    """Nanoseconds as a timestamp, rounded down to microseconds in whole numbers, also before the epoch."""
    return F.timestamp_micros(F.call_function("div", ns - F.pmod(ns, F.lit(1000)), F.lit(1000)))


def _dated(frame: DataFrame, ns: str) -> DataFrame:
    """``date_day`` and ``hour`` of a time in nanoseconds."""
    at = instant(F.col(ns))
    return frame.withColumns({"date_day": F.to_date(at), "hour": F.hour(at)})


def hex_id(c: str) -> Column:
    """Bytes of an id in lower-case hex digits; none, or no bytes, is null."""
    return F.nullif(F.lower(F.hex(c)), F.lit(""))


def traces(wire: DataFrame) -> DataFrame:
    """Wire spans: new names, signed numbers, day and hour of the start, events and links as JSON."""
    out = wire.withColumnsRenamed({"name": "span_name", "attributes_json": "span_attributes", "resource_json": "resource_attributes"})
    cast = {c: F.col(c).cast("long") for c in ("start_time_unix_nano", "end_time_unix_nano", "duration_nanos") if c in out.columns}
    json = {c: F.coalesce(F.to_json(c), F.lit("[]")) for c, kind in out.dtypes if c in ("events", "links") and kind.startswith("array")}
    maps = {c: F.from_json(c, "map<string,string>") for c, kind in out.dtypes if c in ("span_attributes", "resource_attributes") and kind == "string"}
    return _dated(out.withColumns(cast | json | maps), "start_time_unix_nano")


def logs(wire: DataFrame) -> DataFrame:
    """Wire log records: the time, or when it is zero the time of observation; ids in hex, empty ones null."""
    at = F.when(F.col("time_unix_nano") == 0, F.col("observed_time_unix_nano")).otherwise(F.col("time_unix_nano")).cast("long")
    ids = {c: hex_id(c) for c, kind in wire.dtypes if c in ("trace_id", "span_id") and kind == "binary"}
    return _dated(wire.withColumn("timestamp_ns", at).withColumns(ids), "timestamp_ns")


# --- metrics: a row for each data point ---------------------------------------------------------


def _points(wire: DataFrame, fields: str, *columns: Column) -> DataFrame:
    """The points of ``data_json`` with their metric; a point without service is ``unknown``."""
    kept = [c for c in _METRIC if c in wire.columns]
    points = F.from_json("data_json", f"array<struct<time_unix_nano:bigint,start_time_unix_nano:bigint,flags:bigint,attributes:map<string,string>,{fields}>>")
    each = wire.select("metric_name", F.coalesce("service_name", F.lit(UNKNOWN)).alias("service_name"), *kept, F.explode(points).alias("p"))
    return each.select(F.col("p.time_unix_nano").alias("timestamp_ns"), F.col("p.start_time_unix_nano").alias("start_timestamp_ns"), "metric_name", "service_name", *columns, F.col("p.attributes").alias("attributes"), F.col("p.flags").alias("flags"), *kept)


def _or_nan(field: str) -> Column:
    return F.coalesce(F.col(f"p.{field}"), F.lit(float("nan"))).alias(field)


def number_points(wire: DataFrame) -> DataFrame:
    """Gauge and sum metrics; a point without value is NaN."""
    return _points(wire, "value:double", _or_nan("value"))


def histogram_points(wire: DataFrame) -> DataFrame:
    """Classic histograms, whose bounds and counts are JSON arrays; without a sum it is NaN, without min or max null."""
    fields = "count:bigint,sum:double,min:double,max:double,bucket_counts:array<bigint>,explicit_bounds:array<double>"
    arrays = [F.coalesce(F.to_json(f"p.{c}"), F.lit("[]")).alias(c) for c in ("bucket_counts", "explicit_bounds")]
    return _points(wire, fields, F.col("p.count").alias("count"), _or_nan("sum"), F.col("p.min").alias("min"), F.col("p.max").alias("max"), *arrays)


def summary_points(wire: DataFrame) -> DataFrame:
    fields = "count:bigint,sum:double,quantile_values:array<struct<quantile:double,value:double>>"
    return _points(wire, fields, F.col("p.count").alias("count"), _or_nan("sum"), F.coalesce(F.to_json("p.quantile_values"), F.lit("[]")).alias("quantile_values"))


def exponential_points(wire: DataFrame) -> DataFrame:
    side = "struct<offset:int,bucket_counts:array<bigint>>"
    fields = f"count:bigint,sum:double,scale:int,zero_count:bigint,zero_threshold:double,positive:{side},negative:{side}"
    halves = [c for s in ("positive", "negative") for c in (F.col(f"p.{s}.offset").alias(f"{s}_offset"), F.coalesce(F.to_json(f"p.{s}.bucket_counts"), F.lit("[]")).alias(f"{s}_bucket_counts"))]
    return _points(wire, fields, F.col("p.count").alias("count"), _or_nan("sum"), F.col("p.scale").alias("scale"), F.col("p.zero_count").alias("zero_count"), F.col("p.zero_threshold").alias("zero_threshold"), *halves)


# --- profiles -----------------------------------------------------------------------------------

_FRAMES = "array<struct<frames:array<struct<function_name:string,address:bigint>>>>"
_SAMPLES = "array<struct<stacktrace_index:int,values:array<bigint>,timestamps_unix_nano:array<bigint>>>"


def profiles(wire: DataFrame) -> DataFrame:
    """Wire profiles: the time, ids in hex (an absent profile id is empty, others are null), day and hour."""
    ids = {c: hex_id(c) for c, kind in wire.dtypes if c in ("profile_id", "trace_id", "span_id") and kind == "binary"}
    out = wire.withColumns(ids).withColumn("timestamp_ns", F.coalesce(F.col("time_unix_nano").cast("long"), F.lit(0).cast("long"))).drop("time_unix_nano")
    return _dated(out.withColumn("profile_id", F.coalesce("profile_id", F.lit(""))).withColumn("service_name", F.coalesce(F.nullif("service_name", F.lit("")), F.lit(UNKNOWN))), "timestamp_ns")


def profile_samples(stored: DataFrame) -> DataFrame:
    """``stack`` (root first) and ``value`` of each sample of stored profiles, with their other columns.

    A sample's value is its first, or how many times it was seen; one whose stack is not there is left out.
    """
    from .profiles import frame_name, sample_value

    others = [c for c in stored.columns if c not in ("stacktraces_json", "samples_json", "stack", "value")]
    none = F.array().cast("array<struct<function_name:string,address:bigint>>")
    named = lambda stack: F.transform(F.reverse(F.coalesce(stack["frames"], none)), lambda f: frame_name(f["function_name"], f["address"]))
    # Both texts are read once a profile: a test of a stack after the samples are apart would be copied below them, with all that makes the text.
    read = F.struct(F.from_json("stacktraces_json", _FRAMES).alias("stacks"), F.from_json("samples_json", _SAMPLES).alias("samples"))
    found = lambda r: F.transform(r["samples"], lambda s: F.struct(F.get(r["stacks"], s["stacktrace_index"]).alias("stack"), sample_value(s["values"], s["timestamps_unix_nano"]).alias("value")))
    there = F.filter(once(read, found), lambda s: s["stack"].isNotNull())
    each = F.transform(there, lambda s: F.struct(named(s["stack"]).alias("stack"), s["value"].alias("value")))
    return stored.select(*others, F.explode(each).alias("__s")).select(*others, "__s.stack", "__s.value")


# --- labels -------------------------------------------------------------------------------------


def label_name(key: str) -> str:
    return "label_" + "".join(c if c.isascii() and c.isalnum() else "_" for c in key)


def materialised(frame: DataFrame, keys: list[str], scopes: tuple[str, ...] = _SCOPES) -> DataFrame:
    """A ``label_`` column for each key: of resource, scope and record, the first that has it.

    Values that are no text, in containers that hold JSON text, are told as JSON.
    """
    held = {c: kind for c, kind in frame.dtypes if c in scopes}
    if not held:
        return frame.withColumns({label_name(k): F.lit(None).cast("string") for k in keys})
    value = lambda c, k: F.col(c)[k] if held[c].startswith("map") else F.from_json(c, "map<string,string>")[k]
    return frame.withColumns({label_name(k): F.coalesce(*[value(c, k) for c in scopes if c in held]) for k in keys})


def attr_tokens(frame: DataFrame, scopes: tuple[str, ...] = _SCOPES) -> DataFrame:
    """``attr_tokens``: the different ``key=value`` of all scopes, an empty array if there are none."""
    entries = [F.transform(F.map_entries(empty_map(c)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))) for c in scopes if c in frame.columns]
    return frame.withColumn("attr_tokens", F.array_distinct(F.flatten(F.array(*entries))) if entries else F.array().cast("array<string>"))

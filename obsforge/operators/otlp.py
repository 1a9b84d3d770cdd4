"""OTLP in JSON lines, one export request a line (column ``value``), as the rows that are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .transforms import UNKNOWN, once

#: Values of attributes; arrays and nested values are read as their JSON text.
_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,arrayValue:string,kvlistValue:string,bytesValue:string>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
_RESOURCE = f"resource:struct<attributes:{_ATTRIBUTES}>"
_SCOPE = f"scope:struct<name:string,version:string,attributes:{_ATTRIBUTES}>"


def value_text(v: Column) -> Column:
    """An attribute's value as text: strings as they are, others as JSON."""
    return F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"), v["arrayValue"], v["kvlistValue"], v["bytesValue"])


def attributes(c: str) -> Column:
    """Attributes as a map. Of a repeated key the last counts."""
    some = F.filter(F.coalesce(F.col(c), F.array().cast(_ATTRIBUTES)), lambda a: a["key"].isNotNull())
    last = lambda s: F.filter(s, lambda a, i: ~F.exists(F.slice(s, i + 2, F.size(s)), lambda b: b["key"] == a["key"]))
    return F.map_from_entries(F.transform(once(some, last), lambda a: F.struct(a["key"], value_text(a["value"]))))


def _unfolded(lines: DataFrame, top: str, scopes: str, items: str, item: str, also: str = "") -> DataFrame:
    """``resource_attributes``, ``scope_*``, ``service_name`` and ``x``, a struct, for each item of requests."""
    doc = F.from_json("value", f"struct<{top}:array<struct<{_RESOURCE},{scopes}:array<struct<{_SCOPE},{items}:array<{item}>>>>>{also}>")
    r = lines.select(doc.alias("d")).select(F.col("d"), F.explode(f"d.{top}").alias("r"))
    s = r.select("d", "r.resource", F.explode(f"r.{scopes}").alias("s"))
    x = s.select("d", "resource", "s.scope", F.explode(f"s.{items}").alias("x"))
    out = x.select("x", "d", attributes("resource.attributes").alias("resource_attributes"), attributes("scope.attributes").alias("scope_attributes"), F.col("scope.name").alias("scope_name"), F.col("scope.version").alias("scope_version"))
    return out.withColumn("service_name", F.coalesce(F.col("resource_attributes")["service.name"], F.lit(UNKNOWN)))


def spans(lines: DataFrame) -> DataFrame:
    """A row a span, events as JSON."""
    event = f"struct<timeUnixNano:string,name:string,attributes:{_ATTRIBUTES}>"
    item = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRIBUTES},events:array<{event}>,status:struct<code:int,message:string>>"
    r = _unfolded(lines, "resourceSpans", "scopeSpans", "spans", item)
    told = F.transform(
        F.coalesce("x.events", F.array().cast(f"array<{event}>")),
        lambda e: F.struct(e["name"].alias("name"), e["timeUnixNano"].try_cast("long").alias("timestamp_unix_nano"), F.map_from_entries(F.transform(F.coalesce(e["attributes"], F.array().cast(_ATTRIBUTES)), lambda a: F.struct(a["key"], value_text(a["value"])))).alias("attributes")),
    )
    status = F.element_at(F.array(F.lit("Unspecified"), F.lit("Ok"), F.lit("Error")), F.coalesce("x.status.code", F.lit(0)) + 1)
    kind = F.element_at(F.array(*map(F.lit, ("Unspecified", "Internal", "Server", "Client", "Producer", "Consumer"))), F.coalesce("x.kind", F.lit(0)) + 1)
    out = r.select(
        F.col("x.traceId").alias("trace_id"), F.col("x.spanId").alias("span_id"), F.nullif("x.parentSpanId", F.lit("")).alias("parent_span_id"), F.col("x.name").alias("span_name"), "service_name", "scope_name", "scope_version",
        F.col("x.startTimeUnixNano").try_cast("long").alias("start_ns"), F.col("x.endTimeUnixNano").try_cast("long").alias("end_ns"), kind.alias("span_kind"), status.alias("status_code"), F.col("x.status.code").alias("status_code_number"), F.col("x.status.message").alias("status_message"),
        attributes("x.attributes").alias("span_attributes"), "resource_attributes", "scope_attributes", F.to_json(told).alias("events"),
    )
    return out.withColumns({"duration_nanos": F.col("end_ns") - F.col("start_ns"), "is_root": F.col("parent_span_id").isNull()})


def logs(lines: DataFrame) -> DataFrame:
    """A row a log record; its time, or when it is zero that of observation."""
    item = f"struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:bigint,severityText:string,body:{_VALUE},attributes:{_ATTRIBUTES},traceId:string,spanId:string,flags:bigint>"
    r = _unfolded(lines, "resourceLogs", "scopeLogs", "logRecords", item)
    time, seen = (F.coalesce(F.col(f"x.{c}").try_cast("long"), F.lit(0).cast("long")) for c in ("timeUnixNano", "observedTimeUnixNano"))
    return r.select(
        F.when(time == 0, seen).otherwise(time).alias("timestamp_ns"), seen.alias("observed_timestamp_ns"), "service_name", F.col("x.severityText").alias("severity_text"), F.col("x.severityNumber").alias("severity_number"), value_text(F.col("x.body")).alias("body"),
        F.nullif(F.lower("x.traceId"), F.lit("")).alias("trace_id"), F.nullif(F.lower("x.spanId"), F.lit("")).alias("span_id"), F.col("x.flags").alias("trace_flags"), attributes("x.attributes").alias("log_attributes"), "resource_attributes", "scope_attributes", "scope_name", "scope_version",
    )


_POINT = f"timeUnixNano:string,startTimeUnixNano:string,attributes:{_ATTRIBUTES},flags:bigint"
_SIDE = "struct<offset:int,bucketCounts:array<string>>"
_KINDS = {
    "gauge": f"struct<{_POINT},asDouble:double,asInt:string>",
    "sum": f"struct<{_POINT},asDouble:double,asInt:string>",
    "histogram": f"struct<{_POINT},count:string,sum:double,min:double,max:double,bucketCounts:array<string>,explicitBounds:array<double>>",
    "exponentialHistogram": f"struct<{_POINT},count:string,sum:double,scale:int,zeroCount:string,zeroThreshold:double,positive:{_SIDE},negative:{_SIDE}>",
    "summary": f"struct<{_POINT},count:string,sum:double,quantileValues:array<struct<quantile:double,value:double>>>",
}


def metrics(lines: DataFrame, kind: str) -> DataFrame:
    """A row a data point of the metrics of one kind: ``gauge``, ``sum``, ``histogram``, ``exponentialHistogram`` or ``summary``.

    A number without value is NaN, arrays are JSON text as in storage.
    """
    data = f"struct<dataPoints:array<{_KINDS[kind]}>,aggregationTemporality:int,isMonotonic:boolean>"
    r = _unfolded(lines, "resourceMetrics", "scopeMetrics", "metrics", f"struct<name:string,description:string,unit:string,{kind}:{data}>")
    own = ["service_name", "resource_attributes", "scope_attributes", F.col("x.name").alias("metric_name"), F.col("x.description").alias("description"), F.col("x.unit").alias("unit")]
    each = r.select(*own, F.col(f"x.{kind}.aggregationTemporality").alias("aggregation_temporality"), F.col(f"x.{kind}.isMonotonic").alias("is_monotonic"), F.explode(f"x.{kind}.dataPoints").alias("p"))
    nan, count = F.lit(float("nan")), lambda c: F.col(f"p.{c}").try_cast("long")
    numbers = lambda c: F.to_json(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: v.try_cast("long")))
    values = {
        "number": {"value": F.coalesce("p.asDouble", F.col("p.asInt").try_cast("double"), nan)},
        "histogram": {"count": count("count"), "sum": F.coalesce("p.sum", nan), "min": F.col("p.min"), "max": F.col("p.max"), "bucket_counts": numbers("p.bucketCounts"), "explicit_bounds": F.coalesce(F.to_json("p.explicitBounds"), F.lit("[]"))},
        "exponentialHistogram": {
            "count": count("count"), "sum": F.coalesce("p.sum", nan), "scale": F.col("p.scale"), "zero_count": F.coalesce(count("zeroCount"), F.lit(0)), "zero_threshold": F.coalesce("p.zeroThreshold", F.lit(0.0)),
            "positive_offset": F.col("p.positive.offset"), "positive_bucket_counts": numbers("p.positive.bucketCounts"), "negative_offset": F.col("p.negative.offset"), "negative_bucket_counts": numbers("p.negative.bucketCounts"),
        },
        "summary": {"count": count("count"), "sum": F.coalesce("p.sum", nan), "quantile_values": F.coalesce(F.to_json("p.quantileValues"), F.lit("[]"))},
    }["number" if kind in ("gauge", "sum") else kind]
    extra = ["aggregation_temporality"] * (kind not in ("gauge", "summary")) + ["is_monotonic"] * (kind == "sum")
    return each.select(
        F.col("p.timeUnixNano").try_cast("long").alias("timestamp_ns"), F.col("p.startTimeUnixNano").try_cast("long").alias("start_timestamp_ns"), "metric_name", "service_name", *[v.alias(k) for k, v in values.items()],
        attributes("p.attributes").alias("attributes"), "resource_attributes", "scope_attributes", "description", "unit", F.col("p.flags").alias("flags"), *extra,
    )


def profiles(lines: DataFrame) -> DataFrame:
    """A row a profile, its stacks resolved from the request's tables: leaf first, as JSON, as in storage."""
    dictionary = (
        ",dictionary:struct<stringTable:array<string>,functionTable:array<struct<nameStrindex:int,filenameStrindex:int>>,"
        "locationTable:array<struct<address:string,lines:array<struct<functionIndex:int,line:bigint>>>>,stackTable:array<struct<locationIndices:array<int>>>>"
    )
    item = "struct<profileId:string,timeUnixNano:string,durationNano:string,period:string,sampleType:struct<typeStrindex:int,unitStrindex:int>,samples:array<struct<stackIndex:int,values:array<string>,timestampsUnixNano:array<string>>>>"
    r = _unfolded(lines, "resourceProfiles", "scopeProfiles", "profiles", item, dictionary)
    text = lambda i: F.coalesce(F.get(F.col("d.dictionary.stringTable"), F.coalesce(i, F.lit(0))), F.lit(""))
    # A location inlines functions, the innermost first; without lines it is an address.
    line = lambda ln, address: F.struct(text(F.get(F.col("d.dictionary.functionTable"), F.coalesce(ln["functionIndex"], F.lit(0)))["nameStrindex"]).alias("function_name"), address.alias("address"))
    no_line = F.array(F.lit(None).cast("struct<functionIndex:int,line:bigint>"))
    location = lambda i: F.get(F.col("d.dictionary.locationTable"), i)
    address = lambda i: F.coalesce(location(i)["address"].try_cast("long"), F.lit(0).cast("long"))
    lines_of = lambda i: F.when(F.size(F.coalesce(location(i)["lines"], F.array().cast("array<struct<functionIndex:int,line:bigint>>"))) > 0, location(i)["lines"]).otherwise(no_line)
    frames = lambda stack: F.flatten(F.transform(F.coalesce(stack["locationIndices"], F.array().cast("array<int>")), lambda i: F.transform(lines_of(i), lambda ln: line(ln, address(i)))))
    stacks = F.transform(F.col("d.dictionary.stackTable"), lambda s: F.struct(frames(s).alias("frames")))
    longs = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: v.try_cast("long"))
    samples = F.transform("x.samples", lambda s: F.struct(F.coalesce(s["stackIndex"], F.lit(0)).alias("stacktrace_index"), longs(s["values"]).alias("values"), longs(s["timestampsUnixNano"]).alias("timestamps_unix_nano")))
    return r.select(
        F.coalesce("x.profileId", F.lit("")).alias("profile_id"), F.coalesce(F.col("x.timeUnixNano").try_cast("long"), F.lit(0).cast("long")).alias("timestamp_ns"), F.coalesce(F.col("x.durationNano").try_cast("long"), F.lit(0).cast("long")).alias("duration_nano"), F.col("x.period").try_cast("long").alias("period"),
        text(F.col("x.sampleType.typeStrindex")).alias("sample_type"), text(F.col("x.sampleType.unitStrindex")).alias("sample_unit"), "service_name", "resource_attributes", F.to_json(stacks).alias("stacktraces_json"), F.to_json(samples).alias("samples_json"),
    )

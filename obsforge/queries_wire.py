"""Queries over what arrives on the wire, profiles and discovery, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import histogram
from .operators import otlp, profiles, remote_write, stats, transforms
from .operators.matrix import ACCURACY
from .plans import ir, logql, lowering, promql, registry, tickets, traceql
from .queries import _B, _LQ, _SER, _T, _W, ALL_END, ALL_START, DAY, END, START, _add, _ir, _logql, _prom, _rounded, _ssql, _where
from .sources import signals
from .sources.catalog import Catalog
from .sources.signals import ORACLE


def _json(*parts) -> Column:
    """Text with columns in it: strings are text, columns are put in."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# --- OTLP ---------------------------------------------------------------------------------------

_RESOURCE = '"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"shop"}},{"key":"n","value":{"intValue":"7"}}]}'
_SCOPE = '"scope":{"name":"lib","version":"1"}'


def _otlp_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = signals._events(spark, sf_dir)
    time = F.when(F.col("event_id") % 3 == 0, F.lit("0")).otherwise(F.col("timestamp_ns").cast("string"))
    line = _json(
        '{"resourceLogs":[{', _RESOURCE, ',"scopeLogs":[{', _SCOPE, ',"logRecords":[{"timeUnixNano":"', time, '","observedTimeUnixNano":"', F.col("timestamp_ns"), '","severityNumber":', F.col("event_id") % 24, ',"severityText":"INFO","body":{"stringValue":"', F.col("event_type"),
        '"},"attributes":[{"key":"k","value":{"stringValue":"first"}},{"key":"k","value":{"intValue":"', F.col("event_id"), '"}},{"key":"deep","value":{"arrayValue":{"values":[{"intValue":"1"}]}}}],"traceId":"', F.hex("event_id"), '","spanId":""}]}]}]}',
    )
    return otlp.logs(e.select(line.alias("value"))).select("timestamp_ns", "service_name", "severity_number", "body", "trace_id", "span_id", F.col("log_attributes")["k"].alias("k"), F.col("log_attributes")["deep"].alias("deep"), F.col("resource_attributes")["n"].alias("n"), "scope_name")


_add(
    "s09_logs",
    _otlp_logs,
    "SELECT timestamp_ns, 'shop' AS service_name, event_id % 24 AS severity_number, event_type AS body, lower(printf('%X', event_id)) AS trace_id, NULL::VARCHAR AS span_id, event_id::VARCHAR AS k, '{\"values\":[{\"intValue\":\"1\"}]}' AS deep, '7' AS n, 'lib' AS scope_name FROM ev",
    "logs",
)

_TIMES = lambda t: _json('"timeUnixNano":"', t, '","startTimeUnixNano":"1","attributes":[{"key":"k","value":{"stringValue":"x"}}]')


def _otlp_metrics(kind: str, data, *columns: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        h = signals.metrics_histogram(spark, sf_dir)
        line = _json('{"resourceMetrics":[{', _RESOURCE, ',"scopeMetrics":[{', _SCOPE, ',"metrics":[{"name":"', F.col("service_name"), '","unit":"ms","', kind, '":{"dataPoints":[{', _TIMES(F.col("timestamp_ns")), data(), '}],"aggregationTemporality":2,"isMonotonic":true}},{"name":"other","', "gauge" if kind != "gauge" else "sum", '":{"dataPoints":[{"timeUnixNano":"5","asInt":"1"}]}}]}]}]}')
        return otlp.metrics(h.select(line.alias("value")), kind).select("timestamp_ns", "metric_name", "service_name", F.col("attributes")["k"].alias("k"), "unit", *columns)

    return query


_POINT = "timestamp_ns, service_name AS metric_name, 'shop' AS service_name, 'x' AS k, 'ms' AS unit"
_add(
    "s09_metrics",
    _otlp_metrics("sum", lambda: _json(F.when(F.col("count") % 2 == 0, _json(',"asInt":"', F.col("count"), '"')).otherwise(_json(',"asDouble":', F.col("sum")))), "value", "is_monotonic", "aggregation_temporality"),
    f"SELECT {_POINT}, CASE WHEN cnt % 2 = 0 THEN cnt ELSE total END::DOUBLE AS value, true AS is_monotonic, 2 AS aggregation_temporality FROM hist",
    "hist",
)
_add("s09_metrics_gauge", _otlp_metrics("gauge", lambda: _json(',"asDouble":', F.col("sum")), "value"), f"SELECT {_POINT}, total AS value FROM hist", "hist")
_add(
    "s09_metrics_histogram",
    _otlp_metrics("histogram", lambda: _json(',"count":"', F.col("count"), '","sum":', F.col("sum"), ',"bucketCounts":["', F.regexp_replace(F.expr("substring(bucket_counts, 2, length(bucket_counts) - 2)"), ",", '","'), '"],"explicitBounds":', F.col("explicit_bounds")), "count", "sum", "bucket_counts", "explicit_bounds"),
    f"SELECT {_POINT}, cnt AS count, total AS sum, '[' || concat_ws(',', c0, c1, c2, c3, c4) || ']' AS bucket_counts, '[10.0,20.0,30.0,40.0]' AS explicit_bounds FROM hist",
    "hist",
)
_add(
    "s09_metrics_exponential",
    _otlp_metrics("exponentialHistogram", lambda: _json(',"count":"', F.col("count"), '","scale":3,"zeroCount":"2","positive":{"offset":-1,"bucketCounts":["1","', F.col("count"), '"]}'), "count", "scale", "zero_count", "positive_offset", "positive_bucket_counts", "negative_bucket_counts"),
    f"SELECT {_POINT}, cnt AS count, 3 AS scale, 2 AS zero_count, -1 AS positive_offset, '[1,' || cnt || ']' AS positive_bucket_counts, '[]' AS negative_bucket_counts FROM hist",
    "hist",
)
_add(
    "s09_metrics_summary",
    _otlp_metrics("summary", lambda: _json(',"count":"', F.col("count"), '","sum":', F.col("sum"), ',"quantileValues":[{"quantile":0.5,"value":', F.col("sum"), "}]"), "count", "quantile_values"),
    f"SELECT {_POINT}, cnt AS count, '[{{\"quantile\":0.5,\"value\":' || total || '}}]' AS quantile_values FROM hist",
    "hist",
)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals._read(spark, sf_dir, "orders")


def _otlp_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile an order: its stack a location with an inlined function, one by address and one unknown."""
    key = F.col("o_orderkey")
    line = _json(
        '{"resourceProfiles":[{', _RESOURCE, ',"scopeProfiles":[{', _SCOPE, ',"profiles":[{"profileId":"', F.lower(F.hex(key)), '","timeUnixNano":"', key, '","durationNano":"5","sampleType":{"typeStrindex":1,"unitStrindex":2},"samples":[{"stackIndex":1,"values":["', key % 100 + 1, '"]},{"stackIndex":1,"timestampsUnixNano":["1","2"]}]}]}]}]',
        ',"dictionary":{"stringTable":["","cpu","ns","work","', F.col("o_orderpriority"), '"],"functionTable":[{},{"nameStrindex":3},{"nameStrindex":4}],"locationTable":[{},{"lines":[{"functionIndex":1},{"functionIndex":2}]},{"address":"255"},{"address":"0"}],"stackTable":[{},{"locationIndices":[1,2,3]}]}}',
    )
    stored = otlp.profiles(_orders(spark, sf_dir).select(line.alias("value")))
    each = transforms.profile_samples(stored)
    return each.groupBy("service_name", "sample_type", "sample_unit", F.concat_ws("/", "stack").alias("stack")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("profile_id").alias("first_id"), F.max("timestamp_ns").alias("newest_ns"))


_add(
    "s09_profiles",
    _otlp_profiles,
    "SELECT 'shop' AS service_name, 'cpu' AS sample_type, 'ns' AS sample_unit, '<unknown>/0xff/' || o_orderpriority || '/work' AS stack, 2 * count(*) AS n, sum(o_orderkey % 100 + 3)::BIGINT AS total, min(lower(printf('%X', o_orderkey))) AS first_id, max(o_orderkey) AS newest_ns"
    " FROM orders GROUP BY o_orderpriority",
)

# --- metric points ------------------------------------------------------------------------------


def _wire_points(spark: SparkSession, sf_dir: str, data: Column) -> DataFrame:
    h = signals.metrics_histogram(spark, sf_dir)
    service = F.when(F.col("count") % 2 == 0, F.col("service_name"))
    return h.select(F.lit("m").alias("metric_name"), service.alias("service_name"), F.lit("ms").alias("unit"), data.alias("data_json"))


def _at(*more) -> Column:
    return _json('[{"time_unix_nano":', F.col("timestamp_ns"), ',"attributes":{"k":"x"}', *more, "}]")


_WIRE = "timestamp_ns, 'm' AS metric_name, CASE WHEN cnt % 2 = 0 THEN service_name ELSE 'unknown' END AS service_name, 'x' AS k, 'ms' AS unit"
_kept = lambda: ("timestamp_ns", "metric_name", "service_name", F.col("attributes")["k"].alias("k"), "unit")
_add(
    "t03_histogram",
    lambda s, d: transforms.histogram_points(_wire_points(s, d, _at(',"count":', F.col("count"), ',"min":1.5,"bucket_counts":', F.col("bucket_counts"), ',"explicit_bounds":[10,20,30,40]'))).select(*_kept(), "count", "sum", "min", "max", "bucket_counts", "explicit_bounds"),
    f"SELECT {_WIRE}, cnt AS count, 'nan'::DOUBLE AS sum, 1.5::DOUBLE AS min, NULL::DOUBLE AS max, '[' || concat_ws(',', c0, c1, c2, c3, c4) || ']' AS bucket_counts, '[10.0,20.0,30.0,40.0]' AS explicit_bounds"
    f" FROM hist",
    "hist",
)
_add(
    "t03_summary",
    lambda s, d: transforms.summary_points(_wire_points(s, d, _at(',"count":', F.col("count"), ',"sum":', F.col("sum"), ',"quantile_values":[{"quantile":0.9,"value":2.5}]'))).select(*_kept(), "count", "sum", "quantile_values"),
    f"SELECT {_WIRE}, cnt AS count, total AS sum, '[{{\"quantile\":0.9,\"value\":2.5}}]' AS quantile_values FROM hist",
    "hist",
)
_add(
    "t03_exponential",
    lambda s, d: transforms.exponential_points(_wire_points(s, d, _at(',"count":', F.col("count"), ',"sum":1.0,"scale":-2,"zero_count":4,"positive":{"offset":3,"bucket_counts":', F.col("bucket_counts"), "}"))).select(*_kept(), "count", "scale", "zero_count", "positive_offset", "positive_bucket_counts", "negative_bucket_counts"),
    f"SELECT {_WIRE}, cnt AS count, -2 AS scale, 4 AS zero_count, 3 AS positive_offset, '[' || concat_ws(',', c0, c1, c2, c3, c4) || ']' AS positive_bucket_counts, '[]' AS negative_bucket_counts"
    f" FROM hist",
    "hist",
)
_add(
    "t04_missing_value",
    lambda s, d: transforms.number_points(_wire_points(s, d, _at(F.when(F.col("count") % 3 == 0, _json(',"value":', F.col("sum"))).otherwise("")))).select(*_kept(), "value"),
    f"SELECT {_WIRE}, CASE WHEN cnt % 3 = 0 THEN total ELSE 'nan'::DOUBLE END AS value FROM hist",
    "hist",
)
_add(
    "t02_hours",
    lambda s, d: transforms.logs(signals._events(s, d).select("event_id", (F.col("timestamp_ns") - F.col("timestamp_ns") % F.lit(DAY // 24) + F.lit(DAY // 24 - 1)).alias("time_unix_nano"), F.lit(0).cast("long").alias("observed_time_unix_nano"))).select("event_id", F.col("hour").cast("long").alias("hour"), F.date_format("date_day", "yyyy-MM-dd").alias("day")),
    "SELECT event_id, hour(make_timestamp(timestamp_ns // 1000)) AS hour, strftime(make_timestamp(timestamp_ns // 1000), '%Y-%m-%d') AS day FROM ev",
    "logs",
)

# --- remote write -------------------------------------------------------------------------------


def _two_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each histogram as two series that differ in a label, one with twice the counts."""
    h = signals.metrics_histogram(spark, sf_dir).withColumn("c", histogram.running(histogram.number_array(F.col("bucket_counts"))))
    le = F.array(*[F.lit(str(b)) for b in signals.BOUNDS], F.lit("+Inf"))
    each = h.select("timestamp_ns", "service_name", F.explode(F.arrays_zip(le.alias("le"), F.col("c").alias("v"))).alias("x"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("path"))
    samples = each.select("timestamp_ns", F.lit("quantity_bucket").alias("metric_name"), "service_name", F.create_map(F.lit("le"), F.col("x.le"), F.lit("path"), F.col("path")).alias("attributes"), (F.col("x.v") * F.when(F.col("path") == "b", 2).otherwise(1)).alias("value"))
    return remote_write.classic_histograms(samples).select("timestamp_ns", "metric_name", "service_name", F.col("attributes")["path"].alias("path"), "count", "bucket_counts", "explicit_bounds")


_add(
    "s11_two_series",
    _two_series,
    "SELECT timestamp_ns, 'quantity' AS metric_name, service_name, path, cnt * f AS count, '[' || concat_ws(',', c0 * f, c1 * f, c2 * f, c3 * f, c4 * f) || ']' AS bucket_counts, '[10.0,20.0,30.0,40.0]' AS explicit_bounds"
    " FROM hist, (VALUES ('a', 1), ('b', 2)) p(path, f)",
    "hist",
)


def _native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native histograms with a gap between spans, some with float counts, some whose spans do not fit."""
    h = signals.metrics_histogram(spark, sf_dir).withColumn("c", histogram.number_array(F.col("bucket_counts")))
    span = lambda o, n: F.struct(F.lit(o).alias("offset"), F.lit(n).alias("length"))
    whole = F.transform("c", lambda x: x.cast("long"))
    deltas = F.transform(whole, lambda x, i: x - F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(whole, i - 1)))
    kind = F.col("count") % 3
    rows = h.select(
        "timestamp_ns", F.lit("native").alias("metric_name"), "service_name", F.when(kind == 2, 99).otherwise(2).alias("schema"), "count", "sum", F.lit(1).cast("long").alias("zero_count"), F.lit(0.5).alias("zero_threshold"),
        F.array(span(4, 2), span(3, 3)).alias("positive_spans"), F.when(kind == 0, deltas).alias("positive_deltas"), F.when(kind == 1, F.col("c")).alias("positive_counts"),
        F.when(F.col("count") % 5 == 0, F.array(span(0, 1))).alias("negative_spans"), F.when(F.col("count") % 5 == 0, F.when(F.col("count") % 2 == 0, F.array(F.lit(3).cast("long"))).otherwise(F.array(F.lit(-3).cast("long")))).alias("negative_deltas"), F.lit(None).cast("array<double>").alias("negative_counts"),
    )
    return remote_write.native_histograms(rows).select("timestamp_ns", "service_name", "count", "scale", "positive_offset", "positive_bucket_counts", "negative_offset", "negative_bucket_counts")


_add(
    "s12_native",
    _native,
    "SELECT timestamp_ns, service_name, cnt AS count, 2 AS scale, 3 AS positive_offset, '[' || concat_ws(',', c0, c1, 0, 0, 0, c2, c3, c4) || ']' AS positive_bucket_counts,"
    " CASE WHEN cnt % 5 = 0 THEN -1 END AS negative_offset, CASE WHEN cnt % 5 = 0 THEN '[3]' ELSE '[]' END AS negative_bucket_counts FROM hist"
    " WHERE cnt % 3 <> 2 AND NOT (cnt % 5 = 0 AND cnt % 2 = 1)",
    "hist",
)


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = signals.metrics_histogram(spark, sf_dir)
    label = lambda q: F.create_map(F.lit("path"), F.lit("/"), *([F.lit("quantile"), F.lit(q)] if q else []))
    parts = F.array(*[F.struct(F.lit(f"latency{suffix}").alias("metric_name"), label(q).alias("attributes"), value.cast("double").alias("value")) for suffix, q, value in (("", "0.9", F.col("sum")), ("", "0.5", F.col("sum") / 2), ("_count", None, F.col("count")), ("_sum", None, F.col("sum") * 3), ("_created", None, F.lit(9)))])
    samples = h.select("timestamp_ns", "service_name", F.explode(parts).alias("p")).select("timestamp_ns", "service_name", "p.*")
    return remote_write.summaries(samples).select("timestamp_ns", "metric_name", "service_name", F.col("attributes")["path"].alias("path"), "count", F.round("sum", 4).alias("sum"), F.from_json("quantile_values", "array<struct<quantile:double,value:double>>").alias("q")).select("timestamp_ns", "metric_name", "service_name", "path", "count", "sum", F.get("q", F.lit(0))["quantile"].alias("low"), F.round(F.get("q", F.lit(0))["value"], 4).alias("low_value"), F.round(F.get("q", F.lit(1))["value"], 4).alias("high_value"), F.size("q").cast("long").alias("n"))


_add(
    "s12_summary",
    _summaries,
    "SELECT timestamp_ns, 'latency' AS metric_name, service_name, '/' AS path, cnt AS count, round(total * 3, 4) AS sum, 0.5::DOUBLE AS low"
    ", round(total / 2, 4) AS low_value, round(total, 4) AS high_value, 2 AS n FROM hist",
    "hist",
)

# --- profiles -----------------------------------------------------------------------------------


def stored_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored profile an order, out of a wire row with binary ids."""
    n = signals._read(spark, sf_dir, "nation")
    o = _orders(spark, sf_dir).join(signals._read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.unhex(F.lpad(F.hex("o_orderkey"), 32, "0"))
    stacks = _json('[{"frames":[{"function_name":"', F.col("o_orderpriority"), '"},{"function_name":"', F.col("c_mktsegment"), '"},{"function_name":"main"}]}]')
    wire = o.select(
        key.alias("profile_id"), signals._ns("o_orderdate").alias("time_unix_nano"), F.lit(1000).cast("long").alias("duration_nano"), F.when(F.col("o_orderstatus") == "P", "alloc").otherwise("cpu").alias("sample_type"), F.when(F.col("o_orderstatus") == "P", "bytes").otherwise("count").alias("sample_unit"), F.lit(1).cast("long").alias("period"),
        F.when(F.col("n_nationkey") > 0, F.col("n_name")).otherwise("").alias("service_name"), key.alias("trace_id"), F.lit(b"").alias("span_id"), stacks.alias("stacktraces_json"),
        _json('[{"stacktrace_index":0,"values":[', F.col("o_orderkey") % 10, ']},{"stacktrace_index":9,"values":[1]}]').alias("samples_json"), F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("attributes"),
    )
    return transforms.profiles(wire)


_PROF = """prof AS (SELECT lpad(lower(printf('%X', o_orderkey)), 32, '0') AS profile_id, epoch_us(o_orderdate)*1000 AS timestamp_ns, CASE WHEN o_orderstatus = 'P' THEN 'alloc' ELSE 'cpu' END AS sample_type, CASE WHEN o_orderstatus = 'P' THEN 'bytes' ELSE 'count' END AS sample_unit,
  CASE WHEN n_nationkey > 0 THEN n_name ELSE 'unknown' END AS service_name, c_mktsegment AS segment, o_orderpriority AS priority, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def _profile(name: str, query, sql: str) -> None:
    _add(name, query, f"WITH {_PROF} {sql}")


_profile(
    "t07_profiles",
    lambda s, d: stored_profiles(s, d).select("profile_id", "timestamp_ns", "sample_type", "service_name", "trace_id", "span_id", F.date_format("date_day", "yyyy-MM-dd").alias("day"), F.col("hour").cast("long").alias("hour")),
    "SELECT profile_id, timestamp_ns, sample_type, service_name, profile_id AS trace_id, NULL::VARCHAR AS span_id, strftime(make_timestamp(timestamp_ns // 1000), '%Y-%m-%d') AS day, hour(make_timestamp(timestamp_ns // 1000)) AS hour"
    " FROM prof",
)
_profile(
    "f01_search",
    lambda s, d: profiles.search(stored_profiles(s, d), ALL_START, ALL_END, "FRANCE", "cpu", 50).select("profile_id", "timestamp_ns", "service_name", "sample_unit"),
    f"SELECT profile_id, timestamp_ns, service_name, sample_unit FROM prof WHERE service_name = 'FRANCE' AND sample_type = 'cpu'"
    f" AND timestamp_ns BETWEEN {ALL_START} AND {ALL_END} ORDER BY timestamp_ns DESC, profile_id LIMIT 50",
)
_profile(
    "f01_by_id",
    lambda s, d: profiles.by_id(stored_profiles(s, d), "0" * 31 + "7").select("profile_id", "timestamp_ns", "service_name"),
    "SELECT profile_id, timestamp_ns, service_name FROM prof WHERE profile_id = '00000000000000000000000000000007'",
)
_profile(
    "f01_by_trace",
    lambda s, d: profiles.by_trace(stored_profiles(s, d), "0" * 30 + "2A").select("profile_id", "timestamp_ns", "trace_id"),
    "SELECT profile_id, timestamp_ns, profile_id AS trace_id FROM prof WHERE profile_id = '0000000000000000000000000000002a'",
)
_profile("f02_profile_types", lambda s, d: profiles.types(stored_profiles(s, d)), "SELECT DISTINCT sample_type || ':' || sample_unit AS profile_type FROM prof")
_profile(
    "f03_label_names",
    lambda s, d: profiles.label_names(stored_profiles(s, d), ALL_START, ALL_END),
    "SELECT 'service_name' AS label UNION SELECT 'segment' FROM prof",
)
_profile("f03_label_values", lambda s, d: profiles.label_values(stored_profiles(s, d), "segment"), "SELECT DISTINCT segment AS value FROM prof")
_profile("f03_services", lambda s, d: profiles.label_values(stored_profiles(s, d), "service_name"), "SELECT DISTINCT service_name AS value FROM prof")
_profile(
    "f04_stored",
    lambda s, d: profiles.prefixes(transforms.profile_samples(stored_profiles(s, d))).select(F.concat_ws("/", "path").alias("path"), F.col("depth").cast("long").alias("depth"), "total", "self"),
    "SELECT array_to_string(st[1:n], '/') AS path, n AS depth, sum(v)::BIGINT AS total, coalesce(sum(v) FILTER (n = 3), 0)::BIGINT AS self FROM (SELECT ['main', segment, priority] AS st, o_orderkey % 10 AS v FROM prof WHERE o_orderkey % 10 > 0), (SELECT unnest(range(1, 4)) AS n) GROUP BY 1, 2",
)


def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelope of a flame graph over more rows than it takes: totals of each name, and that it was cut."""
    c = Catalog()
    c.add("acme", "prod", "profiles", lambda: stored_profiles(spark, sf_dir))
    doc = {"irVersion": 1, "from": "profiles", "range": {"from": ALL_START, "to": ALL_END}, "result": "flamegraph", "pipeline": [{"where": {"field": "sample.type", "op": "eq", "value": "cpu"}}]}
    graph = ir.envelope(ir.run(doc, c))["flamegraph"]
    totals: dict[str, int] = {}
    for level in graph["levels"]:
        for k in range(0, len(level), 4):
            name = graph["names"][level[k + 3]]
            totals[name] = totals.get(name, 0) + level[k + 1]
    return spark.createDataFrame([(n, t, graph["truncated"]) for n, t in totals.items()], "name string, total long, truncated boolean")


_profile("f08_capped_flamegraph", _capped, """, top AS (SELECT * FROM prof WHERE sample_type = 'cpu' ORDER BY timestamp_ns DESC, profile_id, service_name LIMIT 1000), n AS (SELECT o_orderkey % 10 AS v, segment, priority FROM top WHERE o_orderkey % 10 > 0), t AS (SELECT (SELECT count(*) FROM prof WHERE sample_type = 'cpu') > 1000 AS truncated)
SELECT name, sum(v)::BIGINT AS total, any_value(truncated) AS truncated FROM (SELECT unnest(['total', 'main', segment, priority]) AS name, v FROM n), t GROUP BY 1""")

# --- discovery ----------------------------------------------------------------------------------

_add(
    "m35_series",
    lambda s, d: promql.series(signals.catalog(s, d), '{service=~"svc-[0-4]", __name__=~"^v"}', START, END),
    f"SELECT DISTINCT metric_name, service_name FROM metrics WHERE {_W} AND regexp_matches(service_name, 'svc-[0-4]') AND metric_name LIKE 'v%'",
    "metrics",
)
_add(
    "m36_label_stats",
    lambda s, d: promql.label_stats(signals.catalog(s, d), START, END).withColumn("presence", F.round("presence", 4)),
    f"WITH {ORACLE['metrics']}, a AS (SELECT k, env FROM ev WHERE {_W} UNION ALL SELECT k, env FROM ev"
    f" WHERE {_W}) SELECT 'k' AS name, count(DISTINCT k) AS distinct_estimate, round(count(k) / count(*), 4) AS presence, false AS capped FROM a"
    f" UNION ALL SELECT 'deployment.environment', count(DISTINCT env), round(count(env) / count(*), 4), false FROM a",
)
_add(
    "l22_labels",
    lambda s, d: logql.labels(signals.catalog(s, d), START, END),
    f"SELECT unnest(['detected_level', 'level', 'service_name', 'span_id', 'trace_id']) AS label UNION SELECT 'event.type' {_LQ} UNION SELECT 'k' {_LQ}"
    f" AND k IS NOT NULL UNION SELECT 'deployment.environment' {_LQ} AND env IS NOT NULL",
    "logs",
)
_add(
    "l22_series",
    lambda s, d: logql.series(signals.catalog(s, d), '{job=~"svc-[0-4]", level!="INFO"}', START, END),
    f"SELECT DISTINCT service_name, severity_text AS level {_LQ} AND regexp_matches(service_name, 'svc-[0-4]') AND severity_text <> 'INFO'",
    "logs",
)
_add(
    "l25_instant",
    lambda s, d: logql.query(signals.catalog(s, d), '{service_name=~".+"} |= "e"', END, 50).select("timestamp_ns", "service_name", "body", "span_id"),
    f"SELECT timestamp_ns, service_name, body, span_id FROM logs WHERE timestamp_ns BETWEEN {END - DAY // 24} AND {END} AND contains(body, 'e')"
    f" ORDER BY timestamp_ns DESC, body, span_id LIMIT 50",
    "logs",
)
_add(
    "l02_forward",
    lambda s, d: logql.lines(signals.catalog(s, d), '{service_name="svc-1"} != "view"', START, END, 40, forward=True).select("timestamp_ns", "severity_text", "span_id"),
    f"SELECT timestamp_ns, severity_text, span_id FROM logs WHERE {_W} AND service_name = 'svc-1' AND NOT contains(body, 'view')"
    f" ORDER BY timestamp_ns, body, span_id LIMIT 40",
    "logs",
)
_add(
    "l21_chain",
    _logql('topk(2, label_replace(sum by (job) (count_over_time({job=~".+"}[1d])) * 2 + 1, "team", "t$1", "job", "svc-([0-4])"))'),
    f"SELECT {_B} AS bucket_ns, service_name, CASE"
    f" WHEN regexp_full_match(service_name, 'svc-([0-4])') THEN 't' || substr(service_name, 5) END AS team, (count(*) * 2 + 1)::DOUBLE AS value {_LQ}"
    f" GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY {_B} ORDER BY count(*) DESC, service_name) <= 2",
    "logs",
)
_add(
    "l16_ignoring",
    _logql('count_over_time({level="ERROR"}[1d]) / ignoring(level) sum by (job) (count_over_time({job=~".+"}[1d]))'),
    f"SELECT e.bucket_ns, e.service_name, 'ERROR' AS severity_text, round(e.n / a.n + 1e-7, 4) + 0.0 AS value"
    f" FROM (SELECT {_B} AS bucket_ns, service_name, count(*) AS n {_LQ} AND severity_text = 'ERROR' GROUP BY 1, 2) e"
    f" JOIN (SELECT {_B} AS bucket_ns, service_name, count(*) AS n {_LQ} GROUP BY 1, 2) a USING (bucket_ns, service_name)",
    "logs",
)
_add(
    "r08_tag_names",
    lambda s, d: traceql.tag_names(signals.catalog(s, d), ALL_START, ALL_END),
    "SELECT 'intrinsic' AS scope, unnest(['duration', 'kind', 'name', 'rootName', 'rootServiceName', 'service.name', 'status', 'traceDuration']) AS tag"
    " UNION SELECT 'span', unnest(['order.priority', 'part']) FROM traces UNION SELECT 'resource', 'service.name' FROM traces",
    "traces",
)
_add(
    "r04_seconds",
    lambda s, d: traceql.search(signals.catalog(s, d), traceql.parse('{ service.name = "shop" }'), *traceql.bounds(ALL_START // 10**9, ALL_END // 10**9), 10),
    _ssql("service_name = 'shop'", 10),
    "traces",
)
_add(
    "d03_sources",
    lambda s, d: s.createDataFrame([(x["source"], x["available"]) for x in ir.sources(_only(signals.catalog(s, d), "logs", "metrics_sum", "profiles"))], "source string, available boolean"),
    "SELECT unnest(['logs', 'traces', 'metrics', 'metrics_histogram', 'profiles']) AS source, unnest([true, false, true, false, true]) AS available",
)


def _only(catalog: Catalog, *tables: str) -> Catalog:
    some = Catalog()
    for t in tables:
        some.add("acme", "prod", t, lambda t=t: catalog.find("acme", "prod", t))
    return some


def _described(spec: dict, source: str = "logs"):
    doc = {"irVersion": 4, "from": source, "range": {"from": START, "to": END}, "result": "metadata", "pipeline": [{"describe": spec}]}
    return lambda s, d: ir.require(ir.run(doc, signals.catalog(s, d)))


_add(
    "d02_sketch",
    _described({"target": "values", "field": "event.type", "limit": 3}),
    f"SELECT event_type AS value, count(*) AS count, 'sketch' AS origin {_LQ} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
    "logs",
)
_add(
    "d02_declared",
    _described({"target": "values", "field": "span.kind"}, "traces"),
    "SELECT unnest(['Client', 'Consumer', 'Internal', 'Producer', 'Server', 'Unspecified']) AS value, NULL::BIGINT AS count, 'declared' AS origin",
)
_add(
    "d02_sample",
    _described({"target": "values", "field": "severity_text", "limit": 2, "sample": True}),
    f"SELECT severity_text AS value, count(*) AS count, 'sample' AS origin {_LQ} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2",
    "logs",
)
_add(
    "d02_hint",
    lambda s, d: stats.describe_values(stats.attribute_stats(signals.logs(s, d), ("log_attributes",), cap=10), "k"),
    "SELECT NULL::VARCHAR AS value, 10 AS count, 'hint' AS origin",
)


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    conventions = registry.resolve({"namespace": "test", "groups": [{"id": "g", "type": "attribute_group", "attributes": [{"id": "deployment.environment", "type": "string"}, {"id": "k", "type": "int"}, {"id": "body", "type": "any"}]}]})
    logs = signals.logs(spark, sf_dir)
    found = stats.attribute_stats(logs, ("log_attributes", "resource_attributes"))
    return stats.describe_fields(found, {"body": "string", "severity_number": "int64"}, logs.count(), conventions.attribute_frame(spark)).withColumn("coverage", F.round("coverage", 4))


_add(
    "d01_describe_fields",
    _fields,
    "SELECT 'body' AS name, 'string' AS type, 'declared' AS origin, NULL::DOUBLE AS coverage UNION ALL SELECT 'severity_number', 'int64', 'declared', NULL"
    " UNION ALL SELECT 'k', 'int', 'registry', round(count(k) / count(*), 4) FROM logs UNION ALL SELECT 'event.type', 'string', 'observed', 1.0::DOUBLE"
    " UNION ALL SELECT 'deployment.environment', 'string', 'registry', round(count(env) / count(*), 4) FROM logs",
    "logs",
)


def _conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry with a group for each region, whose entities extend one that is common and have their nations as attributes."""
    n = signals._read(spark, sf_dir, "nation").join(signals._read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name").collect()
    groups = [{"id": "attrs", "type": "attribute_group", "attributes": [{"id": "host", "type": "string"}, *[{"id": r.n_name, "type": {"members": [{"value": 1}]}} for r in n]]}, {"id": "base", "type": "entity", "name": "base", "attributes": [{"ref": "host", "role": "identifying", "requirement_level": "required"}]}]
    groups += [{"id": f"e.{r}", "type": "entity", "name": r, "extends": "base", "attributes": [{"ref": x.n_name} for x in n if x.r_name == r]} for r in sorted({x.r_name for x in n})]
    return registry.resolve({"namespace": "test", "groups": groups}).entity_frame(spark)


_add(
    "as6_registry",
    _conventions,
    "SELECT r_name AS entity, n_name AS attribute, 'descriptive' AS role, NULL::VARCHAR AS level FROM nation JOIN region ON n_regionkey = r_regionkey"
    " UNION ALL SELECT r_name, 'host', 'identifying', 'required' FROM region UNION ALL SELECT 'base', 'host', 'identifying', 'required'",
)


def _promotions(materialized: tuple[str, ...], pinned: tuple[str, ...], **more):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        logs = signals.logs(spark, sf_dir)
        demand = spark.createDataFrame([("k", 50), ("event.type", 20), ("deployment.environment", 5), ("gone", 99)], "key string, hits long")
        streaks = spark.createDataFrame([("k", 2), ("event.type", 1), ("deployment.environment", 7)], "key string, streak int")
        found = stats.promotion(stats.attribute_stats(logs, ("log_attributes", "resource_attributes")), demand, logs.count(), materialized, pinned, streaks, **more)
        return found.withColumns({c: F.round(c, 4) for c in ("presence", "score")}).withColumn("streak", F.col("streak").cast("long"))

    return query


_add(
    "as2_promotion",
    _promotions((), (), min_streak=3),
    "SELECT 'k' AS key, 50 AS hits, round(count(k) / count(*), 4) AS presence"
    ", round(50 * count(k) / count(*), 4) AS score, 3 AS streak, 'promote' AS decision FROM logs"
    " UNION ALL SELECT 'event.type', 20, 1.0::DOUBLE, 20.0::DOUBLE, 2, 'building' UNION ALL SELECT 'deployment.environment', 5"
    ", round(count(env) / count(*), 4), round(5 * count(env) / count(*), 4), 0, 'none' FROM logs",
    "logs",
)
_add(
    "as2_demotion",
    _promotions(("idle", "kept", "event.type"), ("kept",), budget=4),
    "SELECT 'k' AS key, 50 AS hits, round(count(k) / count(*), 4) AS presence"
    ", round(50 * count(k) / count(*), 4) AS score, 3 AS streak, 'promote' AS decision FROM logs"
    " UNION ALL SELECT 'event.type', 20, 1.0::DOUBLE, 20.0::DOUBLE, 0, 'keep' UNION ALL SELECT 'deployment.environment', 5, round(count(env) / count(*), 4)"
    ", round(5 * count(env) / count(*), 4), 0, 'none' FROM logs UNION ALL SELECT 'idle', 0, 0.0::DOUBLE, 0.0::DOUBLE, 0, 'demote'"
    " UNION ALL SELECT 'kept', 0, 0.0::DOUBLE, 0.0::DOUBLE, 0, 'keep'",
    "logs",
)

# --- other forms of the same queries --------------------------------------------------------------

_add(
    "a06_exact_quantile",
    lambda s, d: ir.require(ir.run({"irVersion": 5, "from": "logs", "range": {"from": START, "to": END}, "result": "table", "pipeline": [{"aggregate": {"by": ["service.name", "deployment.environment"], "aggs": [{"fn": "quantile", "of": "duration", "arg": 0.95, "as": "v"}, {"fn": "count", "as": "n"}]}}]}, signals.catalog(s, d), exact=True)).withColumn("v", F.round("v", 4)),
    f"SELECT service_name, env AS deployment_environment, round(quantile_cont(duration, 0.95), 4) AS v, count(*) AS n FROM logs WHERE {_W} GROUP BY 1, 2",
    "logs",
)


def _rank_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much the rank of an approximate quantile is off, as a share of its group: within the promised bound."""
    found = _ir("logs", [{"aggregate": {"by": ["service.name"], "aggs": [{"fn": "quantile", "of": "duration", "arg": 0.9, "as": "v"}]}}], "table")(spark, sf_dir)
    rows = signals.logs(spark, sf_dir).where(F.col("timestamp_ns").between(START, END)).join(found, "service_name")
    ranks = rows.groupBy("service_name").agg(F.count_if(F.col("duration") < F.col("v")).alias("below"), F.count_if(F.col("duration") <= F.col("v")).alias("upto"), F.count("duration").alias("n"))
    near = (F.col("below") <= 0.9 * F.col("n") + 1 + F.col("n") / ACCURACY) & (F.col("upto") >= 0.9 * F.col("n") - 1 - F.col("n") / ACCURACY)
    return ranks.select("service_name", "n", near.alias("within_bound"))


_add("a06_rank_error", _rank_error, f"SELECT service_name, count(duration) AS n, true AS within_bound FROM logs WHERE {_W} GROUP BY 1", "logs")
_add(
    "m13_by_nothing",
    _prom("max(view) - min(view)"),
    f"SELECT bucket_ns, round(hi - lo + 1e-7, 4) + 0.0 AS value FROM (SELECT {_B} AS bucket_ns, max(value) AS hi, min(value) AS lo FROM metrics WHERE {_W}"
    f" AND metric_name = 'view' GROUP BY 1)",
    "metrics",
)
_add(
    "m16_fractions",
    _prom('count_values("v", floor(view) / 4 + 0.125)'),
    f"SELECT bucket_ns, (floor(value) / 4 + 0.125)::VARCHAR AS service_name, count(*)::DOUBLE AS value"
    f" FROM (SELECT {_B} AS bucket_ns, {_SER}, arg_max(value, timestamp_ns) AS value FROM metrics WHERE {_W} AND metric_name = 'view' GROUP BY ALL)"
    f" GROUP BY 1, 2",
    "metrics",
)
_add(
    "m27_scalar_nan",
    _prom("scalar(sum by (service) (view))"),
    f"SELECT {_B} AS bucket_ns, '' AS metric_name, '' AS service_name, CASE"
    f" WHEN count(DISTINCT service_name) = 1 THEN round(sum(value) + 1e-7, 4) + 0.0 ELSE 'nan'::DOUBLE END AS value FROM metrics WHERE {_W}"
    f" AND metric_name = 'view' GROUP BY 1",
    "metrics",
)

_RISE = f"""SELECT * FROM (SELECT timestamp_ns - timestamp_ns % {DAY * 30} AS bucket_ns, service_name, {', '.join(f'greatest(arg_max(c{i}, timestamp_ns) - arg_min(c{i}, timestamp_ns), 0)::DOUBLE AS c{i}' for i in range(5))} FROM hist WHERE timestamp_ns BETWEEN {ALL_START} AND {ALL_END} GROUP BY 1, 2)"""
_RQ = f"""q AS (SELECT *, c0+c1+c2+c3+c4 AS t, 0.7*(c0+c1+c2+c3+c4) AS r FROM ({_RISE}))"""
_RV = "round(CASE WHEN t <= 0 THEN 'nan'::DOUBLE WHEN c0 >= r THEN 10*r/c0 WHEN c0+c1 >= r THEN 10+10*(r-c0)/c1 WHEN c0+c1+c2 >= r THEN 20+10*(r-c0-c1)/c2 WHEN c0+c1+c2+c3 >= r THEN 30+10*(r-c0-c1-c2)/c3 ELSE 40 END + 1e-7, 4) + 0.0"
_WIDE = {"step": DAY * 30, "start": ALL_START, "end": ALL_END}
_add(
    "m31_rate",
    _prom("histogram_quantile(0.7, rate(quantity[30d]))", **_WIDE),
    f"WITH {ORACLE['hist']}, {_RQ} SELECT bucket_ns, 'quantity' AS metric_name, service_name, {_RV} AS value FROM q",
)
_add(
    "a15_rate",
    lambda s, d: _ir("metrics_histogram", [{"histogram_quantile": {"phi": 0.7, "by": ["service.name"], "step": "30d", "mode": "rate"}}], "series", start=ALL_START, end=ALL_END)(s, d).withColumn("value", _rounded("value")),
    f"WITH {ORACLE['hist']}, {_RQ} SELECT bucket_ns, 'quantity' AS metric_name, service_name, {_RV} AS value FROM q",
)
_add(
    "a13_limit",
    _ir("logs", [{"aggregate": {"by": ["service.name"], "aggs": [{"fn": "count", "as": "n"}]}}, {"order": [{"of": "n"}, {"of": "service.name"}]}, {"limit": 3}], "table"),
    f"SELECT service_name, count(*) AS n FROM logs WHERE {_W} GROUP BY 1 ORDER BY 2, 1 LIMIT 3",
    "logs",
)


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauges with attributes in a map, sums with theirs as JSON text, as older files have them."""
    c = Catalog()
    c.add("acme", "prod", "metrics_gauge", lambda: signals.metrics_gauge(spark, sf_dir))
    c.add("acme", "prod", "metrics_sum", lambda: signals.metrics_sum(spark, sf_dir).withColumns({m: F.to_json(m) for m in ("attributes", "resource_attributes")}))
    doc = {"irVersion": 5, "from": "metrics", "range": {"from": START, "to": END}, "result": "table", "pipeline": [_where("k", "lt", 20), {"aggregate": {"by": ["metric.name", "deployment.environment"], "aggs": [{"fn": "count", "as": "n"}]}}]}
    return ir.require(ir.run(doc, c))


_add(
    "s04_coerced",
    _mixed,
    f"SELECT metric_name, env AS deployment_environment, count(*) AS n FROM (SELECT event_type AS metric_name, k, env, timestamp_ns FROM ev"
    f" UNION ALL SELECT event_type || '_total', k, env, timestamp_ns FROM ev) WHERE {_W} AND k::DOUBLE < 20 GROUP BY 1, 2",
    "logs",
)


def _lowered_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = lowering.traceql('{ status = error && .order.priority = "2-HIGH" && service.name = "shop" }', ALL_START, ALL_END)
    return ir.require(ir.run(doc, signals.catalog(spark, sf_dir))).select("trace_id", "span_id", "duration")


def _lowered_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = lowering.logql('sum by (job) (rate({level!="INFO", k=~"^[1-4]"}[1h]))', START, END, "1d")
    return ir.require(ir.run(doc, signals.catalog(spark, sf_dir))).select("bucket_ns", "service_name", _rounded("value").alias("value"))


_add(
    "r10_traceql",
    _lowered_traces,
    f"SELECT trace_id, span_id, duration_nanos AS duration FROM traces WHERE {_T} AND status_code = 'Error' AND priority = '2-HIGH' AND service_name = 'shop'",
    "traces",
)
_add(
    "r10_logql",
    _lowered_logs,
    f"SELECT {_B} AS bucket_ns, service_name, round(count(*) / 3600.0 + 1e-7, 4) + 0.0 AS value {_LQ} AND severity_text <> 'INFO'"
    f" AND regexp_matches(k, '^[1-4]') GROUP BY 1, 2",
    "logs",
)


def _deep_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace a customer: its orders hang below one another in eights, some below a span that is not there, some in a cycle of three with the rest below it."""
    o = _orders(spark, sf_dir).withColumn("n", F.row_number().over(_by_customer()) - 1).withColumn("size", F.count(F.lit(1)).over(_by_customer(False)))
    kind = F.col("o_custkey") % 3
    parent = F.when((kind == 1) & (F.col("n") % 8 == 0), F.lit("gone")).when((kind == 2) & (F.col("n") == 0), F.when(F.col("size") >= 3, F.lit("s2")).when(F.col("size") == 2, F.lit("s1")).otherwise(F.lit("s0"))).when(F.col("n") % 8 != 0, F.concat(F.lit("s"), F.col("n") - 1)).when(kind == 2, F.lit("s0"))
    return traceql.span_trees(o.select(F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey").cast("string")).alias("trace_id"), F.concat(F.lit("s"), "n").alias("span_id"), parent.alias("parent_span_id"), (F.lit(1000) - F.col("n")).cast("long").alias("start_ns"), F.lit(False).alias("is_root")))


def _by_customer(ordered: bool = True):
    w = Window.partitionBy("o_custkey")
    return w.orderBy("o_orderkey") if ordered else w


# The cycle is 0 -> 2 -> 1 -> 0 by parents; starts fall with n, so the last of it is the earliest and stands at depth 0, the one whose parent it is next.
_add(
    "r07_cycles",
    _deep_traces,
    """WITH RECURSIVE o AS (SELECT o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n, count(*) OVER (PARTITION BY o_custkey) AS size FROM orders),
p AS (SELECT c, n, size, CASE WHEN c % 3 = 1 AND n % 8 = 0 THEN NULL WHEN c % 3 = 2 AND n = 0 THEN CASE WHEN size >= 3 THEN 2 WHEN size = 2 THEN 1 ELSE 0 END WHEN n % 8 <> 0 THEN n - 1 WHEN c % 3 = 2 THEN 0 END AS parent FROM o),
t AS (SELECT c, n, 0 AS depth FROM p WHERE c % 50 <> 0 AND (parent IS NULL OR c % 3 = 2 AND n = least(2, size - 1)) UNION ALL SELECT p.c, p.n, t.depth + 1 FROM t JOIN p ON p.c = t.c AND p.parent = t.n WHERE NOT (p.c % 3 = 2 AND p.n = least(2, p.size - 1)))
SELECT c::VARCHAR AS trace_id, 's' || n AS span_id, depth::BIGINT AS depth FROM t UNION ALL SELECT NULL, 's' || n, 0 FROM o WHERE c % 50 = 0""",
)

# --- tickets and SQL ----------------------------------------------------------------------------


def _ticket(text: str, *columns: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = tickets.run(spark, signals.catalog(spark, sf_dir), text)
        return out.select(*columns) if columns else out

    return query


_add(
    "s08_signals",
    _ticket('sql:acme:prod:{"query":"SELECT l.service_name, count(*) AS n, max(m.value) AS top FROM logs l JOIN metrics_gauge m ON l.timestamp_ns = m.timestamp_ns AND l.service_name = m.service_name WHERE l.severity_text = \'ERROR\' GROUP BY 1"}'),
    f"WITH {ORACLE['logs']} SELECT l.service_name, count(*) AS n, max(m.value) AS top FROM logs l JOIN ev m ON l.timestamp_ns = m.timestamp_ns"
    f" AND l.service_name = m.service_name WHERE l.severity_text = 'ERROR' GROUP BY 1",
)
_add("s08_capped", _ticket('sql:acme:prod:{"query":"SELECT 1 AS one FROM logs","most":25}'), "SELECT 1 AS one FROM range(25)")
_add(
    "s08_ticket",
    _ticket(f'search_traces:acme:prod:{{"query":"{{ kind = client }}","start":{ALL_START // 10**9},"end":{ALL_END // 10**9},"min_duration":"10ms","limit":15}}'),
    _ssql("span_kind = 'Client' AND duration_nanos >= 10000000", 15),
    "traces",
)
_add(
    "s08_metrics_ticket",
    _ticket(f'query_promql:acme:prod:{{"query":"sum by (service) (view)","start":{START},"end":{END},"step":"1d"}}', "bucket_ns", "service_name", "value"),
    f"SELECT {_B} AS bucket_ns, service_name, sum(value) AS value FROM metrics WHERE {_W} AND metric_name = 'view' GROUP BY 1, 2".replace("sum(value) AS value", "round(sum(value), 6) AS value"),
    "metrics",
)

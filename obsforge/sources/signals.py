"""Signal tables (logs, metrics, traces, profiles) as views over the driver's star-schema tables.

Each view has a twin in DuckDB SQL, ``ORACLE``, where map columns are plain columns; queries are
held against it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog

BOUNDS = (10, 20, 30, 40)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ns(column: str):
    return F.unix_micros(F.col(column).cast("timestamp")) * F.lit(1000).cast("long")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    env = F.when(F.col("user_id") % 3 == 0, "prod").when(F.col("user_id") % 3 == 1, "staging")
    return e.select(
        _ns("ts").alias("timestamp_ns"), "event_id", "event_type", "value", "props",
        F.concat(F.lit("svc-"), (F.col("user_id") % 10).cast("string")).alias("service_name"),
        env.alias("env"), F.get_json_object("props", "$.k").alias("k"),
    )


def _map(**entries: str):
    """A map of the entries that are not null; ``__`` in a name stands for a dot."""
    pairs = F.array(*[F.struct(F.lit(k.replace("__", ".")).alias("key"), F.col(c).alias("value")) for k, c in entries.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    severity = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").otherwise("INFO")
    number = F.when(F.col("event_type") == "error", 17).when(F.col("event_type") == "purchase", 13).otherwise(9)
    return e.select(
        "timestamp_ns", "service_name", severity.alias("severity_text"), number.cast("long").alias("severity_number"),
        F.concat(F.lit('{"event": "'), "event_type", F.lit('", "k": '), "k", F.lit("}")).alias("body"), F.concat(F.lit("t"), (F.col("event_id") % 500).cast("string")).alias("trace_id"),
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("span_id"), F.col("value").alias("duration"),
        _map(event__type="event_type", k="k").alias("log_attributes"), _map(deployment__environment="env").alias("resource_attributes"),
        F.lit(None).cast("map<string,string>").alias("scope_attributes"), F.col("env").alias("label_env"),
    )


def metrics_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("timestamp_ns", F.col("event_type").alias("metric_name"), "service_name", "value", _map(k="k").alias("attributes"), _map(deployment__environment="env").alias("resource_attributes"), F.col("env").alias("label_env"))


def metrics_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("timestamp_ns", F.concat("event_type", F.lit("_total")).alias("metric_name"), "service_name", F.col("event_id").cast("double").alias("value"), _map(k="k").alias("attributes"), _map(deployment__environment="env").alias("resource_attributes"), F.lit(True).alias("is_monotonic"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    li = _read(spark, sf_dir, "lineitem")
    status = lambda c, bad, good: F.when(F.col(c) == bad, "Error").when(F.col(c) == good, "Ok").otherwise("Unspecified")
    text = lambda c: F.col(c).cast("string")
    roots = o.select(
        F.concat(F.lit("t"), text("o_orderkey")).alias("trace_id"), F.concat(F.lit("s"), text("o_orderkey")).alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"),
        F.concat(F.lit("order "), F.substring("o_orderpriority", 1, 1)).alias("span_name"), F.lit("shop").alias("service_name"),
        (_ns("o_orderdate") + (F.col("o_orderkey") % 86400) * F.lit(1_000_000_000)).alias("start_ns"), (F.col("o_totalprice") * 1000).cast("long").alias("duration_nanos"),
        status("o_orderstatus", "F", "O").alias("status_code"), F.lit("Server").alias("span_kind"), F.lit(True).alias("is_root"), F.col("o_orderpriority").alias("priority"), F.lit(None).cast("string").alias("part"),
    )
    children = li.select(
        F.concat(F.lit("t"), text("l_orderkey")).alias("trace_id"), F.concat(F.lit("s"), text("l_orderkey"), F.lit("-"), text("l_linenumber"), F.lit("-"), text("l_partkey")).alias("span_id"), F.concat(F.lit("s"), text("l_orderkey")).alias("parent_span_id"),
        F.concat(F.lit("line "), text("l_linenumber")).alias("span_name"), F.concat(F.lit("supp-"), (F.col("l_suppkey") % 10).cast("string")).alias("service_name"),
        _ns("l_shipdate").alias("start_ns"), (F.col("l_quantity") * 1_000_000).cast("long").alias("duration_nanos"),
        status("l_returnflag", "R", "A").alias("status_code"), F.when(F.col("l_linestatus") == "O", "Client").otherwise("Internal").alias("span_kind"), F.lit(False).alias("is_root"), F.lit(None).cast("string").alias("priority"), (F.col("l_partkey") % 50).cast("string").alias("part"),
    )
    event = F.when((F.col("status_code") == "Error") & F.col("is_root"), F.concat(F.lit('[{"name":"start","attributes":{}},{"name":"exception","attributes":{"exception.type":"E'), F.substring("priority", 1, 1), F.lit('","exception.message":"failed"}}]'))).otherwise("[]")
    both = roots.unionByName(children)
    return both.withColumns({"end_ns": F.col("start_ns") + F.col("duration_nanos"), "events": event, "span_attributes": _map(order__priority="priority", part="part"), "resource_attributes": _map(service__name="service_name")}).drop("priority", "part")


def metrics_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select(_ns("l_shipdate").alias("timestamp_ns"), F.concat(F.lit("flag-"), "l_returnflag").alias("service_name"), F.col("l_quantity").alias("q"))
    edges = [None, *BOUNDS, None]
    counts = [F.count_if((F.col("q") > lo if lo is not None else F.lit(True)) & (F.col("q") <= hi if hi is not None else F.lit(True))).cast("string") for lo, hi in zip(edges, edges[1:], strict=False)]
    return li.groupBy("timestamp_ns", "service_name").agg(F.lit("quantity").alias("metric_name"), F.count(F.lit(1)).alias("count"), F.sum("q").alias("sum"), F.concat(F.lit("["), F.concat_ws(",", *counts), F.lit("]")).alias("bucket_counts"), F.lit(str(list(BOUNDS))).alias("explicit_bounds"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a sample: a root-first stack of frames with a value."""
    o = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = o.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return s.select(_ns("o_orderdate").alias("timestamp_ns"), F.col("r_name").alias("service_name"), F.lit("cpu").alias("sample_type"), F.lit("count").alias("sample_unit"), F.array("r_name", "n_name", "c_mktsegment", "o_orderpriority").alias("stack"), F.lit(1).cast("long").alias("value"))


TABLES = {"logs": logs, "metrics_gauge": metrics_gauge, "metrics_sum": metrics_sum, "traces": traces, "metrics_histogram": metrics_histogram, "profiles": profiles}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The views, for tenant ``acme`` and dataset ``prod``; each is made when it is asked for."""
    found = Catalog()
    for name, view in TABLES.items():
        found.add("acme", "prod", name, lambda view=view: view(spark, sf_dir))
    return found


_EVENTS = """ev AS (SELECT epoch_us(ts)*1000 AS timestamp_ns, event_id, event_type, value, props, 'svc-' || (user_id % 10) AS service_name,
  CASE user_id % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' END AS env, props->>'k' AS k FROM events)"""
ORACLE = {
    "logs": _EVENTS + """, logs AS (SELECT *, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END AS severity_text,
  CASE event_type WHEN 'error' THEN 17 WHEN 'purchase' THEN 13 ELSE 9 END AS severity_number, '{"event": "' || event_type || '", "k": ' || k || '}' AS body, 't' || (event_id % 500) AS trace_id, 's' || event_id AS span_id, value AS duration FROM ev)""",
    "metrics": _EVENTS + """, metrics AS (SELECT timestamp_ns, event_type AS metric_name, service_name, value, k, env AS label_env FROM ev
  UNION ALL SELECT timestamp_ns, event_type || '_total', service_name, event_id::DOUBLE, k, NULL FROM ev)""",
    "traces": """traces AS (SELECT 't' || o_orderkey AS trace_id, 's' || o_orderkey AS span_id, NULL AS parent_span_id, 'order ' || substr(o_orderpriority,1,1) AS span_name, 'shop' AS service_name,
  epoch_us(o_orderdate)*1000 + (o_orderkey % 86400)*1000000000 AS start_ns, trunc(o_totalprice*1000)::BIGINT AS duration_nanos, CASE o_orderstatus WHEN 'F' THEN 'Error' WHEN 'O' THEN 'Ok' ELSE 'Unspecified' END AS status_code,
  'Server' AS span_kind, true AS is_root, o_orderpriority AS priority, NULL AS part FROM orders UNION ALL
  SELECT 't' || l_orderkey, 's' || l_orderkey || '-' || l_linenumber || '-' || l_partkey, 's' || l_orderkey, 'line ' || l_linenumber, 'supp-' || (l_suppkey % 10), epoch_us(l_shipdate)*1000, trunc(l_quantity*1000000)::BIGINT,
  CASE l_returnflag WHEN 'R' THEN 'Error' WHEN 'A' THEN 'Ok' ELSE 'Unspecified' END, CASE l_linestatus WHEN 'O' THEN 'Client' ELSE 'Internal' END, false, NULL, (l_partkey % 50)::VARCHAR FROM lineitem)""",
    "hist": """hist AS (SELECT epoch_us(l_shipdate)*1000 AS timestamp_ns, 'flag-' || l_returnflag AS service_name, count(*) AS cnt, sum(l_quantity) AS total,
  count(*) FILTER (l_quantity <= 10) AS c0, count(*) FILTER (l_quantity > 10 AND l_quantity <= 20) AS c1, count(*) FILTER (l_quantity > 20 AND l_quantity <= 30) AS c2, count(*) FILTER (l_quantity > 30 AND l_quantity <= 40) AS c3, count(*) FILTER (l_quantity > 40) AS c4 FROM lineitem GROUP BY 1, 2)""",
    "profiles": """profiles AS (SELECT epoch_us(o_orderdate)*1000 AS timestamp_ns, r_name AS service_name, [r_name, n_name, c_mktsegment, o_orderpriority] AS stack, 1 AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
}

"""Queries over stored tables: commits, pruning, compaction, retention, evolution; and the SQL they are held against."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.timeutil import HOUR_NS
from .operators import lifecycle
from .plans import ir, logql, promql, traceql
from .queries import _PM, _SER, DAY, END, START, _add, _rounded
from .sources import scratch, signals
from .sources.catalog import Catalog
from .sources.signals import ORACLE
from .streaming import ingest

#: Tables that were written for this application: their folders.
_written: dict[tuple[str, str, str], str] = {}


def _fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all years, folded into January 2024."""
    t = signals.traces(spark, sf_dir)
    at = F.lit(START) + F.col("start_ns") % F.lit(30 * DAY)
    return t.withColumns({"start_ns": at, "end_ns": at + F.col("duration_nanos")})


def stored(spark: SparkSession, sf_dir: str, table: str) -> str:
    """The folder of a table in storage, written once an application."""
    key = (spark.sparkContext.applicationId, sf_dir, table)
    if key not in _written:
        path = scratch.folder(spark, table)
        frame = _fold(spark, sf_dir) if table == "traces" else signals.TABLES[table](spark, sf_dir)
        lifecycle.write(frame, table, path, bloom=("trace_id",) if table == "traces" else ())
        _written[key] = path
    return _written[key]


def stored_catalog(spark: SparkSession, sf_dir: str, *tables: str) -> Catalog:
    c = Catalog()
    for t in tables:
        c.add_stored(spark, "acme", "prod", t, stored(spark, sf_dir, t))
    return c


_FROM, _TO = START + 3 * DAY, START + 4 * DAY - 1
_DAYS = f"timestamp_ns BETWEEN {_FROM} AND {_TO}"


def _pruned_ir(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = {"irVersion": 5, "from": "logs", "range": {"from": _FROM, "to": _TO}, "result": "table", "pipeline": [{"aggregate": {"by": ["service.name"], "aggs": [{"fn": "count", "as": "n"}, {"fn": "max", "of": "timestamp", "as": "newest"}]}}]}
    return ir.require(ir.run(doc, stored_catalog(spark, sf_dir, "logs")))


def _pruned_promql(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = promql.query_range(spark, stored_catalog(spark, sf_dir, "metrics_gauge", "metrics_sum"), "view", _FROM, _TO, DAY // 24)
    return m.frame.withColumn("value", _rounded("value"))


def _pruned_logql(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = logql.query_range(spark, stored_catalog(spark, sf_dir, "logs"), 'sum by (job) (count_over_time({level="ERROR"}[1h]))', _FROM, _TO, DAY // 24)
    return m.frame


def _pruned_traceql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traceql.search(stored_catalog(spark, sf_dir, "traces"), traceql.parse("{ kind = client }"), _FROM, _TO, 15)


_add("s07_ir", _pruned_ir, f"SELECT service_name, count(*) AS n, max(timestamp_ns) AS newest FROM logs WHERE {_DAYS} GROUP BY 1", "logs")
_add(
    "s07_promql",
    _pruned_promql,
    f"SELECT timestamp_ns - timestamp_ns % {DAY // 24} AS bucket_ns, {_SER}, round(arg_max(value, timestamp_ns) + 1e-7, 4) + 0.0 AS value {_PM}'view'"
    f" AND {_DAYS} GROUP BY ALL",
    "metrics",
)
_add(
    "s07_logql",
    _pruned_logql,
    f"SELECT timestamp_ns - timestamp_ns % {DAY // 24} AS bucket_ns, service_name, count(*)::DOUBLE AS value FROM logs WHERE {_DAYS}"
    f" AND severity_text = 'ERROR' GROUP BY 1, 2",
    "logs",
)
_FOLDED = f"{ORACLE['traces']}, f AS (SELECT * REPLACE ({START} + start_ns % {30 * DAY} AS start_ns) FROM traces)"
_add(
    "s07_traceql",
    _pruned_traceql,
    f"WITH {_FOLDED} SELECT trace_id, max(start_ns) AS newest_ns, count(*) AS n_spans, max(duration_nanos) AS longest_ns FROM (SELECT * FROM f"
    f" WHERE start_ns BETWEEN {_FROM} AND {_TO} AND span_kind = 'Client' ORDER BY start_ns DESC, trace_id, span_id LIMIT 750) GROUP BY 1"
    f" ORDER BY 2 DESC, 1 LIMIT 15",
)
_add(
    "s07_trace",
    lambda s, d: traceql.trace(stored_catalog(s, d, "traces"), "t42").select("trace_id", "span_id", "start_ns"),
    f"WITH {_FOLDED} SELECT trace_id, span_id, start_ns FROM f WHERE trace_id = 't42'",
)


def _sliced(spark: SparkSession, sf_dir: str, slices: int) -> str:
    """Logs that came in so many appends, by their span's number, so that an hour is several files."""
    path = scratch.folder(spark, "logs")
    rows = signals.logs(spark, sf_dir).drop("label_env")
    for k in range(slices):
        lifecycle.write(rows.where(F.substring("span_id", 2, 20).cast("long") % slices == k), "logs", path)
    return path


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before and after a rewrite of all hours, how many files there are then, and the rows' contents."""
    path = _sliced(spark, sf_dir, 2)
    plans = lifecycle.plan_compaction(spark, path, END + 10 * DAY, min_files=2)
    before = len(lifecycle.state(spark, path).files)
    lifecycle.compact(spark, path, "logs", plans, labels=("deployment.environment", "k"))
    now = lifecycle.state(spark, path)
    back = lifecycle.read(spark, path, START + DAY, END)
    out = back.groupBy("service_name", "label_deployment_environment").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp_ns").alias("newest_ns"), F.count("label_k").alias("with_k"))
    return out.withColumn("fewer_files", F.lit(bool(plans) and len(now.files) < before))


_add(
    "c05_stored",
    _compacted,
    f"SELECT service_name, env AS label_deployment_environment, count(*) AS n, max(timestamp_ns) AS newest_ns, count(k) AS with_k, true AS fewer_files"
    f" FROM logs WHERE timestamp_ns BETWEEN {START + DAY} AND {END} GROUP BY 1, 2",
    "logs",
)


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that a plan takes: closed ones of two files or more."""
    plans = lifecycle.plan_compaction(spark, _sliced(spark, sf_dir, 2), START + 10 * DAY, min_files=2, lateness_ns=HOUR_NS)
    return spark.createDataFrame([(p.hour,) for p in plans], "hour long")


_add(
    "c04_plan",
    _planned,
    f"SELECT timestamp_ns // {HOUR_NS} AS hour FROM logs GROUP BY 1 HAVING count(DISTINCT event_id % 2) = 2"
    f" AND timestamp_ns // {HOUR_NS} + 2 <= {(START + 10 * DAY) // HOUR_NS}",
    "logs",
)


def _sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each hour's file, whether its rows stand in the table's order."""
    path = stored(spark, sf_dir, "logs")
    rows = lifecycle.table(spark, path).select("hour_bucket", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "timestamp_ns", "service_name", "severity_text")
    before = F.lag(F.struct("timestamp_ns", "service_name", "severity_text")).over(Window.partitionBy("file").orderBy("at"))
    kept = rows.withColumn("fine", F.coalesce(before <= F.struct("timestamp_ns", "service_name", "severity_text"), F.lit(True)))
    return kept.groupBy("hour_bucket").agg(F.count(F.lit(1)).alias("n"), F.bool_and("fine").alias("in_order"))


_add("c03_sorted", _sorted, f"SELECT timestamp_ns // {HOUR_NS} AS hour_bucket, count(*) AS n, true AS in_order FROM logs GROUP BY 1", "logs")


def _retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What retention leaves of a table that came in by a stream and by appends."""
    path = scratch.folder(spark, "logs")
    rows = signals.logs(spark, sf_dir)
    ingest.append_once("logs", path, "main")(rows.where(F.col("k").cast("int") < 50), 0)
    ingest.append_once("logs", path, "main")(rows, 0)  # the same batch again, with other rows: it is there already
    lifecycle.write(rows.where(F.coalesce(F.col("k").cast("int") >= 50, F.lit(True))), "logs", path)
    period = lifecycle.retention_ns("logs", "prod", "acme", {"acme": DAY, "acme/prod": 20 * DAY}, 400 * DAY)
    lifecycle.expire(spark, path, START + 30 * DAY, period, grace_ns=DAY)
    return lifecycle.read(spark, path).groupBy("service_name").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp_ns").alias("oldest_ns"))


_add(
    "c06_retention",
    _retained,
    f"SELECT service_name, count(*) AS n, min(timestamp_ns) AS oldest_ns FROM logs WHERE timestamp_ns >= {START + 9 * DAY} GROUP BY 1",
    "logs",
)


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the table as a stream into storage, some batches tried again."""
    path = scratch.folder(spark, "logs")
    rows = signals.logs(spark, sf_dir)
    for k in range(3):
        for _ in range(2):
            ingest.append_once("logs", path, "main")(rows.where(F.pmod(F.xxhash64("span_id"), F.lit(3)) == k), k)
    return lifecycle.read(spark, path).groupBy("severity_text").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("span_id").alias("spans"))


_add("c01_idempotent", _ingested, "SELECT severity_text, count(*) AS n, count(DISTINCT span_id) AS spans FROM logs GROUP BY 1", "logs")


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each version before and after old files are deleted, and what an unfinished write left."""
    path = _sliced(spark, sf_dir, 2)
    lifecycle.compact(spark, path, "logs", lifecycle.plan_compaction(spark, path, END + 10 * DAY, min_files=2))
    old = [lifecycle.read(spark, path, version=v).count() for v in (1, 2, 3)]
    stray = f"{path}/hour_bucket={START // HOUR_NS}/stray.parquet"
    signals.logs(spark, sf_dir).limit(3).coalesce(1).write.parquet(stray)  # files without a commit
    later = time.time_ns() + HOUR_NS
    swept, gone = lifecycle.sweep(spark, path, later), lifecycle.expire_snapshots(spark, path, later, 0)
    left = lifecycle.stored_files(spark, path).count() == len(lifecycle.state(spark, path).files)
    return spark.createDataFrame([(old[0] < old[1], old[1], old[2], lifecycle.read(spark, path).count(), bool(swept), bool(gone), left)], "grew boolean, appended long, rewritten long, now long, swept boolean, expired boolean, only_live boolean")


_add(
    "c07_snapshots",
    _snapshots,
    "SELECT true AS grew, count(*) AS appended, count(*) AS rewritten, count(*) AS now, true AS swept, true AS expired, true AS only_live FROM events",
)


def _evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label column that older files do not have, one that is dropped again, and files of both kinds in one table."""
    path = scratch.folder(spark, "logs")
    rows = signals.logs(spark, sf_dir)
    lifecycle.write(rows.where("severity_text = 'INFO'").drop("label_env"), "logs", path)
    lifecycle.evolve(spark, path, add=("label_env", "label_gone"))
    lifecycle.write(rows.where("severity_text <> 'INFO'").withColumn("label_gone", F.lit("x")), "logs", path)
    lifecycle.evolve(spark, path, drop=("label_gone",))
    back = lifecycle.read(spark, path)
    return back.groupBy("severity_text", "label_env").agg(F.count(F.lit(1)).alias("n")).withColumn("dropped", F.lit("label_gone" not in back.columns))


_add(
    "c08_evolution",
    _evolved,
    "SELECT severity_text, CASE WHEN severity_text <> 'INFO' THEN env END AS label_env, count(*) AS n, true AS dropped FROM logs GROUP BY 1, 2",
    "logs",
)


def _backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels filled in by a rewrite: values that are there stay, others come from resource, scope or record."""
    rows = signals.logs(spark, sf_dir).withColumn("label_k", F.when(F.col("severity_text") == "ERROR", "kept"))
    return lifecycle.backfilled(rows, ("k", "deployment.environment")).select("span_id", "label_k", "label_deployment_environment")


_add(
    "as4_backfill",
    _backfilled,
    "SELECT span_id, CASE WHEN severity_text = 'ERROR' THEN 'kept' ELSE k END AS label_k, env AS label_deployment_environment FROM logs",
    "logs",
)

"""A query for each operator over the driver's tables, and the SQL it is held against."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import histogram
from .operators import lifecycle, otlp, profiles, remote_write, stats, transforms
from .operators import matrix as mx
from .plans import ir, logql, promql, traceql
from .plans import sql as sql_plan
from .sources import scratch, signals
from .sources.catalog import Catalog
from .sources.signals import ORACLE

DAY = 86400 * 10**9
START, END = 1704067200 * 10**9, 1706659200 * 10**9 - 1  # January 2024
ALL_START, ALL_END = 788918400 * 10**9, 1104537600 * 10**9  # 1995 to 2005, orders and lines
#: name: (query, SQL or None)
_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None, *tables: str) -> None:
    ctes = ", ".join(ORACLE[t] for t in tables)
    if len(tables) == 2 and set(tables) == {"logs", "metrics"}:
        ctes = ORACLE["logs"] + ", " + ORACLE["metrics"].split(", ", 1)[1]
    _ALL[name] = (query, (f"WITH {ctes} " if ctes else "") + sql if sql else None)


# --- IR documents -------------------------------------------------------------------------------


def _ir(source: str, pipeline: list, result: str, fields: list[str] | None = None, version: int = 5, start: int = START, end: int = END, round_: tuple[str, ...] = (), exact: bool = False):
    doc = {"irVersion": version, "from": source, "range": {"from": start, "to": end}, "result": result, "pipeline": pipeline} | ({"fields": fields} if fields else {})

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = ir.require(ir.run(doc, signals.catalog(spark, sf_dir), exact=exact))
        return out.withColumns({c: F.round(c, 4) for c in round_}) if round_ else out

    return query


def _where(field: str, op: str, value=None) -> dict:
    return {"where": {"field": field, "op": op} | ({} if value is None else {"value": value})}


_ROWS = ["span_id", "severity_text"]
_W = f"timestamp_ns BETWEEN {START} AND {END}"
_T = f"start_ns BETWEEN {ALL_START} AND {ALL_END}"
_B = f"timestamp_ns - timestamp_ns % {DAY}"
_TB = f"start_ns - start_ns % {DAY * 30}"

_PREDICATES = {
    "p03_eq": ({"field": "severity_text", "op": "eq", "value": "ERROR"}, "severity_text = 'ERROR'"),
    "p03_ne": ({"field": "severity_text", "op": "ne", "value": "ERROR"}, "severity_text <> 'ERROR'"),
    "p03_gt": ({"field": "severity_number", "op": "gt", "value": 9}, "severity_number > 9"),
    "p03_gte": ({"field": "severity_number", "op": "gte", "value": "17"}, "severity_number >= 17"),
    "p03_lt": ({"field": "k", "op": "lt", "value": 25}, "k::DOUBLE < 25"),
    "p03_lte": ({"field": "duration", "op": "lte", "value": 10}, "duration <= 10"),
    "p04_in": ({"field": "severity_text", "op": "in", "value": ["ERROR", "WARN"]}, "severity_text IN ('ERROR', 'WARN')"),
    "p04_between": ({"field": "severity_number", "op": "between", "value": [10, 17]}, "severity_number BETWEEN 10 AND 17"),
    "p05_contains": ({"field": "event.type", "op": "contains", "value": "ie"}, "event_type LIKE '%ie%'"),
    "p06_regex": ({"field": "service.name", "op": "regex", "value": "svc-[13]$"}, "regexp_matches(service_name, 'svc-[13]$')"),
    "p07_exists": ({"field": "deployment.environment", "op": "exists"}, "env IS NOT NULL"),
    "p08_kleene_not": ({"not": {"field": "deployment.environment", "op": "eq", "value": "prod"}}, "NOT (env = 'prod')"),
    "p08_and_or": ({"or": [{"and": [{"field": "severity_number", "op": "gte", "value": 17}, {"field": "deployment.environment", "op": "eq", "value": "prod"}]}, {"field": "k", "op": "eq", "value": "7"}]}, "(severity_number >= 17 AND env = 'prod') OR k = '7'"),
    "p08_empty_or": ({"or": [{"or": []}, {"and": [{"not": {"or": []}}, {"and": []}, {"field": "k", "op": "eq", "value": "9"}]}]}, "false OR (NOT false AND true AND k = '9')"),
    "p10_qualified": ({"field": "resource.deployment.environment", "op": "eq", "value": "staging"}, "env = 'staging'"),
    "p10_wrong_scope": ({"not": {"field": "log.deployment.environment", "op": "exists"}}, "true"),
}
for _name, (_node, _sql) in _PREDICATES.items():
    _add(_name, _ir("logs", [{"where": _node}], "rows", _ROWS), f"SELECT span_id, severity_text FROM logs WHERE {_W} AND ({_sql})", "logs")

_add(
    "ir_error_logs_by_service",
    _ir("logs", [{"where": {"and": [{"field": "severity_number", "op": "gte", "value": 17}, {"field": "deployment.environment", "op": "eq", "value": "prod"}]}}, {"aggregate": {"by": ["service.name"], "step": "1h", "aggs": [{"fn": "count", "as": "n"}]}}], "series"),
    f"SELECT timestamp_ns - timestamp_ns % {DAY // 24} AS bucket_ns, service_name, count(*) AS n FROM logs WHERE {_W} AND severity_number >= 17"
    f" AND env = 'prod' GROUP BY 1, 2",
    "logs",
)
_add(
    "s06_window",
    _ir("logs", [], "rows", _ROWS, start=START + DAY, end=START + 2 * DAY),
    f"SELECT span_id, severity_text FROM logs WHERE timestamp_ns BETWEEN {START + DAY} AND {START + 2 * DAY}",
    "logs",
)
_add(
    "s03_union",
    _ir("metrics", [{"aggregate": {"by": ["metric.name"], "aggs": [{"fn": "count", "as": "n"}]}}], "table"),
    f"SELECT metric_name, count(*) AS n FROM metrics WHERE {_W} GROUP BY 1".replace("metric_name,", "metric_name AS metric_name,"),
    "metrics",
)
_add(
    "p11_exception",
    _ir("traces", [_where("exception.type", "exists"), {"aggregate": {"by": ["exception.type"], "aggs": [{"fn": "count", "as": "n"}]}}], "table", start=ALL_START, end=ALL_END),
    f"SELECT 'E' || substr(priority, 1, 1) AS exception_type, count(*) AS n FROM traces WHERE {_T} AND is_root AND status_code = 'Error' GROUP BY 1",
    "traces",
)
_add(
    "p12_span_events",
    _ir("traces", [], "rows", ["span.id", "span_events"], start=ALL_START, end=ALL_END),
    f"""SELECT span_id, CASE WHEN is_root AND status_code = 'Error' THEN '[{{"name":"start","attributes":{{}}}},{{"name":"exception","attributes":{{"exception.type":"E' || substr(priority, 1, 1) || '","exception.message":"failed"}}}}]' END AS span_events FROM traces WHERE {_T}""",
    "traces",
)
_add(
    "p13_fields",
    _ir("traces", [_where("service.name", "eq", "shop")], "rows", ["trace.id", "duration", "order.priority"], start=ALL_START, end=ALL_END),
    f"SELECT trace_id, duration_nanos AS duration, priority AS order_priority FROM traces WHERE {_T} AND service_name = 'shop'",
    "traces",
)
_add(
    "p14_extract_json",
    _ir("logs", [{"extract": {"parser": "json", "as": [{"name": "event", "type": "string"}, {"name": "num", "type": "int64"}]}}, {"aggregate": {"by": ["event"], "aggs": [{"fn": "count", "as": "n"}]}}], "table"),
    f"SELECT event_type AS event, count(*) AS n FROM logs WHERE {_W} GROUP BY 1",
    "logs",
)


def _logfmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies in logfmt, with a quoted value, a key that begins another, and keys that are missing."""
    body = F.concat_ws(" ", F.lit("ts=1"), F.concat(F.lit("levels="), "event_id"), F.when(F.col("k") != "7", F.concat(F.lit('level="'), "event_type", F.lit('"'))), F.concat(F.lit("n="), "k"), F.lit("n=again"))
    e = signals._events(spark, sf_dir).withColumn("body", body)
    c = Catalog()
    c.add("acme", "prod", "logs", lambda: e.withColumn("log_attributes", F.create_map().cast("map<string,string>")))
    spec = {"parser": "logfmt", "as": [{"name": "level", "type": "string"}, {"name": "n", "type": "int64"}, {"name": "absent", "type": "string"}]}
    aggs = [{"fn": "count", "as": "rows"}, {"fn": "sum", "of": "n", "as": "total"}, {"fn": "max", "of": "absent", "as": "none"}]
    doc = {"irVersion": 5, "from": "logs", "range": {"from": START, "to": END}, "result": "table", "pipeline": [{"extract": spec}, {"aggregate": {"by": ["level"], "aggs": aggs}}]}
    return ir.require(ir.run(doc, c))


_add(
    "p15_extract_logfmt",
    _logfmt,
    f"SELECT CASE WHEN k <> '7' THEN event_type END AS level, count(*) AS rows, sum(k::DOUBLE) AS total, NULL::VARCHAR AS none FROM ev WHERE {_W} GROUP BY 1",
    "logs",
)

_AGGS = {
    "a03_count": ({"fn": "count", "as": "v"}, "count(*)"),
    "a04_sum": ({"fn": "sum", "of": "duration", "as": "v"}, "sum(duration)"),
    "a04_avg": ({"fn": "avg", "of": "duration", "as": "v"}, "avg(duration)"),
    "a05_min": ({"fn": "min", "of": "duration", "as": "v"}, "min(duration)"),
    "a05_max_text": ({"fn": "max", "of": "severity_text", "as": "v"}, "max(severity_text)"),
    "a06_quantile": ({"fn": "quantile", "of": "duration", "arg": 0.95, "as": "v"}, "quantile_disc(duration, 0.95)"),
    "a07_stddev": ({"fn": "stddev", "of": "duration", "as": "v"}, "stddev_pop(duration)"),
    "a07_stdvar": ({"fn": "stdvar", "of": "duration", "as": "v"}, "var_pop(duration)"),
    "a08_first": ({"fn": "first", "of": "duration", "as": "v"}, "arg_min(duration, timestamp_ns)"),
    "a08_last": ({"fn": "last", "of": "duration", "as": "v"}, "arg_max(duration, timestamp_ns)"),
    "a09_scoped": ({"fn": "count", "as": "v", "where": {"field": "severity_text", "op": "eq", "value": "ERROR"}}, "count(*) FILTER (severity_text = 'ERROR')"),
    "a09_scoped_quantile": ({"fn": "quantile", "of": "duration", "arg": 0.5, "as": "v", "where": {"field": "k", "op": "lt", "value": 50}}, "quantile_disc(duration, 0.5) FILTER (k::DOUBLE < 50)"),
    "a10_divisor": ({"fn": "count", "as": "v", "divisor": 60}, "count(*) / 60.0::DOUBLE"),
}
for _name, (_agg, _sql) in _AGGS.items():
    _r = () if _name in ("a03_count", "a05_max_text", "a09_scoped") else ("v",)
    _add(
        _name,
        _ir("logs", [{"aggregate": {"by": ["service.name"], "aggs": [_agg]}}], "table", round_=_r),
        f"SELECT service_name, {f'round({_sql}, 4)' if _r else _sql} AS v FROM logs WHERE {_W} GROUP BY 1",
        "logs",
    )

_BY = {"aggregate": {"by": ["service.name", "severity_text"], "aggs": [{"fn": "count", "as": "n"}, {"fn": "max", "of": "duration", "as": "top"}]}}
_BYSQL = f"SELECT service_name, severity_text, count(*) AS n, max(duration) AS top FROM logs WHERE {_W} GROUP BY 1, 2"
_add("a01_group", _ir("logs", [_BY], "table"), _BYSQL, "logs")
_add(
    "a02_step",
    _ir("logs", [{"aggregate": {"by": ["severity_text"], "step": "1d", "aggs": [{"fn": "avg", "of": "duration", "as": "v"}]}}], "series", round_=("v",)),
    f"SELECT {_B} AS bucket_ns, severity_text, round(avg(duration), 4) AS v FROM logs WHERE {_W} GROUP BY 1, 2",
    "logs",
)
_add("a11_topk", _ir("logs", [_BY, {"topk": {"n": 5, "of": "n"}}], "table"), _BYSQL + " ORDER BY n DESC NULLS LAST, 1, 2 LIMIT 5", "logs")
_add("a11_bottomk", _ir("logs", [_BY, {"bottomk": {"n": 5, "of": "n"}}], "table"), _BYSQL + " ORDER BY n NULLS LAST, 1, 2 LIMIT 5", "logs")
_add(
    "a12_order_limit",
    _ir("logs", [_BY, {"order": [{"of": "n", "dir": "desc"}, {"of": "service.name"}, {"of": "severity_text"}]}, {"limit": 7}], "table"),
    _BYSQL + " ORDER BY n DESC NULLS FIRST, 1, 2 LIMIT 7",
    "logs",
)
_add("a19_having", _ir("logs", [_BY, {"where": {"field": "n", "op": "gt", "value": 150}}], "table"), _BYSQL + " HAVING count(*) > 150", "logs")
_add(
    "a14_heatmap",
    _ir("traces", [{"heatmap": {"x": {"step": "30d"}, "y": {"field": "duration", "bounds": ["1ms", "20ms", "100ms", "300ms"]}}}], "heatmap", start=ALL_START, end=ALL_END),
    f"SELECT {_TB} AS bucket_ns, CASE WHEN duration_nanos < 1000000 THEN 0 WHEN duration_nanos < 20000000 THEN 1 WHEN duration_nanos < 100000000 THEN 2"
    f" WHEN duration_nanos < 300000000 THEN 3 ELSE 4 END AS y_bucket, count(*) AS count FROM traces WHERE {_T} GROUP BY 1, 2",
    "traces",
)
_H = f"""agg AS (SELECT timestamp_ns - timestamp_ns % {DAY * 30} AS bucket_ns, 'quantity' AS metric_name, service_name, sum(c0)::DOUBLE AS c0, sum(c1)::DOUBLE AS c1, sum(c2)::DOUBLE AS c2, sum(c3)::DOUBLE AS c3, sum(c4)::DOUBLE AS c4 FROM hist WHERE timestamp_ns BETWEEN {ALL_START} AND {ALL_END} GROUP BY 1, 2, 3)
, q AS (SELECT *, c0+c1+c2+c3+c4 AS t, PHI*(c0+c1+c2+c3+c4) AS r FROM agg)"""
_QUANTILE = "CASE WHEN t <= 0 THEN 'nan'::DOUBLE WHEN c0 >= r THEN 10*r/c0 WHEN c0+c1 >= r THEN 10+10*(r-c0)/c1 WHEN c0+c1+c2 >= r THEN 20+10*(r-c0-c1)/c2 WHEN c0+c1+c2+c3 >= r THEN 30+10*(r-c0-c1-c2)/c3 ELSE 40 END"
_HQ = f", {_H.replace('PHI', '0.7')} SELECT bucket_ns, metric_name, service_name, round({_QUANTILE}, 4) AS VALUE FROM q"
_add(
    "a15_histogram_quantile",
    _ir("metrics_histogram", [{"histogram_quantile": {"phi": 0.7, "by": ["service.name"], "step": "30d"}}], "series", start=ALL_START, end=ALL_END, round_=("value",)),
    _HQ.replace("SELECT bucket_ns, metric", "SELECT bucket_ns, metric").removeprefix(", "),
    "hist",
)
_ALL["a15_histogram_quantile"] = (_ALL["a15_histogram_quantile"][0], f"WITH {ORACLE['hist']}{_HQ.replace('VALUE', 'value')}")

def _rounded(column: str):
    """To four places, as the SQL does it: ties, which the engines round apart, are nudged up, and zero has no sign."""
    return F.round(F.col(column) + 1e-7, 4) + 0.0


# --- PromQL -------------------------------------------------------------------------------------


def _prom(text: str, step: int = DAY, start: int = START, end: int = END, instant: bool = False):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = signals.catalog(spark, sf_dir)
        m = promql.query(spark, c, text, end) if instant else promql.query_range(spark, c, text, start, end, step)
        return m.frame.withColumn("value", _rounded("value"))

    return query


_SER = "metric_name, service_name, label_env"
_PM = f"FROM metrics WHERE {_W} AND metric_name = "
_LAST = f"SELECT {_B} AS bucket_ns, {_SER}, arg_max(value, timestamp_ns) AS value {_PM}'view' GROUP BY ALL"


def _p(name: str, text: str, select: str, where: str = "'view'", group: str = _SER, tail: str = "") -> None:
    sql = f"SELECT {_B} AS bucket_ns, {group + ', ' if group else ''}round({select} + 1e-7, 4) + 0.0 AS value {_PM}{where} GROUP BY ALL{tail}"
    _add(name, _prom(text), sql, "metrics")


_p("m01_selector", "view", "arg_max(value, timestamp_ns)")
_p("m02_eq", 'view{service="svc-1"}', "arg_max(value, timestamp_ns)", "'view' AND service_name = 'svc-1'")
_p("m02_ne_absent", 'view{deployment_environment!="prod"}', "arg_max(value, timestamp_ns)")
_p("m02_label_ne", 'view{env!="prod"}', "arg_max(value, timestamp_ns)", "'view' AND (label_env IS NULL OR label_env <> 'prod')")
_p("m02_regex", 'view{k=~"^1"}', "arg_max(value, timestamp_ns)", "'view' AND k LIKE '1%'")
_p("m02_not_regex", 'view{job!~"svc-[0-4]"}', "arg_max(value, timestamp_ns)", "'view' AND NOT regexp_matches(service_name, 'svc-[0-4]')")
_add(
    "m03_offset",
    _prom("view offset 1d"),
    f"SELECT (timestamp_ns + {DAY}) - (timestamp_ns + {DAY}) % {DAY} AS bucket_ns, {_SER}, round(arg_max(value, timestamp_ns) + 1e-7, 4) + 0.0 AS value"
    f" FROM metrics WHERE timestamp_ns BETWEEN {START - DAY} AND {END - DAY} AND metric_name = 'view' GROUP BY ALL",
    "metrics",
)
_AT = START + 10 * DAY
_add(
    "m04_at",
    _prom(f'{{__name__=~"^[a-z]+$"}} @ {_AT // 10**9}'),
    f"SELECT s.b AS bucket_ns, {_SER}, round(value + 1e-7, 4) + 0.0 AS value FROM (SELECT {_SER}, arg_max(value, timestamp_ns) AS value FROM metrics"
    f" WHERE timestamp_ns BETWEEN {_AT - 300 * 10**9} AND {_AT} AND NOT contains(metric_name, '_')"
    f" GROUP BY ALL), (SELECT unnest(range({START}::BIGINT, {END}::BIGINT, {DAY}::BIGINT)) AS b) s",
    "metrics",
)
_SUBWIN = f"FROM (SELECT unnest(range({START}::BIGINT, {END}::BIGINT, {DAY}::BIGINT)) AS b), (SELECT timestamp_ns - timestamp_ns % {DAY // 4} AS t, service_name, sum(value) AS v FROM metrics WHERE timestamp_ns BETWEEN {START - 2 * DAY} AND {END} AND metric_name = 'view' GROUP BY ALL) WHERE t > b - {2 * DAY} AND t <= b GROUP BY ALL"
_add(
    "m05_subquery",
    _prom("max_over_time((sum by (service) (view))[2d:6h])"),
    f"SELECT b AS bucket_ns, '' AS metric_name, service_name, round(max(v) + 1e-7, 4) + 0.0 AS value {_SUBWIN}",
    "metrics",
)
_p("m06_rate", "rate(view[1m])", "(arg_max(value, timestamp_ns) - arg_min(value, timestamp_ns)) / 60.0")
_p("m06_increase", "increase(view_total[5m])", "arg_max(value, timestamp_ns) - arg_min(value, timestamp_ns)", "'view_total'")
_p("m06_delta", "delta(view[1h])", "arg_max(value, timestamp_ns) - arg_min(value, timestamp_ns)")
_p("m07_deriv", "deriv(view_total[1d])", "CASE WHEN count(*) > 1 THEN regr_slope(value, (timestamp_ns / 1000000000.0) - 1704067200) END", "'view_total'")
_TWO = f"WITH {ORACLE['metrics']}, o AS (SELECT {_B} AS bucket_ns, {_SER}, value, timestamp_ns, row_number() OVER (PARTITION BY {_B}, {_SER} ORDER BY timestamp_ns DESC) AS k {_PM}'view'), w AS (SELECT bucket_ns, {_SER}, max(value) FILTER (k = 1) - max(value) FILTER (k = 2) AS d, (max(timestamp_ns) FILTER (k = 1) - max(timestamp_ns) FILTER (k = 2)) / 1e9 AS s, count(*) AS n FROM o WHERE k <= 2 GROUP BY ALL) SELECT bucket_ns, {_SER}, round(EXPR + 1e-7, 4) + 0.0 AS value FROM w WHERE n = 2"
_add("m08_idelta", _prom("idelta(view[1d])"), _TWO.replace("EXPR", "d"))
_add("m08_irate", _prom("irate(view[1d])"), _TWO.replace("EXPR", "d / s"))
for _fn, _sql in {"avg": "avg(value)", "sum": "sum(value)", "min": "min(value)", "max": "max(value)", "count": "count(*)::DOUBLE", "last": "arg_max(value, timestamp_ns)", "stddev": "stddev_pop(value)", "stdvar": "var_pop(value)", "present": "1.0::DOUBLE"}.items():
    _p(f"m09_{_fn}_over_time", f"{_fn}_over_time(view[1d])", _sql)
_p("m10_quantile_over_time", "quantile_over_time(0.9, view[1d])", "quantile_cont(value, 0.9)")
_SEQ = f"WITH {ORACLE['metrics']}, o AS (SELECT {_B} AS bucket_ns, metric_name, service_name, value, lag(value) OVER (PARTITION BY {_B}, metric_name, service_name ORDER BY timestamp_ns, value) AS p {_PM}'view') SELECT bucket_ns, metric_name, service_name, (count(*) FILTER (EXPR))::DOUBLE AS value FROM o GROUP BY ALL"
_add("m11_resets", _prom("resets(view[1d])"), _SEQ.replace("EXPR", "p > value"))
_add("m11_changes", _prom("changes(view[1d])"), _SEQ.replace("EXPR", "p <> value"))
_ABS = f"SELECT b AS bucket_ns, '' AS metric_name, 'svc-3' AS service_name, 1.0::DOUBLE AS value FROM (SELECT unnest(range({START}::BIGINT, {END}::BIGINT, {DAY // 12}::BIGINT)) AS b) ANTI JOIN (SELECT timestamp_ns - timestamp_ns % {DAY // 12} AS b FROM metrics WHERE {_W} AND metric_name = 'view' AND service_name = 'svc-3') USING (b)"
_add("m12_absent", _prom('absent(view{service="svc-3"})', DAY // 12), _ABS, "metrics")
_add("m12_absent_over_time", _prom('absent_over_time(view{service="svc-3"}[2h])', DAY // 12), _ABS, "metrics")
for _fn, _sql in {"sum": "sum(value)", "avg": "avg(value)", "min": "min(value)", "max": "max(value)", "count": "count(*)::DOUBLE", "stddev": "stddev_pop(value)", "stdvar": "var_pop(value)", "group": "1.0::DOUBLE"}.items():
    _p(f"m13_{_fn}", f"{_fn} by (service) (view)", _sql, group="metric_name, service_name")
_p("m13_sum_all", "sum(view)", "sum(value)", group="metric_name")
_p("m13_without", "sum without (env) (view)", "sum(value)", group="metric_name, service_name")
_p("m13_by_label", "sum by (env) (view)", "sum(value)", group="metric_name, label_env")
_p("m14_quantile", "quantile(0.9, view)", "quantile_cont(value, 0.9)", group="metric_name")
for _fn, _dir in {"topk": "DESC", "bottomk": "ASC"}.items():
    _add(
        f"m15_{_fn}",
        _prom(f"{_fn}(3, view)"),
        f"SELECT bucket_ns, {_SER}, round(value + 1e-7, 4) + 0.0 AS value FROM ({_LAST}) QUALIFY row_number() OVER (PARTITION BY bucket_ns"
        f" ORDER BY value {_dir}, metric_name, service_name, label_env NULLS FIRST) <= 3",
        "metrics",
    )
_add(
    "m16_count_values",
    _prom('count_values("v", floor(view))'),
    f"SELECT bucket_ns, floor(value)::BIGINT::VARCHAR AS service_name, count(*)::DOUBLE AS value FROM ({_LAST}) GROUP BY 1, 2",
    "metrics",
)
_add(
    "m17_outer",
    _prom("sum by (service) (avg_over_time(view[1d]))"),
    f"SELECT bucket_ns, metric_name, service_name, round(sum(value) + 1e-7, 4) + 0.0 AS value FROM (SELECT {_B} AS bucket_ns, {_SER}, avg(value)"
    f" AS value {_PM}'view' GROUP BY ALL) GROUP BY 1, 2, 3",
    "metrics",
)
for _n, (_text, _sql) in {"add": ("view + 1", "value + 1"), "sub_left": ("100 - view", "100 - value"), "mul": ("view * 2.5", "value * 2.5"), "div_zero": ("view / 0", "CASE WHEN value > 0 THEN 'inf'::DOUBLE WHEN value < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END"), "mod": ("view % 7", "fmod(value, 7)"), "pow": ("view ^ 2", "pow(value, 2)"), "precedence": ("view * 2 + 3 ^ 2", "value * 2 + 9"), "negated": ("-view", "-value")}.items():
    _add(f"m18_{_n}", _prom(_text), f"SELECT bucket_ns, {_SER}, round({_sql} + 1e-7, 4) + 0.0 AS value FROM ({_LAST})", "metrics")
_add("m19_filter", _prom("view > 20"), f"SELECT bucket_ns, {_SER}, round(value + 1e-7, 4) + 0.0 AS value FROM ({_LAST}) WHERE value > 20", "metrics")
_add("m19_bool", _prom("view > bool 20"), f"SELECT bucket_ns, {_SER}, (value > 20)::INT::DOUBLE AS value FROM ({_LAST})", "metrics")
_SUMS = lambda metric, cond="": f"(SELECT {_B} AS bucket_ns, metric_name, service_name, sum(value) AS value FROM metrics WHERE {_W} AND metric_name = '{metric}'{cond} GROUP BY ALL)"
_L, _R = "sum by (service) (view)", "sum by (service) (click)"
_J = f"FROM {_SUMS('view')} l JOIN {_SUMS('click')} r USING (bucket_ns, service_name)"
for _n, _op in {"add": "+", "sub": "-", "mul": "*", "div": "/"}.items():
    _add(f"m20_{_n}", _prom(f"{_L} {_op} {_R}"), f"SELECT bucket_ns, service_name, round(l.value {_op} r.value + 1e-7, 4) + 0.0 AS value {_J}", "metrics")
_add(
    "m21_compare",
    _prom(f"{_L} > {_R}"),
    f"SELECT bucket_ns, l.metric_name, service_name, round(l.value + 1e-7, 4) + 0.0 AS value {_J} WHERE l.value > r.value",
    "metrics",
)
_add("m21_bool", _prom(f"{_L} > bool {_R}"), f"SELECT bucket_ns, service_name, (l.value > r.value)::INT::DOUBLE AS value {_J}", "metrics")
_SPARSE, _SPSQL = 'sum by (service) (click{k=~"^[1-3]$"})', _SUMS("click", " AND k IN ('1', '2', '3')")
_add(
    "m22_and",
    _prom(f"{_L} and {_SPARSE}"),
    f"SELECT l.bucket_ns, l.metric_name, l.service_name, round(l.value + 1e-7, 4) + 0.0 AS value FROM {_SUMS('view')} l SEMI"
    f" JOIN {_SPSQL} r USING (bucket_ns, service_name)",
    "metrics",
)
_add(
    "m22_unless",
    _prom(f"{_L} unless {_SPARSE}"),
    f"SELECT l.bucket_ns, l.metric_name, l.service_name, round(l.value + 1e-7, 4) + 0.0 AS value FROM {_SUMS('view')} l ANTI"
    f" JOIN {_SPSQL} r USING (bucket_ns, service_name)",
    "metrics",
)
_add(
    "m22_or",
    _prom(f"{_SPARSE} or {_L}"),
    f"SELECT bucket_ns, metric_name, service_name, round(value + 1e-7, 4) + 0.0 AS value FROM {_SPSQL}"
    f" UNION ALL SELECT l.bucket_ns, l.metric_name, l.service_name, round(l.value + 1e-7, 4) + 0.0 FROM {_SUMS('view')} l ANTI"
    f" JOIN {_SPSQL} r USING (bucket_ns, service_name)",
    "metrics",
)
for _fn, _sql in {"abs": "abs(value - 20)", "ceil": "ceil(value - 20)", "floor": "floor(value - 20)", "round": "floor(value - 20 + 0.5)", "sgn": "sign(value - 20)"}.items():
    _add(f"m23_{_fn}", _prom(f"{_fn}(view - 20)"), f"SELECT bucket_ns, {_SER}, round({_sql} + 1e-7, 4)::DOUBLE + 0.0 AS value FROM ({_LAST})", "metrics")
for _fn, _sql in {"sqrt": "sqrt(value)", "exp": "exp(value / 100)", "ln": "ln(value + 1)", "log2": "log2(value + 1)", "log10": "log10(value + 1)"}.items():
    _text = {"sqrt": "sqrt(view)", "exp": "exp(view / 100)"}.get(_fn, f"{_fn}(view + 1)")
    _add(f"m23_{_fn}", _prom(_text), f"SELECT bucket_ns, {_SER}, round({_sql} + 1e-7, 4) + 0.0 AS value FROM ({_LAST})", "metrics")
for _fn, _sql in {"clamp(view, 5, 30)": "least(greatest(value, 5), 30)", "clamp_min(view, 5)": "greatest(value, 5)", "clamp_max(view, 30)": "least(value, 30)"}.items():
    _add("m23_" + _fn.split("(")[0], _prom(_fn), f"SELECT bucket_ns, {_SER}, round({_sql} + 1e-7, 4) + 0.0 AS value FROM ({_LAST})", "metrics")


def _ranked(query):
    """Each row's place in its bucket, by the order that rows come in."""

    def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = query(spark, sf_dir).withColumn("at", F.monotonically_increasing_id())
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("bucket_ns").orderBy("at")).cast("long")).drop("at")

    return ordered


_add(
    "m24_sort",
    _ranked(_prom("sort_desc(view)")),
    f"SELECT bucket_ns, {_SER}, round(value + 1e-7, 4) + 0.0 AS value, row_number() OVER (PARTITION BY bucket_ns"
    f" ORDER BY value DESC, metric_name, service_name, label_env NULLS FIRST) AS rank FROM ({_LAST})",
    "metrics",
)
_add(
    "m25_label_replace",
    _prom('label_replace(view, "service", "team-$1", "service", "svc-([0-4])")'),
    f"SELECT bucket_ns, metric_name, CASE"
    f" WHEN regexp_full_match(service_name, 'svc-([0-4])') THEN 'team-' || substr(service_name, 5) ELSE service_name END AS service_name, label_env"
    f", round(value + 1e-7, 4) + 0.0 AS value FROM ({_LAST})",
    "metrics",
)
_add(
    "m25_label_join",
    _prom('label_join(view, "service", "/", "__name__", "service")'),
    f"SELECT bucket_ns, metric_name, metric_name || '/' || service_name AS service_name, label_env, round(value + 1e-7, 4) + 0.0 AS value FROM ({_LAST})",
    "metrics",
)
_STEPS = f"(SELECT unnest(range({START}::BIGINT, {END}::BIGINT, {DAY}::BIGINT)) AS bucket_ns)"
_add("m26_vector", _prom("vector(3)"), f"SELECT bucket_ns, '' AS metric_name, '' AS service_name, 3.0::DOUBLE AS value FROM {_STEPS}")
_add("m26_time", _prom("time()"), f"SELECT bucket_ns, '' AS metric_name, '' AS service_name, bucket_ns / 1e9 AS value FROM {_STEPS}")
_add(
    "m27_scalar",
    _prom("scalar(sum(view))"),
    f"SELECT {_B} AS bucket_ns, '' AS metric_name, '' AS service_name, round(sum(value) + 1e-7, 4) + 0.0 AS value {_PM}'view' GROUP BY 1",
    "metrics",
)
_p("m28_timestamp", "timestamp(view)", "max(timestamp_ns) / 1e9")
for _fn, _sql in {"day_of_week": "dayofweek(t)", "day_of_month": "day(t)", "day_of_year": "dayofyear(t)", "days_in_month": "day(last_day(t))", "hour": "hour(t)", "minute": "minute(t)", "month": "month(t)", "year": "year(t)"}.items():
    _add(
        f"m29_{_fn}",
        _prom(f"{_fn}()"),
        f"SELECT bucket_ns, '' AS metric_name, '' AS service_name, ({_sql})::DOUBLE AS value FROM (SELECT bucket_ns, make_timestamp(bucket_ns // 1000) AS t"
        f" FROM {_STEPS})",
    )
_WIDE = {"step": DAY * 30, "start": ALL_START, "end": ALL_END}
for _fn, _c in {"count": "cnt", "sum": "total"}.items():
    _add(
        f"m30_histogram_{_fn}",
        _prom(f"histogram_{_fn}(quantity)", **_WIDE),
        f"SELECT timestamp_ns - timestamp_ns % {DAY * 30} AS bucket_ns, 'quantity' AS metric_name, service_name, round(sum({_c})::DOUBLE + 1e-7, 4) + 0.0"
        f" AS value FROM hist WHERE timestamp_ns BETWEEN {ALL_START} AND {ALL_END} GROUP BY 1, 2, 3",
        "hist",
    )
_add("m31_histogram_quantile", _prom("histogram_quantile(0.7, quantity)", **_WIDE), f"WITH {ORACLE['hist']}{_HQ.replace('VALUE', 'value')}")
_add(
    "m32_histogram_fraction",
    _prom("histogram_fraction(5, 25, quantity)", **_WIDE),
    f"WITH {ORACLE['hist']}, {_H.replace('PHI', '0.5')} SELECT bucket_ns, metric_name, service_name, round((c0 * 0.5 + c1 + c2 * 0.5) / t + 1e-7, 4) + 0.0"
    f" AS value FROM q",
)
_add(
    "m34_instant",
    _prom("sum by (service) (view)", instant=True),
    f"SELECT {END}::BIGINT AS bucket_ns, metric_name, service_name, round(value + 1e-7, 4) + 0.0 AS value"
    f" FROM (SELECT timestamp_ns - timestamp_ns % {DAY // 24} AS b, metric_name, service_name, sum(value) AS value FROM metrics"
    f" WHERE timestamp_ns BETWEEN {END - DAY // 24} AND {END} AND metric_name = 'view' GROUP BY ALL)"
    f" QUALIFY row_number() OVER (PARTITION BY metric_name, service_name ORDER BY b DESC) = 1",
    "metrics",
)
_add(
    "m35_labels",
    lambda s, d: promql.labels(signals.catalog(s, d)),
    "SELECT unnest(['__name__', 'job', 'service_name']) AS label UNION SELECT 'k' FROM metrics WHERE k IS NOT NULL UNION SELECT 'deployment.environment'"
    " FROM ev WHERE env IS NOT NULL",
    "metrics",
)
_add("m35_label_values", lambda s, d: promql.label_values(signals.catalog(s, d), "__name__"), "SELECT DISTINCT metric_name AS value FROM metrics", "metrics")

# --- LogQL --------------------------------------------------------------------------------------


def _logql(text: str, step: int = DAY):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = logql.query_range(spark, signals.catalog(spark, sf_dir), text, START, END, step)
        return m.frame.withColumn("value", _rounded("value"))

    return query


def _lines(text: str, limit: int = 50):
    return lambda s, d: logql.lines(signals.catalog(s, d), text, START, END, limit).select("timestamp_ns", "service_name", "severity_text", "body", "span_id")


def _lsql(cond: str, limit: int = 50) -> str:
    return f"SELECT timestamp_ns, service_name, severity_text, body, span_id FROM logs WHERE {_W} AND {cond} ORDER BY timestamp_ns DESC, body, span_id LIMIT {limit}"


for _n, (_text, _sql) in {
    "l02_lines": ('{service_name="svc-1"}', "service_name = 'svc-1'"),
    "l03_matchers": ('{job=~"svc-[12]", level!="info", level!="INFO"}', "regexp_matches(service_name, 'svc-[12]') AND severity_text NOT IN ('info', 'INFO')"),
    "l03_attribute_ne": ('{service_name=~".+", k!="7"}', "k <> '7'"),
    "l03_absent_ne": ('{service_name=~".+", nothing!="x"}', "true"),
    "l04_contains": ('{service_name=~".+"} |= "error" != "\\"k\\": 1"', "body LIKE '%error%' AND body NOT LIKE '%\"k\": 1%'"),
    "l04_regex": ('{service_name=~".+"} |~ "k.: [0-4]}" !~ "view|click"', "regexp_matches(body, 'k.: [0-4]}') AND NOT regexp_matches(body, 'view|click')"),
    "l05_label_filter": ('{service_name=~".+"} | k > 90 and level="ERROR" or k == 3', "(k::DOUBLE > 90 AND severity_text = 'ERROR' OR k::DOUBLE = 3)"),
    "l06_pass_through": ('{service_name="svc-2"} | json | line_format "{{.x}}" | drop k', "service_name = 'svc-2'"),
}.items():
    _add(_n, _lines(_text), _lsql(_sql), "logs")

_LS = "service_name, severity_text"
_LQ = f"FROM logs WHERE {_W}"
for _n, (_text, _sql) in {
    "l07_count": ('count_over_time({job=~".+"}[1d])', "count(*)::DOUBLE"), "l07_rate": ('rate({job=~".+"}[1d])', "count(*) / 86400.0"),
    "l08_bytes": ('bytes_over_time({job=~".+"}[1d])', "sum(length(body))::DOUBLE"), "l08_bytes_rate": ('bytes_rate({job=~".+"}[1d])', "sum(length(body)) / 86400.0"),
    **{f"l09_{f}": (f'{f}_over_time({{job=~".+"}} | unwrap duration [1d])', q) for f, q in {"sum": "sum(duration)", "avg": "avg(duration)", "min": "min(duration)", "max": "max(duration)", "stddev": "stddev_pop(duration)", "stdvar": "var_pop(duration)", "first": "arg_min(duration, timestamp_ns)", "last": "arg_max(duration, timestamp_ns)"}.items()},
    "l10_quantile": ('quantile_over_time(0.9, {job=~".+"} | unwrap duration [1d])', "quantile_disc(duration, 0.9)"),
}.items():
    _add(_n, _logql(_text), f"SELECT {_B} AS bucket_ns, {_LS}, round({_sql} + 1e-7, 4) + 0.0 AS value {_LQ} GROUP BY ALL", "logs")
_add(
    "l11_sum_by",
    _logql('sum by (job) (count_over_time({job=~".+"}[1d]))'),
    f"SELECT {_B} AS bucket_ns, service_name, count(*)::DOUBLE AS value {_LQ} GROUP BY ALL",
    "logs",
)
_COUNTED = f"(SELECT {_B} AS bucket_ns, {_LS}, count(*)::DOUBLE AS value {_LQ} GROUP BY ALL)"
for _fn, _sql in {"avg": "avg(value)", "min": "min(value)", "max": "max(value)", "count": "count(*)::DOUBLE", "stddev": "stddev_pop(value)", "stdvar": "var_pop(value)"}.items():
    _add(
        f"l12_{_fn}",
        _logql(f'{_fn}(count_over_time({{job=~".+"}}[1d]))'),
        f"SELECT bucket_ns, round({_sql} + 1e-7, 4) + 0.0 AS value FROM {_COUNTED} GROUP BY 1",
        "logs",
    )
for _fn, _dir in {"topk": "DESC", "bottomk": "ASC"}.items():
    _add(
        f"l13_{_fn}",
        _logql(f'{_fn}(3, count_over_time({{job=~".+"}}[1d]))'),
        f"SELECT bucket_ns, {_LS}, value FROM {_COUNTED} QUALIFY row_number() OVER (PARTITION BY bucket_ns ORDER BY value {_dir}, service_name, severity_text) <= 3",
        "logs",
    )
_add(
    "l14_sort",
    _ranked(_logql('sort_desc(count_over_time({job=~".+"}[1d]))')),
    f"SELECT bucket_ns, {_LS}, value, row_number() OVER (PARTITION BY bucket_ns ORDER BY last DESC, service_name, severity_text) AS rank"
    f" FROM (SELECT *, last_value(value) OVER (PARTITION BY {_LS} ORDER BY bucket_ns ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last"
    f" FROM {_COUNTED})",
    "logs",
)
for _n, (_text, _sql) in {"mul": ('count_over_time({job=~".+"}[1d]) * 2', "value * 2"), "left": ('100 - count_over_time({job=~".+"}[1d])', "100 - value"), "div": ('count_over_time({job=~".+"}[1d]) / 4', "value / 4")}.items():
    _add(f"l15_{_n}", _logql(_text), f"SELECT bucket_ns, {_LS}, round({_sql} + 1e-7, 4) + 0.0 AS value FROM {_COUNTED}", "logs")
_BYJOB = lambda cond: f"(SELECT {_B} AS bucket_ns, service_name, count(*)::DOUBLE AS value {_LQ} AND {cond} GROUP BY ALL)"
_E, _N = 'sum by (job) (count_over_time({level="ERROR"}[1d]))', 'sum by (job) (count_over_time({level="WARN"}[1d]))'
_LJ = f"FROM {_BYJOB(chr(115) + 'everity_text = ' + chr(39) + 'ERROR' + chr(39))} l JOIN {_BYJOB('severity_text = ' + chr(39) + 'WARN' + chr(39))} r USING (bucket_ns, service_name)"
for _n, _op in {"add": "+", "sub": "-", "mul": "*", "div": "/"}.items():
    _add(f"l16_{_n}", _logql(f"{_E} {_op} {_N}"), f"SELECT bucket_ns, service_name, round(l.value {_op} r.value + 1e-7, 4) + 0.0 AS value {_LJ}", "logs")
_add("l17_compare", _logql(f"{_E} > {_N}"), f"SELECT bucket_ns, service_name, l.value AS value {_LJ} WHERE l.value > r.value", "logs")
_add("l17_bool", _logql(f"{_E} >= bool {_N}"), f"SELECT bucket_ns, service_name, (l.value >= r.value)::INT::DOUBLE AS value {_LJ}", "logs")
_RARE, _RSQL = 'sum by (job) (count_over_time({k="7"}[1d]))', _BYJOB("k = '7'")
_ERRS = _BYJOB("severity_text = 'ERROR'")
_add("l18_and", _logql(f"{_E} and {_RARE}"), f"SELECT l.bucket_ns, l.service_name, l.value FROM {_ERRS} l SEMI JOIN {_RSQL} r USING (bucket_ns, service_name)", "logs")
_add(
    "l18_unless",
    _logql(f"{_E} unless {_RARE}"),
    f"SELECT l.bucket_ns, l.service_name, l.value FROM {_ERRS} l ANTI JOIN {_RSQL} r USING (bucket_ns, service_name)",
    "logs",
)
_add(
    "l18_or",
    _logql(f"{_RARE} or {_E}"),
    f"SELECT bucket_ns, service_name, value FROM {_RSQL} UNION ALL SELECT l.bucket_ns, l.service_name, l.value FROM {_ERRS} l ANTI"
    f" JOIN {_RSQL} r USING (bucket_ns, service_name)",
    "logs",
)
_add(
    "l19_label_replace",
    _logql(f'label_replace({_E}, "team", "t$1", "job", "svc-([0-4])")'),
    f"SELECT bucket_ns, service_name, value, CASE WHEN regexp_full_match(service_name, 'svc-([0-4])') THEN 't' || substr(service_name, 5) END AS team FROM {_ERRS}",
    "logs",
)
_add("l20_vector", _logql("vector(2)"), f"SELECT bucket_ns, 2.0::DOUBLE AS value FROM {_STEPS}")
_add("l22_label_values", lambda s, d: logql.label_values(signals.catalog(s, d), "level", START, END), f"SELECT DISTINCT severity_text AS value {_LQ}", "logs")
_add(
    "l23_detected_fields",
    lambda s, d: logql.detected_fields(signals.catalog(s, d), START, END),
    f"WITH {ORACLE['logs']}, n AS (SELECT event_type, k {_LQ}"
    f" ORDER BY timestamp_ns DESC, span_id LIMIT 1000) SELECT 'event.type' AS label, 'string' AS type, count(DISTINCT event_type) AS cardinality FROM n"
    f" UNION ALL SELECT 'k', 'int', count(DISTINCT k) FROM n",
)
_add(
    "l24_streams",
    lambda s, d: logql.streams(logql.lines(signals.catalog(s, d), '{job=~".+"}', START, END, 200)).select("service_name", "level", F.posexplode("entries").alias("place", "e")).select("service_name", "level", F.col("place").cast("long").alias("place"), "e.timestamp_ns", "e.body", "e.metadata"),
    f"""SELECT service_name, severity_text AS level, row_number() OVER (PARTITION BY service_name, severity_text ORDER BY timestamp_ns DESC, body DESC, metadata DESC) - 1 AS place, timestamp_ns, body, metadata
    FROM (SELECT *, '{{' || coalesce('"deployment.environment":"' || env || '",', '') || '"event.type":"' || event_type || '"' || coalesce(',"k":"' || k || '"', '') || '}}' AS metadata FROM (SELECT * {_LQ} ORDER BY timestamp_ns DESC, body, span_id LIMIT 200))""",
    "logs",
)

# --- Traces -------------------------------------------------------------------------------------


def _search(text: str, limit: int = 20, **more):
    return lambda s, d: traceql.search(signals.catalog(s, d), traceql.parse(text), ALL_START, ALL_END, limit, **more)


def _ssql(cond: str, limit: int = 20) -> str:
    return f"SELECT trace_id, max(start_ns) AS newest_ns, count(*) AS n_spans, max(duration_nanos) AS longest_ns FROM (SELECT * FROM traces WHERE {_T} AND {cond} ORDER BY start_ns DESC, trace_id, span_id LIMIT {limit * 50}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {limit}"


for _n, (_text, _sql) in {
    "r02_status": ('{ status = error && service.name = "shop" }', "status_code = 'Error' AND service_name = 'shop'"), "r02_kind": ("{ kind = client }", "span_kind = 'Client'"),
    "r02_span_attribute": ('{ span.part = "7" }', "part = '7'"), "r02_any_attribute": ('{ .order.priority = "2-HIGH" }', "priority = '2-HIGH'"), "r02_resource": ('{ resource.service.name = "supp-3" }', "service_name = 'supp-3'"), "r05_all": ("{}", "true"),
}.items():
    _add(_n, _search(_text), _ssql(_sql), "traces")
_add(
    "r03_tags",
    lambda s, d: traceql.search(signals.catalog(s, d), traceql.tags('part=7 service.name="supp-3"'), ALL_START, ALL_END),
    _ssql("part = '7' AND service_name = 'supp-3'"),
    "traces",
)
_add("r04_duration", _search("{}", min_duration=40_000_000, max_duration=45_000_000), _ssql("duration_nanos BETWEEN 40000000 AND 45000000"), "traces")
_add(
    "r06_trace",
    lambda s, d: traceql.trace(signals.catalog(s, d), "t42").select("trace_id", "span_id", "parent_span_id", "span_name", "start_ns", "duration_nanos"),
    "SELECT trace_id, span_id, parent_span_id, span_name, start_ns, duration_nanos FROM traces WHERE trace_id = 't42'",
    "traces",
)
_add(
    "r08_tag_values",
    lambda s, d: traceql.tag_values(signals.catalog(s, d), "order.priority"),
    "SELECT DISTINCT priority AS value FROM traces WHERE priority IS NOT NULL",
    "traces",
)
_add("r08_root_names", lambda s, d: traceql.tag_values(signals.catalog(s, d), "rootName"), "SELECT DISTINCT span_name AS value FROM traces WHERE is_root", "traces")
_RED = [{"aggregate": {"by": ["service.name"], "aggs": [{"fn": "count", "as": "requests"}, {"fn": "count", "as": "errors", "where": {"field": "status.code", "op": "eq", "value": "Error"}}, {"fn": "quantile", "of": "duration", "arg": 0.5, "as": "p50"}, {"fn": "quantile", "of": "duration", "arg": 0.95, "as": "p95"}]}}]
_add(
    "r09_red",
    _ir("traces", _RED, "table", start=ALL_START, end=ALL_END),
    "SELECT service_name, count(*) AS requests, count(*) FILTER (status_code = 'Error') AS errors, quantile_disc(duration_nanos, 0.5)::DOUBLE AS p50,"
    f" quantile_disc(duration_nanos, 0.95)::DOUBLE AS p95 FROM traces WHERE {_T} GROUP BY 1",
    "traces",
)
_add(
    "r09_red_exact",
    _ir("traces", _RED, "table", start=ALL_START, end=ALL_END, round_=("p50", "p95"), exact=True),
    "SELECT service_name, count(*) AS requests, count(*) FILTER (status_code = 'Error') AS errors, round(quantile_cont(duration_nanos, 0.5), 4) AS p50,"
    f" round(quantile_cont(duration_nanos, 0.95), 4) AS p95 FROM traces WHERE {_T} GROUP BY 1",
    "traces",
)

# --- Profiles, attributes, storage --------------------------------------------------------------

_add(
    "f04_prefixes",
    lambda s, d: profiles.prefixes(signals.profiles(s, d)).select(F.concat_ws("/", "path").alias("path"), F.col("depth").cast("long").alias("depth"), "total", "self"),
    "SELECT array_to_string(stack[1:n], '/') AS path, n AS depth, sum(value)::BIGINT AS total, (sum(value) FILTER (n = 4))::BIGINT AS self FROM profiles, (SELECT unnest(range(1, 5)) AS n) GROUP BY 1, 2".replace("(sum(value) FILTER (n = 4))::BIGINT", "coalesce(sum(value) FILTER (n = 4), 0)::BIGINT"),
    "profiles",
)
_HALF = 900000000 * 10**9
_add(
    "f06_diff",
    lambda s, d: profiles.diff(signals.profiles(s, d).where(F.col("timestamp_ns") < _HALF), signals.profiles(s, d).where(F.col("timestamp_ns") >= _HALF)).select(F.concat_ws("/", "path").alias("path"), "left_total", "right_total"),
    f"SELECT array_to_string(stack[1:n], '/') AS path, coalesce(sum(value) FILTER (timestamp_ns < {_HALF}), 0)::BIGINT AS left_total, coalesce(sum(value) FILTER (timestamp_ns >= {_HALF}), 0)::BIGINT AS right_total"
    f" FROM profiles, (SELECT unnest(range(1, 5)) AS n) GROUP BY 1",
    "profiles",
)
_STATS = lambda s, d: stats.attribute_stats(signals.logs(s, d), ("log_attributes",), top=3)


def _shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs whose resource and scope have keys that records have too, with the same value or another."""
    own = F.create_map(F.lit("k"), F.when(F.col("span_id").endswith("3"), F.col("log_attributes")["k"]).otherwise("none"), F.lit("env"), F.col("label_env"))
    return signals.logs(spark, sf_dir).withColumns({"resource_attributes": own, "scope_attributes": F.create_map(F.lit("env"), F.lit("any"))})


def _stats_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.attribute_stats(_shared_keys(spark, sf_dir), ("log_attributes", "scope_attributes", "resource_attributes"), top=3)
    return found.select("key", "present", F.col("n_distinct").cast("long").alias("n_distinct"), "capped", F.to_json(F.transform("top", lambda t: F.struct(t["value"].alias("value"), t["count"].alias("count")))).alias("top"))


_SHARED = """, kv AS (SELECT DISTINCT event_id, key, v FROM (SELECT event_id, 'k' AS key, k AS v FROM logs UNION ALL SELECT event_id, 'event.type', event_type FROM logs UNION ALL SELECT event_id, 'env', 'any' FROM logs UNION ALL SELECT event_id, 'env', env FROM logs
  UNION ALL SELECT event_id, 'k', CASE WHEN event_id::VARCHAR LIKE '%3' THEN k ELSE 'none' END FROM logs)),
c AS (SELECT key, v, count(*) AS n FROM kv WHERE v IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, v) AS rank FROM c)"""
_add("as1_attribute_stats", _stats_rows, f"""WITH {ORACLE['logs']}{_SHARED} SELECT key, (SELECT count(DISTINCT event_id) FROM kv WHERE kv.key = r.key) AS present, count(*) AS n_distinct, false AS capped,
  '[' || string_agg('{{"value":"' || v || '","count":' || n || '}}', ',' ORDER BY rank) FILTER (rank <= 3) || ']' AS top FROM r GROUP BY key""")
_add(
    "as3_generated",
    lambda s, d: signals._read(s, d, "events").select("event_id", stats.generated_key(F.concat(F.lit("key"), F.col("event_id").cast("string"), F.lit("00000"))).alias("generated")),
    "SELECT event_id, regexp_matches('key' || event_id || '00000', '[0-9]{8}|[0-9a-fA-F]{12}') AS generated FROM events",
)
_add(
    "as5_candidates",
    lambda s, d: (lambda lg: stats.candidates(stats.attribute_stats(lg, ("log_attributes", "resource_attributes")), lg.count()).withColumn("presence", F.round("presence", 4)))(signals.logs(s, d)),
    "SELECT 'k' AS key, round(count(k) / count(*), 4) AS presence FROM logs UNION ALL SELECT 'event.type', 1.0::DOUBLE"
    " UNION ALL SELECT 'deployment.environment', round(count(env) / count(*), 4) FROM logs",
    "logs",
)
_add(
    "t05_labels",
    lambda s, d: transforms.materialised(signals.logs(s, d).drop("label_env"), ["deployment.environment", "k"]).select("span_id", "label_deployment_environment", "label_k"),
    "SELECT span_id, env AS label_deployment_environment, k AS label_k FROM logs",
    "logs",
)
_add(
    "t06_tokens",
    lambda s, d: transforms.attr_tokens(signals.logs(s, d)).select("span_id", F.array_join(F.array_sort("attr_tokens"), ",").alias("tokens")),
    "SELECT span_id, concat_ws(',', 'deployment.environment=' || env, 'event.type=' || event_type, 'k=' || k) AS tokens FROM logs",
    "logs",
)
_SUFFIXES = ("_total", "_bucket", "_count", "_sum", "_created", "_info", "", "_totals")
_add(
    "s10_remote_write_kind",
    lambda s, d: (
        signals._events(s, d)
        .select(F.concat("event_type", F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("event_id") % len(_SUFFIXES) + 1).cast("int"))).alias("metric_name"))
        .groupBy("metric_name", remote_write.kind(F.col("metric_name")).alias("kind"))
        .agg(F.count(F.lit(1)).alias("n"))
    ),
    f"SELECT event_type || ([{', '.join(repr(x) for x in _SUFFIXES)}])[event_id % {len(_SUFFIXES)} + 1] AS metric_name, CASE event_id % 8 WHEN 0 THEN 'sum' WHEN 1 THEN 'histogram'"
    " WHEN 2 THEN 'sum' WHEN 3 THEN 'sum' WHEN 4 THEN 'sum' ELSE 'gauge' END AS kind, count(*) AS n FROM events GROUP BY 1, 2",
)
_add(
    "h04_arrays",
    lambda s, d: signals.metrics_histogram(s, d).select("timestamp_ns", "service_name", F.aggregate(histogram.number_array(F.col("bucket_counts")), F.lit(0.0), lambda a, x: a + x).alias("n")),
    "SELECT timestamp_ns, service_name, cnt::DOUBLE AS n FROM hist",
    "hist",
)


# --- Wire formats, trees, promotion and storage ---------------------------------------------------


def _otlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = signals._read(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    line = F.concat(F.lit('{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"shop"}}]},"scopeSpans":[{"scope":{"name":"lib"},"spans":[{"traceId":"t'), key, F.lit('","spanId":"s'), key, F.lit('","name":"order","startTimeUnixNano":"'), key, F.lit('000","endTimeUnixNano":"'), key, F.lit('500","attributes":[{"key":"priority","value":{"stringValue":"'), "o_orderpriority", F.lit('"}}]}]}]}]}'))
    spans = otlp.spans(o.select(line.alias("value")))
    return spans.select("trace_id", "span_id", "service_name", "scope_name", "start_ns", "duration_nanos", "is_root", F.col("span_attributes")["priority"].alias("priority"))


_add(
    "s09_otlp",
    _otlp,
    "SELECT 't' || o_orderkey AS trace_id, 's' || o_orderkey AS span_id, 'shop' AS service_name, 'lib' AS scope_name, o_orderkey * 1000 AS start_ns, CASE"
    " WHEN o_orderkey = 0 THEN 500 ELSE 500 END::BIGINT AS duration_nanos, true AS is_root, o_orderpriority AS priority FROM orders",
)


def _le_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = signals.metrics_histogram(spark, sf_dir).withColumn("c", histogram.running(histogram.number_array(F.col("bucket_counts"))))
    le = F.array(*[F.lit(str(b)) for b in signals.BOUNDS], F.lit("+Inf"))
    each = h.select("timestamp_ns", F.lit("quantity_bucket").alias("metric_name"), "service_name", F.explode(F.arrays_zip(le.alias("le"), F.col("c").alias("value"))).alias("x"))
    return remote_write.classic_histograms(each.select("timestamp_ns", "metric_name", "service_name", "x.le", "x.value"))


_add(
    "s11_assemble",
    _le_samples,
    "SELECT timestamp_ns, 'quantity' AS metric_name, service_name, cnt AS count, '[' || concat_ws(',', c0, c1, c2, c3, c4) || ']' AS bucket_counts, '[10.0,20.0,30.0,40.0]' AS explicit_bounds"
    " FROM hist",
    "hist",
)


def _wire_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = signals.traces(spark, sf_dir).select("trace_id", "span_id", F.col("span_name").alias("name"), F.col("start_ns").cast("decimal(20,0)").alias("start_time_unix_nano"), F.to_json("span_attributes").alias("attributes_json"))
    t = transforms.traces(o)
    return t.select("trace_id", "span_id", "span_name", "start_time_unix_nano", F.date_format("date_day", "yyyy-MM-dd").alias("day"), F.col("hour").cast("long").alias("hour"), F.col("span_attributes")["part"].alias("part"))


_add(
    "t01_traces",
    _wire_spans,
    "SELECT trace_id, span_id, span_name, start_ns AS start_time_unix_nano, strftime(make_timestamp(start_ns // 1000), '%Y-%m-%d') AS day, hour(make_timestamp(start_ns // 1000)) AS hour, part"
    " FROM traces",
    "traces",
)
_add(
    "t02_logs",
    lambda s, d: transforms.logs(signals._events(s, d).select(F.when(F.col("event_id") % 2 == 0, 0).otherwise(F.col("timestamp_ns")).alias("time_unix_nano"), F.col("timestamp_ns").alias("observed_time_unix_nano"), "event_id", F.col("k").cast("binary").alias("trace_id"))).select("event_id", "timestamp_ns", "trace_id"),
    "SELECT event_id, timestamp_ns, lower(hex(k)) AS trace_id FROM ev",
    "logs",
)
_add(
    "t03_points",
    lambda s, d: transforms.number_points(signals._events(s, d).select(F.col("event_type").alias("metric_name"), "service_name", F.concat(F.lit('[{"time_unix_nano":'), F.col("timestamp_ns").cast("string"), F.lit(',"value":'), F.col("value").cast("string"), F.lit("}]")).alias("data_json"))).select("timestamp_ns", "metric_name", "service_name", "value"),
    "SELECT timestamp_ns, event_type AS metric_name, service_name, value FROM ev",
    "logs",
)


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traceql.span_trees(signals.traces(spark, sf_dir))


_add(
    "r07_hierarchy",
    _trees,
    "SELECT DISTINCT t.trace_id, t.span_id, (r.span_id IS NOT NULL)::INT::BIGINT AS depth FROM traces t LEFT JOIN (SELECT trace_id, span_id FROM traces"
    " WHERE is_root) r ON t.trace_id = r.trace_id AND t.parent_span_id = r.span_id",
    "traces",
)




_add(
    "s05_union_scan",
    lambda s, d: signals.catalog(s, d).union("acme", "prod", ("metrics_gauge", "metrics_sum")).groupBy("metric_name", "label_env").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")),
    "SELECT metric_name, label_env, count(*) AS n, round(sum(value), 2) AS total FROM metrics GROUP BY 1, 2",
    "metrics",
)
_add(
    "a18_series",
    lambda s, d: mx.series(promql.query_range(s, signals.catalog(s, d), "sum by (service) (view)", START, END, DAY)).select("metric_name", "service_name", F.size("points").cast("long").alias("n_points")),
    f"SELECT metric_name, service_name, count(DISTINCT {_B}) AS n_points FROM metrics WHERE {_W} AND metric_name = 'view' GROUP BY 1, 2",
    "metrics",
)


def _tables_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The driver's tables beside the signal tables."""
    c = signals.catalog(spark, sf_dir)
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.add("acme", "prod", t, lambda t=t: signals._read(spark, sf_dir, t))
    return c


def _sql_query(text: str):
    return lambda spark, sf_dir: sql_plan.query(spark, _tables_catalog(spark, sf_dir), text, most=None)


for _n, _text in {
    "s08_join": "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "s08_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "s08_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "s08_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "s08_cube": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "s08_window": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders",
    "s08_distinct": "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem",
    "s08_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "s08_intersect": "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders",
    "s08_union": "SELECT n_nationkey AS k, n_name AS name FROM nation UNION SELECT r_regionkey, r_name FROM region",
}.items():
    _add(_n, _sql_query(_text), _text)


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    from . import queries_storage, queries_wire  # these register with _add

    assert queries_storage and queries_wire
    return _ALL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}


@functools.cache
def flagship() -> Callable[[SparkSession, str], DataFrame]:
    return _ALL["ir_error_logs_by_service"][0]

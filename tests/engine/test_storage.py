"""Stored tables: commits, pruning, compaction, retention, evolution, and streams into them."""

import datetime
import threading

import pytest
from pyspark.sql import functions as F

from obsforge.functions.timeutil import HOUR_NS as H
from obsforge.operators import lifecycle
from obsforge.plans import ir, logql, promql, traceql
from obsforge.sources import scratch
from obsforge.sources.catalog import Catalog
from obsforge.streaming import ingest


def _logs(spark, hours, rows=20):
    return spark.createDataFrame([(h * H + i, f"s{i % 3}", "INFO", f"{h}-{i}", {"k": str(i)}) for h in hours for i in range(rows)], "timestamp_ns long, service_name string, severity_text string, body string, log_attributes map<string,string>")


def test_write_compact_expire(spark, tmp_path):
    path = f"file://{tmp_path}/logs"
    for k in range(5):
        assert lifecycle.write(_logs(spark, (-2, 1, 2, 90)), "logs", path) == k + 1
    assert lifecycle.read(spark, path).count() == 400
    plans = lifecycle.plan_compaction(spark, path, now_ns=4 * H)
    assert [p.hour for p in plans] == [-2, 1, 2]  # hour 90 is not closed
    assert lifecycle.compact(spark, path, "logs", plans[:2], labels=("k",)) == 200
    back = lifecycle.read(spark, path)
    assert back.count() == 400 and back.where("label_k = body or label_k is not null").count() == 200
    assert [p.hour for p in lifecycle.plan_compaction(spark, path, now_ns=4 * H)] == [2]
    assert len([f for f, (h, _) in lifecycle.state(spark, path).files.items() if h == 1]) == 1
    assert lifecycle.expire(spark, path, now_ns=5 * H, period_ns=H, grace_ns=H) == [-2, 1, 2]
    assert lifecycle.read(spark, path).count() == 100
    assert lifecycle.read(spark, path, version=5).count() == 400  # an older version still has its files
    gone = lifecycle.expire_snapshots(spark, path, now_ns=1 << 62, keep_ns=0)
    assert gone and lifecycle.stored_files(spark, path).count() == len(lifecycle.state(spark, path).files)
    assert lifecycle.read(spark, path).count() == 100
    assert lifecycle.retention_ns("logs", "d", "t", {"t": 3, "t/d/logs": 1}, 9) == 1
    assert lifecycle.retention_ns("traces", "d", "u", {"t": 3}, 9) == 9


def test_rows_stand_in_order_in_their_files(spark, tmp_path):
    path = f"file://{tmp_path}/logs"
    lifecycle.write(_logs(spark, (3, 1, 2)).orderBy(F.rand(4)), "logs", path)
    for f in lifecycle.state(spark, path).files:
        rows = [(r.timestamp_ns, r.service_name) for r in spark.read.parquet(f"{path}/{f}").collect()]
        assert rows == sorted(rows) and rows


def test_a_row_without_a_time_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="a row without timestamp_ns"):
        lifecycle.write(_logs(spark, (1,)).withColumn("timestamp_ns", F.lit(None).cast("long")), "logs", f"file://{tmp_path}/logs")
    with pytest.raises(FileNotFoundError):
        lifecycle.read(spark, f"file://{tmp_path}/nothing")


def test_a_crash_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/logs"
    lifecycle.write(_logs(spark, (1,)), "logs", path)
    lifecycle.write(_logs(spark, (1,)), "logs", path)
    plans = lifecycle.plan_compaction(spark, path, 9 * H, min_files=2)
    monkeypatch.setattr(lifecycle, "commit", lambda *_, **__: (_ for _ in ()).throw(KeyboardInterrupt))
    for broken in (lambda: lifecycle.write(_logs(spark, (1, 2)), "logs", path), lambda: lifecycle.compact(spark, path, "logs", plans)):
        with pytest.raises(KeyboardInterrupt):
            broken()
    monkeypatch.undo()
    assert lifecycle.read(spark, path).count() == 40  # neither lost nor doubled
    assert lifecycle.sweep(spark, path, 0) == []  # what may be a write under way stays
    assert len(lifecycle.sweep(spark, path, 1 << 62)) >= 2
    assert lifecycle.compact(spark, path, "logs", plans) == 40 and lifecycle.read(spark, path).count() == 40


def test_a_rewrite_of_files_that_have_gone_is_refused(spark, tmp_path):
    path = f"file://{tmp_path}/logs"
    for _ in range(2):
        lifecycle.write(_logs(spark, (1,)), "logs", path)
    plans = lifecycle.plan_compaction(spark, path, 9 * H, min_files=2)
    lifecycle.compact(spark, path, "logs", plans)
    with pytest.raises(lifecycle.Conflict):  # another compaction of the same hour
        lifecycle.compact(spark, path, "logs", plans)
    assert lifecycle.read(spark, path).count() == 40


def test_commits_of_many_writers(spark, tmp_path):
    path, wrong = f"file://{tmp_path}/t", []

    def one(k):
        try:
            lifecycle.commit(spark, path, add=[(f"write_id={k}/hour_bucket=1/f.parquet", 1, 5)], schema=_logs(spark, ()).schema if k < 3 else None)
        except Exception as e:  # told by the assertion below
            wrong.append(e)

    threads = [threading.Thread(target=one, args=(k,)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    now = lifecycle.state(spark, path)
    assert not wrong and len(now.files) == now.version == 8


def test_state_begins_at_a_checkpoint(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for k in range(2 * lifecycle.CHECKPOINT_EVERY + 3):
        lifecycle.commit(spark, path, add=[(f"f{k}", k, 1)], remove=[f"f{k - 1}"] if k else [], batch=("s", k))
    now = lifecycle.state(spark, path)
    assert list(now.files) == [f"f{k}"] and len(now.gone) == k and now.batches == {"s": k}
    for n in range(1, lifecycle.CHECKPOINT_EVERY):
        (tmp_path / "t" / "_log" / f"{n:012d}.json").unlink()
    assert lifecycle.state(spark, path) == now
    (tmp_path / "t" / "_log" / f"{k + 2:012d}.json").write_text('{"at_ns"')  # a commit that broke off
    with pytest.raises(RuntimeError, match="not whole"):
        lifecycle.state(spark, path)


def test_columns_come_and_go(spark, tmp_path):
    path = f"file://{tmp_path}/logs"
    rows = _logs(spark, (1,), 4)
    lifecycle.write(rows, "logs", path)
    lifecycle.write(rows.withColumns({"label_k": F.lit("x"), "extra": F.lit(1)}), "logs", path)
    assert {(r.label_k, r.extra) for r in lifecycle.read(spark, path).collect()} == {(None, None), ("x", 1)}
    lifecycle.evolve(spark, path, add=("label_z",), drop=("label_k",))
    back = lifecycle.read(spark, path)
    assert back.columns[-2:] == ["extra", "label_z"] and back.where("label_z is not null").count() == 0 and back.count() == 8
    with pytest.raises(ValueError, match="body"):
        lifecycle.write(rows.withColumn("body", F.lit(5)), "logs", path)


@pytest.fixture
def stored(spark, tmp_path):
    c = Catalog()
    logs, metrics, traces = (f"file://{tmp_path}/{t}" for t in ("logs", "metrics", "traces"))
    for hours in ((1, 2, 3), (3, 4, 5)):
        lifecycle.write(_logs(spark, hours), "logs", logs)
        points = _logs(spark, hours).select("timestamp_ns", F.lit("up").alias("metric_name"), "service_name", F.lit(1.0).alias("value"), F.col("log_attributes").alias("attributes"), F.create_map().cast("map<string,string>").alias("resource_attributes"))
        lifecycle.write(points, "metrics_gauge", metrics)
        spans = _logs(spark, hours).select(F.col("timestamp_ns").alias("start_ns"), F.col("body").alias("trace_id"), F.col("body").alias("span_id"), F.lit(5).cast("long").alias("duration_nanos"), F.lit("Client").alias("span_kind"), "service_name")
        lifecycle.write(spans, "traces", traces, bloom=("trace_id",))
    c.add_stored(spark, "acme", "prod", "logs", logs)
    c.add_stored(spark, "acme", "prod", "metrics_gauge", metrics)
    c.add_stored(spark, "acme", "prod", "traces", traces)
    return c


def test_every_language_reads_the_hours_of_its_bounds_only(spark, stored):
    low, high = 3 * H, 4 * H - 1
    doc = {"irVersion": 5, "from": "logs", "range": {"from": low, "to": high}, "result": "table", "pipeline": [{"aggregate": {"aggs": [{"fn": "count", "as": "n"}]}}]}
    frames = {
        "ir": ir.require(ir.run(doc, stored)), "promql": promql.query_range(spark, stored, "sum(up)", low, high, H).frame, "logql": logql.query_range(spark, stored, 'sum by (job) (count_over_time({job=~".+"}[1h]))', low, high, H).frame,
        "traceql": traceql.search(stored, [("kind", "client")], low, high), "lines": logql.lines(stored, '{job=~".+"}', low, high), "series": logql.series(stored, '{job=~".+"}', low, high), "metrics": promql.series(stored, "up", low, high),
    }
    for name, frame in frames.items():
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString()
        scan = next(line for line in plan.splitlines() if "FileScan" in line)
        assert "PartitionFilters: [isnotnull(hour_bucket" in scan and "hour_bucket#" in scan, name
        assert "PushedFilters: [IsNotNull(" in scan, name
    assert frames["ir"].first()["n"] == 40 and frames["promql"].first()["value"] == 40.0
    assert sum(r.value for r in frames["logql"].collect()) == 40.0 and frames["lines"].columns[-1] == "log_attributes"
    assert traceql.trace(stored, "3-7").count() == 2 and "hour_bucket" not in traceql.trace(stored, "3-7").columns


def test_bounds_leave_files_out_of_the_listing(spark, stored):
    path = None
    found = stored.find("acme", "prod", "logs")
    path = found.inputFiles()[0].split("/write_id=")[0]
    some = lifecycle.table(spark, path, 3 * H, 4 * H - 1)
    assert {f.split("hour_bucket=")[1].split("/")[0] for f in some.inputFiles()} == {"3"} and len(found.inputFiles()) > len(some.inputFiles())
    assert lifecycle.table(spark, path, 70 * H, 80 * H).count() == 0


def test_orphans(spark):
    listed = spark.createDataFrame([("a", 1), ("b", 1), ("c", 99)], "path string, modified_ns long")
    assert [r.path for r in lifecycle.orphans(listed, spark.createDataFrame([("a",)], "path string"), 50).collect()] == ["b"]


def test_stream_ingest_is_idempotent_and_part_of_the_table(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    rows = _logs(spark, (1, 2, 3))
    rows.repartition(3).write.parquet(source)
    ingest.ingest(ingest.replay(spark, source, rows.schema), "logs", out, f"{tmp_path}/c").awaitTermination()
    back = lifecycle.read(spark, out)
    assert back.count() == 60 and back.columns == rows.columns
    ingest.append_once("logs", out, "main")(rows.limit(10), 0)  # the first batch again, with other rows: it is there
    ingest.append_once("logs", out, "other")(rows.limit(10), 0)  # another stream's first batch is not
    assert lifecycle.read(spark, out).count() == 70
    lifecycle.write(_logs(spark, (2,)), "logs", out)  # batches and streams share one layout
    plans = lifecycle.plan_compaction(spark, out, 9 * H, min_files=2)
    assert plans and lifecycle.compact(spark, out, "logs", plans) > 0 and lifecycle.read(spark, out).count() == 90
    assert lifecycle.expire(spark, out, now_ns=4 * H, period_ns=H) == [1, 2]


def test_stream_rollup(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    rows = spark.createDataFrame([(60 * i, "a" if i % 2 else "b", float(i)) for i in range(120)], "s long, k string, v double").select(F.timestamp_seconds("s").alias("ts"), "k", "v")
    rows.coalesce(1).write.parquet(source)
    q = ingest.rollup(ingest.replay(spark, source, rows.schema), "ts", "1 hour", ("k",), "v").writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.bucket.hour, r.k): (r.n, r.total) for r in spark.table("rolled").collect()}
    assert got[0, "a"] == (30, float(sum(range(1, 60, 2))))
    assert len(got) == 4


def test_late_rows_are_left_out(spark, tmp_path):
    """A row older than the watermark comes too late for its window; one within it does not."""
    source = f"file://{tmp_path}/in"

    def arrive(name, *minutes):
        rows = [(datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m), "k", 1.0) for m in minutes]
        spark.createDataFrame(rows, "ts timestamp, k string, v double").coalesce(1).write.mode("append").parquet(source)
        run()

    out, schema = [], "ts timestamp, k string, v double"

    def run():
        rolled = ingest.rollup(ingest.replay(spark, source, spark.createDataFrame([], schema).schema), "ts", "1 hour", ("k",), "v", lateness="10 minutes")
        sink = lambda batch, _: out.extend((r.bucket.hour, r.n) for r in batch.collect())
        rolled.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()

    spark.createDataFrame([], schema).write.parquet(source)
    arrive("a", 5, 65)  # the watermark is at 0:55
    arrive("b", 58)  # late, but within it
    arrive("c", 200)  # closes hours 0 to 2
    arrive("d", 20, 201)  # far too late
    arrive("e", 400)
    assert out == [(0, 2), (1, 1), (3, 2)]


def test_scratch_folders_are_shared_on_a_cluster():
    from types import SimpleNamespace

    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn", getConf=lambda: conf)), "x")


def test_a_write_takes_the_room_that_its_rows_need(spark, tmp_path):
    path, settings = f"file://{tmp_path}/logs", list(lifecycle._TASK_BYTES)
    before = [spark.conf.get(k, None) for k in settings]
    lifecycle.write(_logs(spark, (1, 2), 500).withColumn("trace_id", F.col("body")), "logs", path, bloom=("trace_id",))
    files = lifecycle.state(spark, path).files
    assert len(files) == 2 and all(size < 100_000 for _, size in files.values())  # a Bloom filter of a fixed size is a megabyte
    assert lifecycle.read(spark, path).where("trace_id = '2-7'").count() == 1
    with lifecycle._small_tasks(spark):
        assert [int(spark.conf.get(k)) for k in settings] == list(lifecycle._TASK_BYTES.values())
    assert [spark.conf.get(k, None) for k in settings] == before

"""Stored tables: a folder an hour, sorted files, and a log of commits that says which files are live.

A write has a folder of its own, with a folder an hour, whose files become part of the table by one
small log entry, created only if its version is not there yet: nothing is ever renamed, writers that
lose the race try the next version, and a rewrite whose files have gone meanwhile is refused. Readers take the files that the log names, so they
see a commit whole or not at all; what a crash leaves without an entry is never read and is swept as
an orphan. Replaced and expired files stay for readers of older versions until ``expire_snapshots``.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.timeutil import HOUR_NS, within
from ..sources import scratch
from .transforms import label_name, materialised

#: The order of rows in each table's files; the first is its time.
SORT_KEYS = {
    "traces": ("start_ns", "trace_id"),
    "logs": ("timestamp_ns", "service_name", "severity_text"),
    "metrics_gauge": ("timestamp_ns", "metric_name", "service_name"),
    "metrics_sum": ("timestamp_ns", "metric_name", "service_name"),
    "metrics_histogram": ("timestamp_ns", "metric_name", "service_name"),
    "metrics_exponential_histogram": ("timestamp_ns", "metric_name", "service_name"),
    "metrics_summary": ("timestamp_ns", "metric_name", "service_name"),
    "profiles": ("timestamp_ns", "service_name"),
}
#: A whole state is written beside the log after so many entries, and reading begins there.
CHECKPOINT_EVERY = 20
#: The folder of each write is named by it.
WRITE = "write_id"
_TRIES = 50


class Conflict(RuntimeError):
    """Another commit has taken away files that this one was to replace."""


@dataclass
class State:
    """A table at a version: live files with hour and bytes, files that are gone and since when, the last batch of each stream."""

    version: int = 0
    files: dict[str, tuple[int, int]] = field(default_factory=dict)
    gone: dict[str, int] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    schema: dict | None = None

    def apply(self, version: int, entry: dict) -> None:
        self.version = version
        for name in entry.get("remove", ()):
            self.files.pop(name, None)
            self.gone[name] = entry["at_ns"]
        for name, hour, size in entry.get("add", ()):
            self.files[name] = (hour, size)
        for name in entry.get("deleted", ()):
            self.gone.pop(name, None)
        if entry.get("batch"):
            stream, number = entry["batch"]
            self.batches[stream] = max(number, self.batches.get(stream, number))
        if entry.get("schema") is not None:
            self.schema = entry["schema"]


def with_hour(frame: DataFrame, at: str) -> DataFrame:
    """``hour_bucket``: hours since the epoch, also before it."""
    return frame.withColumn("hour_bucket", F.floor(F.expr(f"(`{at}` - pmod(`{at}`, {HOUR_NS}L)) div {HOUR_NS}L")).cast("long"))


# --- the log ------------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _load(spark: SparkSession, file: str, tries: int = 20) -> dict | None:
    """A log file's content; none if it is not whole and does not get so while this waits a second."""
    for _ in range(tries):
        text = scratch.content_of(spark, file)
        if text.endswith(b"\n"):
            return json.loads(text)
        time.sleep(1 / tries)
    return None


def _create(spark: SparkSession, file: str, content: dict) -> bool:
    return scratch.create_once(spark, file, (json.dumps(content) + "\n").encode())


def state(spark: SparkSession, path: str, version: int | None = None) -> State:
    """The table at a version, the latest if none is given. A folder without a log is an empty table."""
    names = _names(spark, f"{path}/_log")
    wanted = [n for n in names if version is None or int(n.split(".")[0]) <= version]
    out = State()
    for name in reversed([n for n in wanted if n.endswith(".checkpoint")]):
        if (found := _load(spark, f"{path}/_log/{name}")) is not None:
            files = {k: tuple(v) for k, v in found["files"].items()}
            out = State(found["version"], files, found["gone"], found["batches"], found["schema"])
            break
    for name in wanted:
        if name.endswith(".json") and int(name.split(".")[0]) > out.version:
            entry = _load(spark, f"{path}/_log/{name}")
            if entry is None:
                raise RuntimeError(f"{path}/_log/{name} is not whole: a commit broke off there, and the file is to be deleted")
            out.apply(int(name.split(".")[0]), entry)
    return out


def commit(spark: SparkSession, path: str, add: Iterable[tuple[str, int, int]] = (), remove: Iterable[str] = (), schema: StructType | None = None, batch: tuple[str, int] | None = None, deleted: Iterable[str] = (), at_ns: int | None = None) -> int | None:
    """One atomic change of the table; its version, or none if the batch is there already."""
    add, remove, deleted = list(add), list(remove), list(deleted)
    for _ in range(_TRIES):
        now = state(spark, path)
        if batch and now.batches.get(batch[0], -1) >= batch[1]:
            return None
        if lost := [f for f in remove if f not in now.files]:
            raise Conflict(f"{lost[0]} and {len(lost) - 1} more are no longer there")
        merged = _widened(now.schema, schema)
        entry = {"at_ns": time.time_ns() if at_ns is None else at_ns, "add": add, "remove": remove, "deleted": deleted, "batch": batch, "schema": None if merged == now.schema else merged}
        if _create(spark, f"{path}/_log/{now.version + 1:012d}.json", entry):
            now.apply(now.version + 1, entry)
            if now.version % CHECKPOINT_EVERY == 0:
                _create(spark, f"{path}/_log/{now.version:012d}.checkpoint", vars(now))
            return now.version
    raise RuntimeError(f"no commit to {path} in {_TRIES} tries")


def _widened(old: dict | None, new: StructType | None) -> dict | None:
    """The table's columns and, after them, those that are new; a column keeps its type."""
    if new is None:
        return old
    known = {f["name"]: f["type"] for f in (old or {"fields": []})["fields"]}
    added = json.loads(new.json())["fields"]
    for f in added:
        if f["name"] in known and _plain(known[f["name"]]) != _plain(f["type"]):
            raise ValueError(f"column {f['name']} is {known[f['name']]}, not {f['type']}")
    extra = [{**f, "nullable": True, "metadata": {}} for f in added if f["name"] not in known]
    return {"type": "struct", "fields": [*(old or {"fields": []})["fields"], *extra]} if extra else old


def _plain(kind) -> str:
    """A type's JSON without what is nullable in it, which files of a table may differ in."""
    if isinstance(kind, dict):
        return json.dumps({k: _plain(v) for k, v in kind.items() if k not in ("nullable", "containsNull", "valueContainsNull", "metadata")}, sort_keys=True)
    return json.dumps([_plain(k) for k in kind] if isinstance(kind, list) else kind)


# --- writing and reading --------------------------------------------------------------------------


#: What a task of a write reads at most, and the shuffled bytes that it sorts: a stored row is small, but hundreds of bytes in memory.
_TASK_BYTES = {"spark.sql.files.maxPartitionBytes": 8 << 20, "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20}


@contextlib.contextmanager
def _small_tasks(spark: SparkSession) -> Iterator[None]:
    """Bounds on tasks, so that what they hold until it is shuffled or sorted stays in memory. Settings are lowered, never raised, and put back."""
    before = {k: spark.conf.get(k, None) for k in _TASK_BYTES}
    bytes_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    try:
        for k, most in _TASK_BYTES.items():
            if before[k] is None or bytes_of(before[k]) > most:
                spark.conf.set(k, str(most))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _put(rows: DataFrame, path: str, bloom: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """Write rows into a folder of this write's own, where no one reads them before their commit: files, hours, bytes."""
    spark = rows.sparkSession
    folder = f"{WRITE}={uuid.uuid4().hex}"
    writer = rows.write.partitionBy("hour_bucket")
    for c in bloom:  # as large as a file's values need: a fixed size is a megabyte a file
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    with _small_tasks(spark):
        writer.parquet(f"{path}/{folder}")
    out = []
    for name, size, _ in _files(spark, f"{path}/{folder}"):
        hour = name.split("/")[0].removeprefix("hour_bucket=")
        out.append((f"{folder}/{name}", int(hour), size))
    return sorted(out)


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Data files below a folder: name from there, bytes, and when they were changed (ns). Spark lists, many folders at a time."""
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        return []
    top = fs.getFileStatus(root).getPath().toString()
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    rows = listed.select("path", "length", (F.unix_micros("modificationTime") * 1000).alias("at")).collect()
    return [(_plain_path(r["path"]).removeprefix(_plain_path(top)).lstrip("/"), r["length"], r["at"]) for r in rows]


def _plain_path(path: str) -> str:
    """A path without the empty authority that some file systems write and some do not."""
    return path.replace(":///", ":/", 1)


def write(frame: DataFrame, table: str, path: str, bloom: tuple[str, ...] = (), batch: tuple[str, int] | None = None) -> int | None:
    """Append rows, a folder an hour, in the table's order; the version, or none if ``batch`` (stream, number) is there already.

    ``bloom`` columns get Bloom filters. Rows without a time go to no hour and are refused.
    """
    spark, keys = frame.sparkSession, SORT_KEYS[table]
    if batch and state(spark, path).batches.get(batch[0], -1) >= batch[1]:
        return None
    # An hour's rows may be more than a task should hold; rebalancing splits large ones.
    rows = with_hour(frame, keys[0]).withColumn("hour_bucket", F.coalesce("hour_bucket", F.raise_error(F.lit(f"a row without {keys[0]}")).cast("long")))
    rows = rows.hint("rebalance", "hour_bucket").sortWithinPartitions("hour_bucket", *[F.asc_nulls_first(k) for k in keys])
    return commit(spark, path, add=_put(rows, path, bloom), schema=frame.schema, batch=batch)


def table(spark: SparkSession, path: str, start_ns: int | None = None, end_ns: int | None = None, version: int | None = None) -> DataFrame | None:
    """A stored table with its ``hour_bucket``, by which scans are pruned; none if nothing was ever written.

    With bounds on time, files of other hours are not even listed.
    """
    now = state(spark, path, version)
    if now.schema is None:
        return None
    low, high = (None if t is None else t // HOUR_NS for t in (start_ns, end_ns))
    wanted = {f for f, (hour, _) in now.files.items() if (low is None or hour >= low) and (high is None or hour <= high)}
    return _read(spark, path, now.schema, _paths(now, wanted))


def _paths(now: State, wanted: set[str]) -> list[str]:
    """The fewest paths that hold these files and no other: folders as a whole where nothing in them is left out."""
    out, left = [], set(wanted)
    for depth in (1, 2):  # a write's folder, then an hour in it
        has: dict[str, set[str]] = {}
        for f in (*now.files, *now.gone):
            has.setdefault("/".join(f.split("/")[:depth]), set()).add(f)
        whole = [folder for folder, files in has.items() if files <= left]
        out += whole
        left -= {f for folder in whole for f in has[folder]}
    return sorted([*out, *left])


def _read(spark: SparkSession, path: str, schema: dict, files: list[str]) -> DataFrame:
    """The rows of files or folders of files, with their ``hour_bucket``."""
    fields = [*schema["fields"], {"name": "hour_bucket", "type": "long", "nullable": True, "metadata": {}}]
    if not files:
        return spark.createDataFrame([], StructType.fromJson({"type": "struct", "fields": fields}))
    fields.append({"name": WRITE, "type": "string", "nullable": True, "metadata": {}})
    return spark.read.schema(StructType.fromJson({"type": "struct", "fields": fields})).option("basePath", path).parquet(*[f"{path}/{f}" for f in files]).drop(WRITE)


def read(spark: SparkSession, path: str, start_ns: int | None = None, end_ns: int | None = None, time: str = "timestamp_ns", version: int | None = None) -> DataFrame:
    """The rows of a stored table; bounds on time also choose the hours that are read at all."""
    frame = table(spark, path, start_ns, end_ns, version)
    if frame is None:
        raise FileNotFoundError(path)
    return (frame if start_ns is None or end_ns is None else within(frame, time, start_ns, end_ns)).drop("hour_bucket")


def evolve(spark: SparkSession, path: str, add: tuple[str, ...] = (), drop: tuple[str, ...] = ()) -> int:
    """Add and drop text columns (labels); files stay as they are, where a new column is null and a dropped one is not read."""
    now = state(spark, path)
    fields = [f for f in now.schema["fields"] if f["name"] not in drop]
    fields += [json.loads(StructField(c, StringType()).json()) for c in add if c not in {f["name"] for f in fields}]
    entry = {"at_ns": time.time_ns(), "schema": {"type": "struct", "fields": fields}}
    if not _create(spark, f"{path}/_log/{now.version + 1:012d}.json", entry):
        raise Conflict("the table has changed meanwhile")
    return now.version + 1


# --- compaction ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Plan:
    hour: int
    files: tuple[str, ...]
    bytes: int


def plan_compaction(spark: SparkSession, path: str, now_ns: int, target: int = 128 << 20, min_files: int = 4, lateness_ns: int = 600 * 10**9, most: int = 1 << 34) -> list[Plan]:
    """Closed hours of many small files, within a size that one rewrite takes."""
    hours: dict[int, list[tuple[str, int]]] = {}
    for name, (hour, size) in state(spark, path).files.items():
        hours.setdefault(hour, []).append((name, size))
    out = []
    for hour, files in sorted(hours.items()):
        total = sum(size for _, size in files)
        closed = (hour + 1) * HOUR_NS + lateness_ns <= now_ns
        if closed and len(files) >= min_files and total <= most and total / len(files) < 0.8 * target:
            out.append(Plan(hour, tuple(sorted(name for name, _ in files)), total))
    return out


def compact(spark: SparkSession, path: str, name: str, plans: list[Plan], target: int = 128 << 20, labels: tuple[str, ...] = (), bloom: tuple[str, ...] = ()) -> int:
    """Rewrite hours into files of about the target size, in one job and one commit; returns the rows.

    ``labels`` are attribute keys whose ``label_`` columns are filled in from the maps on the way,
    where rows have none yet. Each hour must come out with as many rows as went in. If another commit
    has replaced any of the files, nothing changes and ``Conflict`` is raised.
    """
    if not plans:
        return 0
    now = state(spark, path)
    old = [f for p in plans for f in p.files]
    rows = _read(spark, path, now.schema, _paths(now, set(old)))
    before = {r["hour_bucket"]: r["count"] for r in rows.groupBy("hour_bucket").count().collect()}
    rows = backfilled(rows, labels)
    keys = [F.asc_nulls_first(k) for k in SORT_KEYS[name]]
    files = sum(max(1, -(-p.bytes // target)) for p in plans)
    sorted_rows = rows.repartitionByRange(files, "hour_bucket", *keys).sortWithinPartitions("hour_bucket", *keys)
    placed = _put(sorted_rows, path, bloom)
    after = _read(spark, path, now.schema, sorted({f.split("/")[0] for f, _, _ in placed}))
    if {r["hour_bucket"]: r["count"] for r in after.groupBy("hour_bucket").count().collect()} != before:
        raise RuntimeError("a rewrite came out with other numbers of rows")
    commit(spark, path, add=placed, remove=old, schema=rows.drop("hour_bucket").schema)
    return sum(before.values())


def backfilled(rows: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Rows with the ``label_`` columns of attribute keys; values that are there stay."""
    held = {label_name(k): F.col(label_name(k)) for k in labels if label_name(k) in rows.columns}
    made = materialised(rows.withColumnsRenamed({c: f"__{c}" for c in held}), list(labels))
    return made.withColumns({c: F.coalesce(f"__{c}", c) for c in held}).drop(*[f"__{c}" for c in held])


# --- retention ----------------------------------------------------------------------------------


def retention_ns(table: str, dataset: str, tenant: str, periods: dict[str, int], default: int) -> int:
    """The period that applies: the dataset's, else the tenant's, else the global one."""
    for key in (f"{tenant}/{dataset}/{table}", f"{tenant}/{dataset}", tenant):
        if key in periods:
            return periods[key]
    return default


def expire(spark: SparkSession, path: str, now_ns: int, period_ns: int, grace_ns: int = 0) -> list[int]:
    """Take the hours that ended before the period and its grace out of the table; returns them."""
    cutoff = now_ns - period_ns - grace_ns
    gone = {f: hour for f, (hour, _) in state(spark, path).files.items() if (hour + 1) * HOUR_NS <= cutoff}
    if gone:
        commit(spark, path, remove=sorted(gone))
    return sorted(set(gone.values()))


def expire_snapshots(spark: SparkSession, path: str, now_ns: int, keep_ns: int) -> list[str]:
    """Delete files that left the table before ``keep_ns`` ago, which only older versions name; returns them."""
    old = sorted(f for f, at in state(spark, path).gone.items() if at <= now_ns - keep_ns)
    for name in old:
        fs, p = _fs(spark, f"{path}/{name}")
        fs.delete(p, False)
    if old:
        commit(spark, path, deleted=old)
    return old


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``modified_ns`` of each data file in the table's folders, of writes without a commit too."""
    return spark.createDataFrame([(name, at) for name, _, at in _files(spark, path)], "path string, modified_ns long")


def live_files(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of each file that the table, or a version of it that is kept, names."""
    now = state(spark, path)
    return spark.createDataFrame([(f,) for f in sorted({*now.files, *now.gone})], "path string")


def orphans(listed: DataFrame, live: DataFrame, older_than_ns: int) -> DataFrame:
    """Files (``path``, ``modified_ns``) that no live set (``path``) has and that are old enough to be no write under way."""
    return listed.join(live, "path", "left_anti").where(F.col("modified_ns") < older_than_ns)


def sweep(spark: SparkSession, path: str, older_than_ns: int) -> list[str]:
    """Delete the orphans of a table; returns them."""
    found = sorted(r.path for r in orphans(stored_files(spark, path), live_files(spark, path), older_than_ns).collect())
    for name in found:
        fs, p = _fs(spark, f"{path}/{name}")
        fs.delete(p, False)
    return found

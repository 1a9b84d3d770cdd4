"""Flame graphs: stack prefixes aggregated in Spark, laid out on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions.timeutil import within
from .transforms import profile_samples


def frame_name(function: Column, address: Column) -> Column:
    """The function, else its address, else ``<unknown>``."""
    return F.coalesce(F.nullif(function, F.lit("")), F.when(address > 0, F.concat(F.lit("0x"), F.lower(F.hex(address)))), F.lit("<unknown>"))


def sample_value(values: Column, timestamps: Column) -> Column:
    """A sample's first value, or how many times it was seen."""
    return F.coalesce(F.get(values, F.lit(0)), F.size(timestamps).cast("long"))


def stacks(samples: DataFrame, leaf_first: bool = False) -> DataFrame:
    """``stack`` (root first) and ``value``; samples of nothing are left out, equal stacks added up."""
    stack = F.reverse("stack") if leaf_first else F.col("stack")
    return samples.where("value > 0").groupBy(stack.alias("stack")).agg(F.sum("value").alias("value"))


def prefixes(samples: DataFrame, leaf_first: bool = False) -> DataFrame:
    """``path``, ``depth``, ``total`` of what runs through it and ``self`` of what ends there."""
    each = stacks(samples, leaf_first).select("stack", "value", F.explode(F.sequence(F.lit(1), F.size("stack"))).alias("depth"))
    own = F.when(F.col("depth") == F.size("stack"), F.col("value")).otherwise(0)
    return each.groupBy(F.slice("stack", F.lit(1), F.col("depth")).alias("path"), "depth").agg(F.sum("value").alias("total"), F.sum(own).alias("self"))


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both sides' ``total`` and ``self`` for each path that either has."""
    a = prefixes(left).select("path", F.col("total").alias("left_total"), F.col("self").alias("left_self"))
    b = prefixes(right).select("path", F.col("total").alias("right_total"), F.col("self").alias("right_self"))
    return a.join(b, "path", "full").na.fill(0)


def _layout(rows: list[tuple[tuple[str, ...], tuple[int, ...]]], sides: int) -> tuple[list[str], list[list[int]]]:
    """Names and levels: for each block and side, distance to the block before it, total and self, then the name.

    Siblings stand in order of their names.
    """
    names, index = ["total"], {"total": 0}
    tree: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    of = dict(rows)
    for path in sorted(of):
        tree.setdefault(path[:-1], []).append(path)
    top = [sum(of[p][2 * k] for p in tree.get((), [])) for k in range(sides)]
    levels: list[list[int]] = [[x for k in range(sides) for x in (0, top[k], 0)] + [0]]
    level = [((), [0] * sides)]
    while level:
        below, ends, row = [], [0] * sides, []
        for path, starts in level:
            at = list(starts)
            for child in tree.get(path, []):
                if child[-1] not in index:
                    index[child[-1]] = len(names)
                    names.append(child[-1])
                for k in range(sides):
                    row += [at[k] - ends[k], of[child][2 * k], of[child][2 * k + 1]]
                row.append(index[child[-1]])
                below.append((child, list(at)))
                for k in range(sides):
                    at[k] += of[child][2 * k]
                    ends[k] = at[k]
        if row:
            levels.append(row)
        level = below
    return names, levels


def flamegraph(samples: DataFrame, leaf_first: bool = False) -> dict:
    """The flame graph of samples as names and levels. Collects one row for each different path."""
    rows = [(tuple(r["path"]), (r["total"], r["self"])) for r in prefixes(samples, leaf_first).collect()]
    names, levels = _layout(rows, 1)
    return {"names": names, "levels": levels, "total": levels[0][1], "max_self": max((v[1] for _, v in rows), default=0)}


def flamegraph_diff(left: DataFrame, right: DataFrame) -> dict:
    rows = [(tuple(r["path"]), (r["left_total"], r["left_self"], r["right_total"], r["right_self"])) for r in diff(left, right).collect()]
    names, levels = _layout(rows, 2)
    return {"names": names, "levels": levels, "left_total": levels[0][1], "right_total": levels[0][4], "max_self": max((max(v[1], v[3]) for _, v in rows), default=0)}


# --- the stored table ---------------------------------------------------------------------------

#: What a search tells of a profile: all but its payload.
SUMMARY = ("profile_id", "timestamp_ns", "duration_nano", "sample_type", "sample_unit", "period", "service_name", "trace_id", "span_id")
MAX_SEARCH = 1000


def search(stored: DataFrame, start: int | None = None, end: int | None = None, service: str | None = None, sample_type: str | None = None, limit: int | None = None) -> DataFrame:
    """The newest profiles of a service and type in a window, without their payload; of equal times by id."""
    for column, value in (("service_name", service), ("sample_type", sample_type)):
        stored = stored if value is None else stored.where(F.col(column) == value)
    if start is not None and end is not None:
        stored = within(stored, "timestamp_ns", start, end)
    most = min(limit, MAX_SEARCH) if limit and limit > 0 else MAX_SEARCH
    return stored.select(*[c for c in SUMMARY if c in stored.columns]).orderBy(F.desc("timestamp_ns"), "profile_id").limit(most)


def _hex(text: str) -> str:
    if not text or not all(c in "0123456789abcdefABCDEF" for c in text):
        raise InvalidInput(f"not an id in hex digits: {text!r}")
    return text.lower()


def by_id(stored: DataFrame, profile_id: str) -> DataFrame:
    return stored.where(F.col("profile_id") == _hex(profile_id)).drop("hour_bucket")


def by_trace(stored: DataFrame, trace_id: str, span_id: str | None = None, limit: int | None = None) -> DataFrame:
    """The profiles that point to a trace, or to one of its spans, newest first."""
    found = stored.where(F.col("trace_id") == _hex(trace_id))
    found = found if span_id is None else found.where(F.col("span_id") == _hex(span_id))
    return search(found, limit=limit)


def label_names(stored: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """``label``: the service and the keys of profiles' attributes."""
    frame = within(stored, "timestamp_ns", start, end) if start is not None and end is not None else stored
    own = stored.sparkSession.createDataFrame([("service_name",)], "label string")
    return own.unionByName(frame.select(F.explode(F.map_keys("attributes")).alias("label")).distinct()).distinct()


def label_values(stored: DataFrame, name: str, start: int | None = None, end: int | None = None) -> DataFrame:
    frame = within(stored, "timestamp_ns", start, end) if start is not None and end is not None else stored
    column = F.col("service_name") if name == "service_name" else F.col("attributes")[name]
    return frame.select(column.alias("value")).where("value is not null").distinct()


def capped_flamegraph(rows: DataFrame, most: int) -> dict:
    """The flame graph of the newest ``most`` rows, profiles or samples, and whether there were more."""
    ordered = rows.orderBy(F.desc("timestamp_ns"), *[c for c in ("profile_id", "service_name") if c in rows.columns]).limit(most + 1)
    spark = rows.sparkSession
    held = ordered.collect()
    first = spark.createDataFrame(held[:most], ordered.schema)
    samples = profile_samples(first) if "samples_json" in rows.columns else first
    return flamegraph(samples) | {"truncated": len(held) > most}


def types(samples: DataFrame) -> DataFrame:
    return samples.select(F.concat_ws(":", "sample_type", "sample_unit").alias("profile_type")).where("profile_type <> ':'").distinct()

"""Samples as Prometheus writes them: kinds by name, classic and native histograms, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.histogram import number_array

#: Schemas of native histograms whose buckets grow exponentially; others have bounds of their own.
EXPONENTIAL = (-4, 8)


def kind(name: Column) -> Column:
    """What a sample of this name is taken for."""
    return F.when(name.endswith("_bucket"), "histogram").when(name.rlike("_(total|count|sum|created)$"), "sum").otherwise("gauge")


def _series(samples: DataFrame, without: str) -> tuple[DataFrame, list[str]]:
    """Samples with ``series``, the labels that tell series apart; ``without`` is the label that is spread over columns."""
    if "attributes" not in samples.columns:
        return samples, []
    rest = F.map_filter(F.coalesce("attributes", F.create_map().cast("map<string,string>")), lambda k, _: k != without)
    return samples.withColumn("series", F.array_sort(F.map_entries(rest))), ["series"]


def _labels(series: list[str]) -> list[Column]:
    return [F.map_from_entries("series").alias("attributes") for _ in series]


def classic_histograms(samples: DataFrame) -> DataFrame:
    """Cumulative ``le`` samples as bounds and counts, one row a series and time.

    ``samples`` has ``timestamp_ns, metric_name, service_name, value`` and the bound in ``le``, or in
    a map of ``attributes`` whose other labels tell series apart. Counts that fall are taken for none.
    """
    edge = F.coalesce(F.col("le"), F.col("attributes")["le"]) if {"le", "attributes"} <= set(samples.columns) else F.col("le") if "le" in samples.columns else F.col("attributes")["le"]
    rows, series = _series(samples.withColumn("__le", edge), "le")
    rows = rows.withColumn("edge", F.when(F.col("__le").isin("+Inf", "Inf"), F.lit(float("inf"))).otherwise(F.col("__le").try_cast("double"))).where("edge is not null")
    keys = ["timestamp_ns", F.regexp_replace("metric_name", "_bucket$", "").alias("metric_name"), "service_name", *series]
    one = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("edge", "value"))).alias("b"))
    counts = F.transform("b", lambda x, i: F.greatest(x["value"] - F.when(i == 0, F.lit(0.0)).otherwise(F.get("b", i - 1)["value"]), F.lit(0.0)).cast("long"))
    bounds = F.filter(F.transform("b", lambda x: x["edge"]), lambda e: e < float("inf"))
    last = F.element_at("b", -1)["value"].cast("long")
    return one.select("timestamp_ns", "metric_name", "service_name", *_labels(series), last.alias("count"), F.to_json(counts).alias("bucket_counts"), F.to_json(bounds).alias("explicit_bounds"))


def valid_histograms(frame: DataFrame) -> DataFrame:
    return frame.where(F.size(number_array(F.col("bucket_counts"))) == F.size(number_array(F.col("explicit_bounds"))) + 1)


def _buckets(side: str) -> tuple[Column, Column]:
    """A sign's counts, one for each bucket that its spans tell, and how spans lay them out.

    Spans tell how many buckets follow and how far from the last one; integer counts are differences.
    The layout has the first bucket's number (``index``), the counts with zeros in gaps (``dense``)
    and whether spans and counts agree, do not overlap and are nowhere below zero (``sound``).
    """
    none = F.array().cast("array<bigint>")
    spans, deltas, floats = F.col(f"{side}_spans"), F.coalesce(f"{side}_deltas", none), F.coalesce(f"{side}_counts", F.array().cast("array<double>"))
    running = F.aggregate(deltas, none, lambda acc, d: F.concat(acc, F.array(F.try_add(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("long")), d))))
    whole = F.transform(floats, lambda c: F.when((c >= 0) & (c < 9e18), F.round(c)).try_cast("long"))
    counts = F.when(F.size(deltas) > 0, running).otherwise(whole)
    told = F.aggregate(spans, F.lit(0), lambda acc, s: acc + s["length"])
    fine = (F.size(counts) == told) & ~F.exists(counts, lambda c: c.isNull() | (c < 0))
    start = F.struct(F.lit(0).alias("at"), none.alias("dense"), F.lit(0).alias("index"), F.lit(False).alias("found"), fine.alias("sound"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(acc["found"], F.greatest(s["offset"], F.lit(0))).otherwise(0)
        part = F.slice(F.col("__counts"), acc["at"] + 1, s["length"])
        return F.struct(
            (acc["at"] + s["length"]).alias("at"), F.concat(acc["dense"], F.array_repeat(F.lit(0).cast("long"), gap), part).alias("dense"), F.when(acc["found"], acc["index"]).otherwise(acc["index"] + s["offset"]).alias("index"),
            (acc["found"] | (s["length"] > 0)).alias("found"), (acc["sound"] & ~(acc["found"] & (s["offset"] < 0))).alias("sound"),
        )

    return counts, F.aggregate(spans, start, step)


def native_histograms(samples: DataFrame) -> DataFrame:
    """Native histograms as exponential ones: ``scale``, and each sign's offset and dense counts as JSON.

    ``samples`` has ``timestamp_ns, metric_name, service_name, schema, count, sum, zero_count,
    zero_threshold`` and, for ``positive`` and ``negative``, ``_spans`` of (offset, length) and
    ``_deltas`` or ``_counts``. Schemas that are not exponential, and rows whose spans and counts
    disagree, overlap or come out below zero, are left out.
    """
    rows = samples.where(F.col("schema").between(*EXPONENTIAL))
    empty = F.array().cast("array<struct<offset:int,length:int>>")
    for side in ("positive", "negative"):
        rows = rows.withColumn(f"{side}_spans", F.coalesce(f"{side}_spans", empty))
        counts, laid = _buckets(side)
        rows = rows.withColumn("__counts", counts).withColumn("__laid", laid).where("__laid.sound")
        # A bucket's number is by its lower bound here, one less than by its upper.
        rows = rows.withColumns({f"{side}_offset": F.when(F.col("__laid.found"), F.col("__laid.index") - 1), f"{side}_bucket_counts": F.to_json("__laid.dense")}).drop("__counts", "__laid")
    labels = ["attributes"] if "attributes" in samples.columns else []
    return rows.select("timestamp_ns", "metric_name", "service_name", *labels, "count", "sum", F.col("schema").alias("scale"), "zero_count", "zero_threshold", "positive_offset", "positive_bucket_counts", "negative_offset", "negative_bucket_counts")


def summaries(samples: DataFrame) -> DataFrame:
    """``quantile``, ``_count`` and ``_sum`` samples of a summary as one row a series and time.

    ``samples`` has ``timestamp_ns, metric_name, service_name, value`` and ``attributes``, whose
    ``quantile`` label is spread and whose others tell series apart.
    """
    rows, series = _series(samples, "quantile")
    name, q = F.col("metric_name"), F.col("attributes")["quantile"].try_cast("double")
    rows = rows.withColumn("q", q).where(~name.endswith("_created") & (q.isNotNull() | name.rlike("_(count|sum)$")))
    rows = rows.withColumn("base", F.when(q.isNotNull(), name).otherwise(F.regexp_replace(name, "_(count|sum)$", "")))
    part = lambda suffix: F.max(F.when(F.col("q").isNull() & name.endswith(suffix), F.col("value")))
    values = F.array_sort(F.collect_set(F.when(F.col("q").isNotNull(), F.struct(F.col("q").alias("quantile"), "value"))))
    one = rows.groupBy("timestamp_ns", F.col("base").alias("metric_name"), "service_name", *series).agg(part("_count").cast("long").alias("count"), part("_sum").alias("sum"), values.alias("v"))
    return one.select("timestamp_ns", "metric_name", "service_name", *_labels(series), F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("sum", F.lit(0.0)).alias("sum"), F.to_json("v").alias("quantile_values"))

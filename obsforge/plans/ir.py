"""The query document: validated, then lowered to one lazy DataFrame."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput, Unsupported
from ..functions import histogram
from ..functions.fields import SOURCES, Resolver, ident
from ..functions.predicate import literal, lower
from ..functions.timeutil import bucket, duration_ns, instant_ns, within
from ..operators import profiles, stats
from ..operators.matrix import approximate_quantile, exact_quantile, same_keys
from ..sources.catalog import Catalog

STAGES = {"where", "extract", "aggregate", "topk", "bottomk", "order", "limit", "heatmap", "histogram_quantile", "describe"}
FUNCTIONS = {"count": 1, "sum": 1, "avg": 1, "min": 1, "max": 1, "quantile": 1, "stddev": 5, "stdvar": 5, "first": 5, "last": 5}
RESULTS = {"rows", "table", "series", "heatmap", "flamegraph", "metadata"}
MAX_BOUNDS, MAX_BUCKETS = 32, 512
FLAMEGRAPH_ROWS = 1000


@dataclass
class Relation:
    """A lazy result: what kind it is, its group labels and its measures."""

    frame: DataFrame
    kind: str
    labels: list[str] = field(default_factory=list)
    measures: list[str] = field(default_factory=list)
    window: tuple[int, int] = (0, 0)
    warnings: list[dict] = field(default_factory=list)
    #: Group keys that no schema names, with names like them: a warning if all their values are null.
    doubtful: dict[str, list[str]] = field(default_factory=dict)


#: Values of fields that are written from a fixed set.
DECLARED = {"span.kind": ("Client", "Consumer", "Internal", "Producer", "Server", "Unspecified"), "status.code": ("Error", "Ok", "Unspecified")}


def _nothing(spark: SparkSession, source) -> DataFrame:
    kinds = {"int64": "long", "float64": "double", "bool": "boolean", "timestamp_ns": "long", "duration_ns": "long"}
    columns = {c: kinds.get(t, "string") for c, t in source.fields.values()} | {c: "map<string,string>" for _, c in source.containers}
    if "metrics_histogram" in source.tables:
        columns |= {"bucket_counts": "string", "explicit_bounds": "string"}
    return spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in columns.items()))


def closest(name: str, names: list[str], most: int = 3) -> list[str]:
    """Names that differ from this one in a third of their length or in two characters at most, signs and case aside."""
    plain = lambda s: "".join(c for c in s.lower() if c.isascii() and c.isalnum())
    scored = sorted({(_edits(plain(name), plain(n)), n) for n in names})
    return [n for d, n in scored if d <= max(len(n) // 3, 2)][:most]


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def _only(stage: str, value: dict, allowed: set[str], needed: set[str] = frozenset()) -> None:
    if not isinstance(value, dict) or set(value) - allowed or needed - set(value):
        raise InvalidInput(f"{stage}: {value!r}")


class _Lowering:
    def __init__(self, doc: dict, catalog: Catalog, tenant: str, dataset: str, now_ns: int, exact: bool = False) -> None:
        _only("document", doc, {"irVersion", "from", "range", "result", "fields", "pipeline"}, {"irVersion", "from", "range", "result"})
        self.version, self.result = doc["irVersion"], doc["result"]
        if self.version not in range(1, 6):
            raise InvalidInput(f"irVersion {self.version!r} is not 1 to 5")
        if self.result not in RESULTS:
            raise InvalidInput(f"unknown result {self.result!r}")
        if doc["from"] not in SOURCES:
            near = closest(str(doc["from"]), list(SOURCES), 1)
            raise InvalidInput(f"unknown source {doc['from']!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
        self.name, self.source, self.now = doc["from"], SOURCES[doc["from"]], now_ns
        self.start, self.end = (instant_ns(doc["range"][k], now_ns) for k in ("from", "to"))
        if self.start > self.end:
            raise InvalidInput("the range ends before it begins")
        self.fields = doc.get("fields")
        if self.fields is not None and self.result not in ("rows", "table"):
            raise InvalidInput(f"fields does not go with {self.result}")
        self.exact = exact
        self.frame = catalog.union(tenant, dataset, self.source.tables)
        self.missing = self.frame is None
        if self.missing and (spark := SparkSession.getActiveSession()) is not None:
            self.frame = _nothing(spark, self.source)  # so that a document over no table is held to the same rules
        self.derived: dict[str, str] = {}
        self.outputs: dict[str, str] | None = None
        self.kind, self.labels, self.measures = "rows", [], []
        self.warnings: list[dict] = []
        self.doubtful: dict[str, list[str]] = {}
        self.pipeline = doc.get("pipeline", [])

    def resolve(self, name: str) -> tuple[Column, str]:
        if not isinstance(name, str) or not name or any(c in name for c in "()+*/ "):
            raise InvalidInput(f"a field name, not an expression: {name!r}")
        if self.outputs is not None:
            if name not in self.outputs:
                raise InvalidInput(f"{name!r} is neither a group nor an output of the aggregate")
            return F.col(f"`{ident(name)}`"), self.outputs[name]
        if name in self.source.retrieval_only:
            raise InvalidInput(f"{name!r} can be read, not filtered or grouped by")
        return Resolver(self.source, self.frame, self.derived).column(name)

    def run(self) -> Relation:
        if self.frame is not None:
            self.frame = within(self.frame, self.source.time, self.start, self.end)
        described = [s for s in self.pipeline if isinstance(s, dict) and "describe" in s]
        if (self.result == "metadata") != bool(described) or described and (len(self.pipeline) != 1 or self.version < 4):
            raise InvalidInput("metadata is what a describe stage alone makes, from irVersion 4")
        for stage in self.pipeline:
            if not isinstance(stage, dict) or len(stage) != 1 or (name := next(iter(stage))) not in STAGES:
                raise InvalidInput(f"unknown stage {stage!r}")
            if self.kind in ("series", "heatmap") and name != "limit":
                raise InvalidInput(f"{name} cannot follow a {self.kind}")
            if self.frame is not None:
                getattr(self, name)(stage[name])
        if self.frame is None:
            return Relation(None, "empty", window=(self.start, self.end))
        if self.result != "flamegraph" and self.result != self.kind:
            raise InvalidInput(f"the query makes {self.kind}, not {self.result}")
        if self.result == "flamegraph":
            if self.name != "profiles" or self.kind != "rows" or any("where" not in s for s in self.pipeline):
                raise InvalidInput("a flamegraph takes profiles and where stages only")
            self.kind = "flamegraph"
        elif self.kind == "rows":
            if not any("extract" in s for s in self.pipeline) or self.fields:
                names = self.fields or list(self.source.rows)
                if len({ident(n) for n in names}) < len(names):
                    raise InvalidInput("fields collide")
                r = Resolver(self.source, self.frame, self.derived)
                self.frame = self.frame.select(*[r.column(n)[0].alias(ident(n)) for n in names])
            self.frame = self.frame.drop("hour_bucket")
        elif self.kind == "table" and self.fields:
            self.frame = self.frame.select(*[self.resolve(n)[0].alias(ident(n)) for n in self.fields])
        if self.missing and self.kind != "metadata":
            return Relation(None, "empty", window=(self.start, self.end))
        return Relation(self.frame, self.kind, self.labels, self.measures, (self.start, self.end), self.warnings, self.doubtful)

    def describe(self, spec: dict) -> None:
        """What fields there are, or what values a field takes, from the statistics of the window's attributes."""
        _only("describe", spec, {"target", "field", "limit", "sample"}, {"target"})
        target, name, most = spec["target"], spec.get("field"), spec.get("limit", 50)
        if target not in ("fields", "values") or (target == "values") != (name is not None) or isinstance(most, bool) or not isinstance(most, int) or most <= 0:
            raise InvalidInput(f"describe: {spec!r}")
        held = tuple(c for _, c in self.source.containers if c in self.frame.columns)
        found = stats.attribute_stats(self.frame, held) if held else stats.attribute_stats(self.frame.select(F.create_map().cast("map<string,string>").alias("m")), ("m",))
        if target == "fields":
            declared = {n: t for n, (_, t) in self.source.fields.items()}
            self.frame = stats.describe_fields(found, declared, self.frame.count()).limit(most)
        else:
            column = self.resolve(name)[0]
            self.frame = stats.describe_values(found, name, most, DECLARED, self.frame if spec.get("sample") else None, column)
        self.kind = "metadata"

    def where(self, node: dict) -> None:
        self.frame = self.frame.where(lower(node, self.resolve, self.now))

    def extract(self, spec: dict) -> None:
        _only("extract", spec, {"parser", "as"}, {"parser", "as"})
        if self.name != "logs" or self.outputs is not None:
            raise InvalidInput("extract takes log rows")
        kinds = {"string": "string", "int64": "bigint", "float64": "double", "bool": "boolean", "duration_ns": "bigint", "timestamp_ns": "bigint"}
        for item in spec["as"]:
            name, kind = item["name"], item.get("type", "string")
            if name in self.derived or name in self.source.fields or kind not in kinds:
                raise InvalidInput(f"extract: {item!r}")
            if spec["parser"] == "json":
                text = F.get_json_object("body", f"$['{name}']")
            elif spec["parser"] == "logfmt":
                parts = F.filter(F.split("body", r"\s+"), lambda t: t.startswith(name + "="))
                text = F.trim(F.substring(F.get(parts, F.lit(0)), len(name) + 2, 1 << 30), F.lit('"'))
            else:
                raise InvalidInput(f"unknown parser {spec['parser']!r}")
            self.frame = self.frame.withColumn(ident(name), text.try_cast(kinds[kind]))
            self.derived[name] = kind

    def _aggregate(self, agg: dict) -> tuple[Column, str]:
        _only("aggregate", agg, {"fn", "of", "arg", "as", "where", "divisor"}, {"fn", "as"})
        fn = agg["fn"]
        if fn not in FUNCTIONS:
            raise InvalidInput(f"unknown function {fn!r}")
        if FUNCTIONS[fn] > self.version or "divisor" in agg and self.version < 5:
            raise InvalidInput(f"{fn if FUNCTIONS[fn] > self.version else 'divisor'} needs irVersion 5")
        if (fn == "count") == ("of" in agg) or (fn == "quantile") != ("arg" in agg):
            raise InvalidInput(f"{fn}: {agg!r}")
        scope = lower(agg["where"], self.resolve, self.now) if "where" in agg else None
        x, kind = self.resolve(agg["of"]) if "of" in agg else (F.lit(1), "int64")
        held = x if scope is None else F.when(scope, x)
        number = held.try_cast("double") if kind == "string" else held.cast("double")
        at = F.col(self.source.time) if scope is None else F.when(scope, F.col(self.source.time))
        if fn == "quantile" and not 0 <= agg["arg"] <= 1:
            raise InvalidInput("a quantile lies between 0 and 1")
        out, of = {
            "count": lambda: (F.count(held), "int64"),
            "sum": lambda: (F.sum(number), "float64"),
            "avg": lambda: (F.avg(number), "float64"),
            "min": lambda: (F.min(held), kind),
            "max": lambda: (F.max(held), kind),
            "quantile": lambda: (approximate_quantile(number, float(agg["arg"])), "float64"),
            "stddev": lambda: (F.stddev_pop(number), "float64"),
            "stdvar": lambda: (F.var_pop(number), "float64"),
            "first": lambda: (F.min_by(held, F.struct(at, held)), kind),
            "last": lambda: (F.max_by(held, F.struct(at, held)), kind),
        }[fn]()
        if "divisor" in agg:
            d = agg["divisor"]
            if isinstance(d, bool) or not isinstance(d, (int, float)) or not math.isfinite(d) or d <= 0:
                raise InvalidInput("a divisor is a positive number")
            out, of = out / F.lit(float(d)), "float64"
        return out.alias(ident(agg["as"])), of

    def aggregate(self, spec: dict) -> None:
        _only("aggregate", spec, {"by", "aggs", "step"}, {"aggs"})
        if self.outputs is not None:
            raise InvalidInput("only one aggregate")
        by, step = spec.get("by", []), spec.get("step")
        names = [*by, *[a.get("as", "") for a in spec["aggs"]]]
        if not spec["aggs"] or len({ident(n) for n in names}) < len(names) or step and len(spec["aggs"]) != 1:
            raise InvalidInput("aggregate needs outputs of different names, one with a step")
        resolver = Resolver(self.source, self.frame, self.derived)
        for name in by:
            if not resolver.known(name):
                self.doubtful[name] = closest(name, list(self.source.fields))
        keys = [self.resolve(n)[0].alias(ident(n)) for n in by]
        outputs = {n: self.resolve(n)[1] for n in by}
        if step:
            keys.insert(0, bucket(F.col(self.source.time), duration_ns(step)).alias("bucket_ns"))
        aggs, apart = [], []
        for a in spec["aggs"]:
            out, kind = self._aggregate(a)
            aggs.append(out)
            outputs[a["as"]] = kind
            if self.exact and a["fn"] == "quantile":
                apart.append(a)
        names = (["bucket_ns"] if step else []) + [ident(n) for n in by]
        grouped = self.frame.groupBy(*keys).agg(*aggs)
        for a in apart:
            of, kind = self.resolve(a["of"])
            held = F.when(lower(a["where"], self.resolve, self.now), of) if "where" in a else of
            name = ident(a["as"])
            values = self.frame.select(*keys, (held.try_cast("double") if kind == "string" else held.cast("double")).alias(name))
            found = exact_quantile(values, names, name, float(a["arg"])).withColumn(name, F.col(name) / F.lit(float(a.get("divisor", 1))))
            grouped = same_keys(grouped.drop(name), found, names)
        self.frame = grouped.select(*names, *[ident(a["as"]) for a in spec["aggs"]])
        self.labels, self.measures, self.outputs = list(by), [a["as"] for a in spec["aggs"]], outputs
        self.kind = "series" if step else "table"
        if step:
            self.frame = self.frame.orderBy("bucket_ns", *[F.col(f"`{ident(n)}`") for n in by])

    def _rank(self, spec: dict, largest: bool) -> None:
        _only("topk", spec, {"n", "of"}, {"n", "of"})
        column, kind = self.resolve(spec["of"])
        if kind not in ("int64", "float64", "duration_ns", "timestamp_ns") or not isinstance(spec["n"], int) or spec["n"] <= 0:
            raise InvalidInput(f"ranks a number, by a positive n: {spec!r}")
        ties = [F.col(f"`{ident(n)}`") for n in self.labels]
        self.frame = self.frame.orderBy(column.desc_nulls_last() if largest else column.asc_nulls_last(), *ties).limit(spec["n"])

    def topk(self, spec: dict) -> None:
        self._rank(spec, True)

    def bottomk(self, spec: dict) -> None:
        self._rank(spec, False)

    def order(self, keys: list) -> None:
        sort = []
        for k in keys:
            _only("order", k, {"of", "dir"}, {"of"})
            if k.get("dir", "asc") not in ("asc", "desc"):
                raise InvalidInput(f"order: {k!r}")
            column = self.resolve(k["of"])[0]
            sort.append(column.desc_nulls_first() if k.get("dir") == "desc" else column.asc_nulls_first())
        self.frame = self.frame.orderBy(*sort)

    def limit(self, n: int) -> None:
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise InvalidInput(f"limit: {n!r}")
        self.frame = self.frame.limit(n)

    def heatmap(self, spec: dict) -> None:
        _only("heatmap", spec, {"x", "y", "value"}, {"x", "y"})
        if self.version < 2 or self.name != "traces" or self.outputs is not None:
            raise InvalidInput("a heatmap takes spans, from irVersion 2")
        step = duration_ns(spec["x"]["step"])
        bounds = [literal(b, "duration_ns") for b in spec["y"]["bounds"]]
        if not 0 < len(bounds) <= MAX_BOUNDS or bounds != sorted(set(bounds)) or (self.end - self.start) // step >= MAX_BUCKETS:
            raise InvalidInput("up to 32 rising bounds and 512 time buckets")
        y = self.resolve(spec["y"].get("field", "duration"))[0]
        at = F.lit(len(bounds))
        for i, b in reversed(list(enumerate(bounds))):
            at = F.when(y < b, F.lit(i)).otherwise(at)
        self.frame = self.frame.where(y.isNotNull()).groupBy(bucket(F.col(self.source.time), step).alias("bucket_ns"), at.alias("y_bucket")).agg(F.count(F.lit(1)).alias("count"))
        self.kind = "heatmap"

    def histogram_quantile(self, spec: dict) -> None:
        _only("histogram_quantile", spec, {"phi", "by", "step", "mode", "as"}, {"phi", "step"})
        if self.version < 3 or self.name != "metrics_histogram":
            raise InvalidInput("histogram_quantile takes metrics_histogram, from irVersion 3")
        by = spec.get("by", ["service.name"])
        merged = merged_histograms(self.frame, duration_ns(spec["step"]), [(ident(n), self.resolve(n)[0]) for n in by], spec.get("mode", "instant") == "rate")
        name = ident(spec.get("as", "value"))
        self.frame = merged.select("bucket_ns", "metric_name", *[ident(n) for n in by], histogram.quantile(float(spec["phi"]), F.col("bounds"), F.col("counts")).alias(name))
        self.kind, self.labels, self.measures = "series", ["metric_name", *by], [name]


def merged_histograms(frame: DataFrame, step_ns: int, by: list[tuple[str, Column]], rate: bool) -> DataFrame:
    """Bucket counts added up by step, metric and ``by``; for a rate, what each series has gained in the step.

    Rows that are no histogram, or whose number of buckets is another than their group's first, add nothing.
    """
    rows = frame.select("timestamp_ns", "metric_name", "service_name", bucket(F.col("timestamp_ns"), step_ns).alias("bucket_ns"), *[c.alias(n) for n, c in by if n not in ("metric_name", "service_name")], histogram.number_array(F.col("explicit_bounds")).alias("bounds"), histogram.number_array(F.col("bucket_counts")).alias("counts"))
    rows = rows.where(histogram.valid(F.col("bounds"), F.col("counts")))
    keys = ["bucket_ns", "metric_name", *[n for n, _ in by if n != "metric_name"]]
    if rate:
        own = list(dict.fromkeys([*keys, "service_name"]))
        rows = rows.groupBy(*own).agg(F.min_by("counts", "timestamp_ns").alias("first"), F.max_by("counts", "timestamp_ns").alias("last"), F.min_by("bounds", "timestamp_ns").alias("bounds"), F.min("timestamp_ns").alias("timestamp_ns"))
        rows = rows.withColumn("counts", histogram.risen(F.col("first"), F.col("last")))
    # Each number of buckets is added up apart, with its earliest bounds; then the earliest number is the group's.
    each = rows.select(*keys, "timestamp_ns", "bounds", F.size("counts").alias("n"), F.posexplode("counts").alias("pos", "c"))
    at = F.struct("timestamp_ns", "bounds")
    sums = each.groupBy(*keys, "n", "pos").agg(F.sum("c").alias("c"), F.min(F.when(F.col("pos") == 0, at)).alias("first"))
    arrays = sums.groupBy(*keys, "n").agg(F.min("first").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]).alias("counts"))
    found = arrays.groupBy(*keys).agg(F.min_by(F.struct(F.col("first.bounds").alias("bounds"), "counts"), "first").alias("h"))
    return found.select(*keys, "h.bounds", "h.counts")


def run(doc: dict, catalog: Catalog, tenant: str = "acme", dataset: str = "prod", now_ns: int = 0, exact: bool = False) -> Relation:
    """A lazy relation for a document; ``empty`` where the source has no table.

    Quantiles are values whose rank is off by a share of 1 / ACCURACY at most, or ``exact``, for which
    rows are read twice more.
    """
    return _Lowering(doc, catalog, tenant, dataset, now_ns, exact).run()


def sources(catalog: Catalog, tenant: str = "acme", dataset: str = "prod") -> list[dict]:
    return [{"source": name, "available": any(catalog.find(tenant, dataset, t) is not None for t in s.tables)} for name, s in SOURCES.items()]


def _json(value):
    if isinstance(value, float) and not math.isfinite(value):
        return "NaN" if value != value else "+Inf" if value > 0 else "-Inf"
    return value


def warnings_of(relation: Relation) -> list[dict]:
    """Warnings of group keys that no field of the source has and whose every value came out null."""
    names = [n for n in relation.doubtful if ident(n) in (relation.frame.columns if relation.frame is not None else ())]
    if not names:
        return relation.warnings
    seen = relation.frame.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(ident(n)).alias(ident(n)) for n in names]).first()
    empty = [n for n in names if seen["__rows"] and not seen[ident(n)]]
    return relation.warnings + [{"code": "unknown_group_by_field", "field": n, "suggestions": relation.doubtful[n]} for n in empty]


def envelope(relation: Relation) -> dict:
    """The answer's JSON shape; this collects it, so a caller bounds it first."""
    out: dict = {"result": relation.kind, "window": {"start_ns": relation.window[0], "end_ns": relation.window[1]}}
    if relation.frame is None:
        return out | {"rows": [], "columns": []}
    if found := warnings_of(relation):
        out["warnings"] = found
    if relation.kind == "series":
        names = [ident(n) for n in relation.labels]
        value = ident(relation.measures[0])
        grouped = relation.frame.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("bucket_ns", value))).alias("points"))
        return out | {"series": [{"labels": {n: r[ident(n)] for n in relation.labels}, "points": [[p[0], _json(p[1])] for p in r["points"]]} for r in grouped.orderBy(*names).collect()]}
    if relation.kind == "flamegraph":
        return out | {"flamegraph": profiles.capped_flamegraph(relation.frame, FLAMEGRAPH_ROWS)}
    if relation.kind == "metadata":
        rows = [{k: _json(v) for k, v in r.asDict().items() if v is not None} for r in relation.frame.collect()]
        return out | {"metadata": {"kind": "fields" if "type" in relation.frame.columns else "values", "items": rows}}
    columns = [{"name": n, "type": t} for n, t in relation.frame.dtypes]
    return out | {"columns": columns, "rows": [[_json(v) for v in r] for r in relation.frame.collect()]}


def require(relation: Relation) -> DataFrame:
    if relation.frame is None:
        raise Unsupported("the source has no table")
    return relation.frame

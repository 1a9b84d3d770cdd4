"""Quality rules: fixed ones, and an isolation forest on rule statistics calibrated from labels."""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Durable, map_batches, sized, table
from .textstats import COUNTS, text_statistics, truth

#: Statistics that the forest splits on: shares that do not depend on a text's length or language.
STATISTICS = ("upper_share", "symbols_per_word", "exclaims_per_word", "pipes_per_word", "adjacent_repeats", "repeat_share")
TREES = 100
#: Rows of a tree: as many where a forest grows from an array; at least about so many, if there are, where all labelled rows are dealt to the trees.
SUBSAMPLE = 256
DEPTH = 8
#: Slices of the range of scores in which the labelled rows are put in order.
SLICES = 4096


def expected_path(n: int) -> float:
    """Mean length of an unsuccessful search in a binary tree of n values."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> Tree:
    """A tree of all rows of ``x``, whatever their order."""
    nodes: list[tuple[int, float, float, int]] = []

    def build(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, depth + expected_path(len(rows)), 0))
        low, high = rows.min(0), rows.max(0)
        if depth < DEPTH and len(rows) > 1 and (varied := np.flatnonzero(high > low)).size:
            f = int(rng.choice(varied))
            cut = rng.uniform(low[f], high[f])
            left = rows[:, f] < cut
            if left.any() and not left.all():
                nodes[at] = (f, cut, build(rows[left], depth + 1), build(rows[~left], depth + 1))
        return at

    build(x, 0)
    f, cut, left, right = map(np.array, zip(*nodes, strict=True))
    return f, cut, left.astype(float), right


@dataclass
class IsolationForest:
    """Each tree: arrays of split statistic (-1: leaf), split value, and the two next nodes, or the path length in a leaf."""

    trees: list[Tree]
    threshold: float = np.inf
    rows: int = SUBSAMPLE  # of a tree

    @classmethod
    def grow(cls, x: np.ndarray, seed: int = 7) -> IsolationForest:
        rng = np.random.default_rng(seed)
        return cls([grow_tree(x[rng.choice(len(x), min(SUBSAMPLE, len(x)), replace=False)], rng) for _ in range(TREES if len(x) > 1 else 0)])

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path), in (0, 1): higher, the sooner a row stands alone."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for f, cut, left, right in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                split = f[at]
                down = np.where(x[rows, np.maximum(split, 0)] < cut[at], left[at].astype(np.int64), right[at])
                at = np.where(split < 0, at, down)
            total += left[at]
        return 2 ** (-total / max(len(self.trees), 1) / expected_path(self.rows))

    def calibrate(self, x: np.ndarray, good: np.ndarray) -> IsolationForest:
        """Set the threshold above which a row is anomalous: the one with the highest mean of the
        share of good rows kept and of bad rows found; of equals the highest. Without bad or good
        rows nothing is anomalous."""
        if good.any() and not good.all():
            score = self.anomaly(x)
            order = np.argsort(score, kind="stable")
            kept = np.cumsum(good[order]) / good.sum() + 1 - np.cumsum(~good[order]) / (~good).sum()
            last = np.append(np.diff(score[order]) > 0, True)  # cuts lie between different scores
            kept[~last] = -1
            best = np.flatnonzero(kept == kept.max())[-1]
            after = order[best + 1] if best + 1 < len(order) else order[best]
            self.threshold = float((score[order[best]] + score[after]) / 2)
        return self


def rule_statistics(documents: DataFrame) -> DataFrame:
    """``doc_id``, COUNTS and STATISTICS of every row."""
    stats = text_statistics(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    return stats.select("doc_id", *COUNTS, *STATISTICS)


def scored(stats: DataFrame, forest: IsolationForest, *keep: str) -> DataFrame:
    """``keep`` columns and ``anomaly`` of every row of statistics."""
    k, width = len(keep), len(STATISTICS)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.stack([batch.column(k + i).to_numpy() for i in range(width)], axis=1)
        return pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(forest.anomaly(x))], [*keep, "anomaly"])

    kinds = dict(stats.dtypes)
    return map_batches(stats.select(*keep, *STATISTICS), each, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", anomaly double")


def grow_from_all(known: DataFrame, seed: int = 7) -> IsolationForest:
    """A forest that every row (``doc_id``, STATISTICS) grows a tree of.

    Rows are dealt to the trees by a hash of their id: each to one tree if that gives SUBSAMPLE rows
    a tree, to as many trees more as it takes if not. A task grows a tree of its TREES-th of the rows.
    """
    n = known.count()
    if n < 2:
        return IsolationForest([])
    copies = min(TREES, -(-TREES * SUBSAMPLE // n))
    strides = F.array(*(F.lit(k) for k in range(1, TREES) if gcd(k, TREES) == 1))
    stride = F.get(strides, F.pmod(F.xxhash64("doc_id", F.lit(1)), F.size(strides)).cast("int"))
    trees = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda j: F.pmod(F.pmod(F.xxhash64("doc_id"), F.lit(TREES)) + j * stride, F.lit(TREES)).cast("int"))
    dealt = known.select(F.explode(trees).alias("tree"), *STATISTICS)

    def grow(rows: pa.Table) -> pa.Table:
        tree = rows.column("tree")[0].as_py()
        f, cut, left, right = grow_tree(np.stack([rows.column(c).to_numpy() for c in STATISTICS], axis=1), np.random.default_rng((seed, tree)))
        return pa.table({"tree": pa.array([tree], pa.int32())} | {k: pa.array([v.tolist()], t) for k, v, t in (("f", f, pa.list_(pa.int64())), ("cut", cut, pa.list_(pa.float64())), ("l", left, pa.list_(pa.float64())), ("r", right, pa.list_(pa.int64())))})

    grown = dealt.groupBy("tree").applyInArrow(grow, "tree int, f array<long>, cut array<double>, l array<double>, r array<long>").collect()
    return IsolationForest([tuple(map(np.array, (r.f, r.cut, r.l, r.r))) for r in sorted(grown)], rows=max(n * copies // TREES, 2))


def calibrate_on_all(forest: IsolationForest, known: DataFrame, durable: Durable) -> IsolationForest:
    """The threshold that ``IsolationForest.calibrate`` sets, of all rows (``y``, STATISTICS) and without
    taking them to the driver: running counts in slices of the scores' range, and those of the slices before."""
    counts = scored(known, forest, "y").groupBy("anomaly").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad"))
    counts = durable.keep(counts.withColumn("slice", F.floor(F.col("anomaly") * SLICES)), "scores")
    slices = counts.groupBy("slice").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("anomaly").alias("least")).orderBy("slice").collect()
    good, bad = sum(s.good for s in slices), sum(s.bad for s in slices)
    if good and bad:
        before, g, b = [], 0, 0
        for s, after in zip(slices, [*slices[1:], None], strict=True):
            before.append((s.slice, g, b, after and after.least))
            g, b = g + s.good, b + s.bad
        offsets = known.sparkSession.createDataFrame(before, "slice long, g long, b long, least double")
        order = Window.partitionBy("slice").orderBy("anomaly")
        running = order.rowsBetween(Window.unboundedPreceding, 0)
        gain = (F.col("g") + F.sum("good").over(running)) * F.lit(bad) - (F.col("b") + F.sum("bad").over(running)) * F.lit(good)
        after = F.coalesce(F.lead("anomaly").over(order), "least", "anomaly").alias("after")
        best = counts.join(F.broadcast(offsets), "slice").select(gain.alias("gain"), "anomaly", after).orderBy(F.desc("gain"), F.desc("anomaly")).first()
        forest.threshold = (best.anomaly + best.after) / 2
    durable.drop("scores")
    return forest


def fit_statistics(stats: DataFrame, labels: DataFrame) -> IsolationForest:
    """``fit`` on the statistics of ``rule_statistics``."""
    durable = Durable(stats.sparkSession)
    one = stats.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*STATISTICS)).alias("s"))
    known = durable.keep(one.join(sized(durable.keep(truth(labels, "quality"), "truth")), "doc_id").select("doc_id", "y", "s.*"), "known")
    forest = calibrate_on_all(grow_from_all(known), known, durable)
    durable.drop("truth", "known")
    return forest


def fit(documents: DataFrame, labels: DataFrame) -> IsolationForest:
    """A forest grown and calibrated on all labelled documents, good and bad.

    Of several rows of an id, the one with the least statistics counts.
    """
    durable = Durable(documents.sparkSession)
    forest = fit_statistics(durable.keep(rule_statistics(documents), "statistics"), labels)
    durable.drop("statistics")
    return forest


def base_failed(min_words: int = 10, repeat_percent: int = 20) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def quality_rules(documents: DataFrame, forest: IsolationForest) -> DataFrame:
    """Rule statistics and verdict of every row of ``documents``.

    Returns ``doc_id``, COUNTS, ``base_failed``, ``anomaly`` and ``kept``: neither a fixed rule
    nor the forest rejects it. Null, empty and blank texts have no words and fail the base rule.
    Null ids and repeated rows stay as rows; other columns are not looked at; no rows, no result.
    """
    return judged(rule_statistics(documents), forest)


def judged(stats: DataFrame, forest: IsolationForest) -> DataFrame:
    """``quality_rules`` of the statistics of ``rule_statistics``."""
    found = scored(stats, forest, "doc_id", *COUNTS)
    return found.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= float(forest.threshold)))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = Durable(spark).keep(rule_statistics(table(spark, sf_dir, "documents")), "statistics")  # read once to learn and once to judge
    return judged(stats, fit_statistics(stats, table(spark, sf_dir, "labels")))

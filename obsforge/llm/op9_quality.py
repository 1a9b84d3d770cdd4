"""Quality classifier: a sparse rule ensemble, compiled into Spark column expressions.

Boosted shallow trees over text statistics give paths; each path is a rule, a conjunction of
bounds. A lasso logistic regression weighs the rules, most of them zero; the rest become one
column expression, which Spark evaluates on the statistics of every document.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textstats import FEATURES, labelled, text_statistics

#: Labelled rows, at most about so many, that the model is learned from.
SAMPLE_ROWS = 20_000
TREES = 30
DEPTH = 3
BINS = 32
MIN_LEAF = 5
PENALTY = 2e-3
CUT = 0.3
#: Of doc_id's crc32: rows with this remainder are held out, never learned from.
FOLD = (5, 0)

#: Bounds of a rule: for each feature it looks at, low < x <= high.
Rule = tuple[tuple[int, float, float], ...]


@dataclass
class RuleEnsemble:
    intercept: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.intercept + sum((w * holds(rule, x) for rule, w in self.rules), np.zeros(len(x)))

    def column(self) -> Column:
        """The score, between 0 and 1, from columns named as FEATURES."""

        def term(rule: Rule, weight: float) -> Column:
            bounds = [b for f, low, high in rule for b in ((F.col(FEATURES[f]) > float(low)) if low > -np.inf else None, (F.col(FEATURES[f]) <= float(high)) if high < np.inf else None) if b is not None]
            return F.when(reduce(Column.__and__, bounds), F.lit(float(weight))).otherwise(F.lit(0.0))

        total = reduce(Column.__add__, [term(*r) for r in self.rules], F.lit(float(self.intercept)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, low, high in rule:
        out &= (x[:, f] > low) & (x[:, f] <= high)
    return out


def grow_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The paths to all nodes of trees boosted on the logistic loss; splits lie between quantiles."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin, rules = np.zeros(len(y)), {}

    def split(rows: np.ndarray, bounds: dict[int, tuple[float, float]], depth: int, g: np.ndarray, h: np.ndarray) -> None:
        if bounds:
            rules.setdefault(tuple((f, *b) for f, b in sorted(bounds.items())), None)
        best = (1e-9, -1, 0)
        if depth < DEPTH and len(rows) >= 2 * MIN_LEAF:
            whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
            for f, c in enumerate(cuts):
                if len(c):
                    n, gs, hs = (np.cumsum(np.bincount(binned[rows, f], weights=v, minlength=len(c) + 1))[:-1] for v in (np.ones(len(rows)), g[rows], h[rows]))
                    gain = gs**2 / (hs + 1) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1) - whole
                    gain[(n < MIN_LEAF) | (n > len(rows) - MIN_LEAF)] = -1
                    if gain.max() > best[0]:
                        best = (gain.max(), f, int(gain.argmax()))
        if best[1] < 0:
            margin[rows] += 0.3 * g[rows].sum() / (h[rows].sum() + 1)
            return
        _, f, k = best
        low, high = bounds.get(f, (-np.inf, np.inf))
        left = binned[rows, f] <= k
        split(rows[left], bounds | {f: (low, float(cuts[f][k]))}, depth + 1, g, h)
        split(rows[~left], bounds | {f: (float(cuts[f][k]), high)}, depth + 1, g, h)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        split(np.arange(len(y)), {}, 0, y - p, np.maximum(p * (1 - p), 1e-6))
    return list(rules)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 400) -> tuple[np.ndarray, float]:
    """L1-penalised logistic weights by accelerated proximal gradient; the intercept is free."""
    n, k = z.shape
    base = np.log((y.sum() + 1) / (n - y.sum() + 1))
    w, b = np.zeros(k), base
    v, c, t = w.copy(), b, 1.0
    rate = 4 / (np.linalg.norm(np.column_stack([z, np.ones(n)]), 2) ** 2 / n)
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(z @ v + c))) - y
        w_new = v - rate * (z.T @ r) / n
        w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - rate * penalty, 0)
        b_new = c - rate * r.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return w, float(b)


def learn(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    """A rule ensemble; with rows of one label or none, the smoothed share of label 1."""
    if len(y) == 0 or y.min() == y.max():
        return RuleEnsemble(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    rules = grow_rules(x, y)
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    _, first = np.unique(z, axis=1, return_index=True)
    first = np.sort(first)
    w, b = lasso(z[:, first], y)
    return RuleEnsemble(b, [(rules[j], float(a)) for j, a in zip(first, w, strict=True) if abs(a) > 1e-6])


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """Learn ``labels.quality`` from a bounded sample (about ``sample_rows``) of rows that are not held out."""
    sample = text_statistics(labelled(documents, labels, "quality", sample_rows, FOLD), "doc_id", "y").orderBy("doc_id", *FEATURES)
    rows = np.array([tuple(r) for r in sample.select("y", *FEATURES).collect()]).reshape(-1, 1 + len(FEATURES))
    return learn(rows[:, 1:], rows[:, 0])


def score(documents: DataFrame, model: RuleEnsemble, *keep: str) -> DataFrame:
    """``keep`` columns and ``score`` of every row: how likely its text has quality label 1.

    Scores depend on the text alone; null and empty texts get that of a text without words.
    Repeated rows and null ids stay as rows; no rows, no result.
    """
    return text_statistics(documents, *keep).select(*keep, model.column().alias("score"))


def keep_good(documents: DataFrame, model: RuleEnsemble, cut: float = CUT) -> DataFrame:
    """The rows of ``documents`` with a score of at least ``cut``, all columns as they are."""
    # Names of the rows' own columns may be those of statistics, so they travel under others.
    own = [f"__{i}" for i in range(len(documents.columns))]
    rows = documents.toDF(*own).withColumn("text", F.col(own[documents.columns.index("text")]))
    return score(rows, model, *own).where(F.col("score") >= cut).select(*own).toDF(*documents.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLD[0] == FOLD[1], F.lit(False))  # a row without an id is in no fold
    return score(documents, model, "doc_id").select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

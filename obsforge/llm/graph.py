"""Connected components of an undirected graph, in Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Durable


#: Graphs of so many edges at most go round in one task, without a shuffle.
SMALL_EDGES = 20_000


def connected_components(edges: DataFrame, durable: Durable, rounds: int = 60) -> DataFrame:
    """The component of each node that has an edge, named by its smallest node.

    ``edges`` has two long columns ``a`` and ``b``. Alternating star contraction: each round
    hangs a node's larger neighbours, then its smaller ones, on the least node that it sees. The
    edges never become more, node minima are combined before they are shuffled, and each round is
    written to the shared folder (the minima apart, so that Spark can split a hub's rows when it
    joins them), so no round is repeated when an executor is lost. Null ends and
    loops are left out; an empty input gives an empty result. Returns ``node``, ``component``.
    """
    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    star = durable.keep(ends.where("u <> v").distinct(), "star")
    small = star.count() <= SMALL_EDGES

    def kept(df: DataFrame, name: str) -> DataFrame:
        out = durable.keep(df, name)
        return out.coalesce(1) if small else out

    star = star.coalesce(1) if small else star
    before = None
    for _ in range(rounds):
        both = star.select("u", "v").union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = both.coalesce(1) if small else both
        least = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = kept(large, "large")
        low = kept(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        hung = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        star = kept(hung, "star")
        now = tuple(star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    durable.drop("large", "least")
    roots = star.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

"""Near copies by an exact join of shingle sets: documents whose Jaccard similarity is 0.8 or more link.

The groups that SimHash fingerprints find come first (``op4_simhash.set_links``), verified on the
sets; a fingerprint of a fixed radius loses most pairs at 0.8, and this join finds those. Of two sets
that are so similar, the first few shingles by any common order (a fifth of them and one more) have
one in common; documents meet at those, unless they are in one group already. A sketch of parity bits,
about as many as a set has shingles, bounds how many part a pair from below, and each pair that it
leaves is verified on the whole sets.

The order puts shingles last that many documents have: first those of a bounded sample, then, for the
documents that it does not keep apart, those that more than CROWD of them meet at. It sets the cost
only: the links are the same in any order. What still meets in a crowd is nearly all made of such
shingles. It is compared with one of the crowd first, and those that are linked already need no
comparison among each other; only what PIVOTS such rounds leave in different groups is compared pair
by pair, so no link between groups is lost.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Durable, hashed_share, map_batches, sized, utf8
from .graph import connected_components

SHINGLE_WORDS = 5
#: Sets that meet at a shingle are compared pair by pair up to so many.
CROWD = 32
PIVOTS = 1
#: How often the shingles that crowds meet at are put last and documents meet anew.
ROUNDS = 1
#: Bits of a sketch: as many as a set has shingles, rounded up to a power of two, within these bounds.
LEAST_BITS, MOST_BITS = 64, 1 << 17
#: Documents, about so many at most, and shingles that tell which shingles are common.
SAMPLE_DOCUMENTS = 10_000
COMMON = 200_000


def key(doc_id: Column, text: Column) -> Column:
    """What tells rows apart, in their order: rows without an id last, then by id and text."""
    return F.struct(doc_id.isNull().cast("long").alias("none"), F.coalesce(doc_id.cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("print"))


def shingles(text: bytes) -> np.ndarray:
    """The XXH64 of each different shingle of a text, in order; fewer words are one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    parts = [b" ".join(words)] if n == 1 else map(b" ".join, zip(*(words[i : n + i] for i in range(SHINGLE_WORDS)), strict=True))
    return np.unique(np.array([xxhash.xxh64_intdigest(p, 42) for p in parts], "<u8").view(np.int64))


def sketched_fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each set if it is in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def in_order(of: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A set's shingles, rare ones first: by how many documents of the sample have them, then by their hash."""
    if not len(common) or not len(of):
        return of
    at = np.minimum(np.searchsorted(common, of), len(common) - 1)
    order = np.where(common[at] == of, rank[at], 0)
    return of[np.lexsort((of, order))]


def first_shingles(ordered: np.ndarray) -> np.ndarray:
    """As many of a set as must share one with the first of any set that is similar."""
    n = len(ordered)
    return ordered[: n - (4 * n + 4) // 5 + 1] if n else ordered


def sketch(of: np.ndarray) -> np.ndarray:
    """For each value of the last bits of a hash, whether an odd number of shingles has it; 64 in a long."""
    bits = min(max(LEAST_BITS, 1 << (max(len(of), 1) - 1).bit_length()), MOST_BITS)
    return np.packbits((np.bincount(of & (bits - 1), minlength=bits) & 1).astype(bool), bitorder="little").view("<i8")


def parted(a: Column, b: Column) -> Column:
    """How many bits part two sketches, at the length of the shorter one. Sets of like size differ by one step at most."""

    def half(x: Column) -> Column:
        n = F.call_function("div", F.size(x), F.lit(2)).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q))

    def apart(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, d: n + d)

    return F.when(F.size(a) == F.size(b), apart(a, b)).when(F.size(a) > F.size(b), apart(half(a), b)).otherwise(apart(a, half(b)))


def similar(both: Column, a: Column, b: Column) -> Column:
    """Whether the Jaccard similarity is at least 4/5, in whole numbers."""
    return 9 * both >= 4 * (a + b)


def _common(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of the sample have, sorted, and in how many."""
    share = min(1.0, SAMPLE_DOCUMENTS / max(documents.count(), 1))
    some = documents.where(hashed_share(F.xxhash64("text"), share)).select(utf8("text").alias("t")).distinct()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(x.as_py()) for x in batch.column(0)]))], ["s"])

    top = map_batches(some, each, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1").orderBy(F.desc("c"), "s").limit(COMMON).toPandas().sort_values("s")
    return top["s"].to_numpy(np.int64), top["c"].to_numpy(np.int64)


def _rows(documents: DataFrame, common: np.ndarray, rank: np.ndarray) -> DataFrame:
    """Each row's key with its set: a hash ``node`` that names it, its fingerprint, ``size``, sketch and first shingles."""
    long = pa.list_(pa.int64())

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x.as_py()) for x in batch.column(1)]
        node = pa.array([xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets], pa.int64())
        fp = pa.array(np.array([sketched_fingerprint(s) for s in sets], "<u8").view(np.int64))
        first = pa.array([first_shingles(in_order(s, common, rank)) for s in sets], long)
        bits = pa.array([sketch(s) for s in sets], long)
        return pa.RecordBatch.from_arrays([batch.column(0), node, fp, pa.array([len(s) for s in sets], pa.int64()), bits, first], ["k", "node", "fp", "size", "bits", "first"])

    return map_batches(documents.select("k", utf8("text").alias("t")), each, "k struct<none: long, id: long, print: long>, node long, fp long, size long, bits array<long>, first array<long>")


def _sets(documents: DataFrame, wanted: DataFrame, common: np.ndarray, rank: np.ndarray) -> DataFrame:
    """The whole set of each node of ``wanted``, rare shingles first, from the text that its key tells."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([in_order(shingles(x.as_py()), common, rank) for x in batch.column(1)], pa.list_(pa.int64()))], ["node", "all"])

    texts = documents.join(wanted, "k").select("node", utf8("text").alias("t"))
    return map_batches(texts, each, "node long, all array<long>").dropDuplicates(["node"])


def _late(every: np.ndarray, late: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The first shingles of a set when some, of which others have ``count``, come last, by that and then by hash."""
    return first_shingles(np.concatenate([every[~np.isin(every, late)], late[np.lexsort((late, count))]]))


def _demoted(documents: DataFrame, wanted: DataFrame, order: tuple[np.ndarray, np.ndarray], crowded: DataFrame, durable: Durable) -> DataFrame:
    """``node``, ``size`` and the first shingles of sets when those of ``crowded`` (``s``, ``c``) come last, by ``c``.

    So many as may be broadcast are told to each task; more are joined.
    """
    long, out = pa.list_(pa.int64()), "node long, size long, first array<long>"

    def batch_of(node: pa.Array, sets: list[np.ndarray], first: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([node, pa.array([len(s) for s in sets], pa.int64()), pa.array(first, long)], ["node", "size", "first"])

    if crowded.count() <= BROADCAST_ROWS:
        table = crowded.toPandas().sort_values("s")
        late, count = table["s"].to_numpy(np.int64), table["c"].to_numpy(np.int64)

        def told(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets, first = [in_order(shingles(x.as_py()), *order) for x in batch.column(1)], []
            for s in sets:
                at = np.minimum(np.searchsorted(late, s), len(late) - 1)
                held = late[at] == s
                first.append(_late(s, s[held], count[at[held]]))
            return batch_of(batch.column(0), sets, first)

        return map_batches(documents.join(wanted, "k").select("node", utf8("text").alias("t")), told, out).dropDuplicates(["node"])
    sets = durable.keep(_sets(documents, wanted, *order), "whole")
    held = sets.select("node", F.explode("all").alias("s")).join(crowded, "s").groupBy("node").agg(F.collect_list(F.struct("s", "c")).alias("h"))

    def joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        arrays = [[np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64) for x in batch.column(k)] for k in (1, 2, 3)]
        return batch_of(batch.column(0), arrays[0], [_late(*x) for x in zip(*arrays, strict=True)])

    return map_batches(sets.join(held, "node").select("node", "all", "h.s", "h.c"), joined, out)


Near = Callable[[DataFrame, Durable], DataFrame]


def groups(documents: DataFrame, durable: Durable, near: Near | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows as members of sets (``k``, ``node``), and sets that have links with their group (``node``, ``component``).

    ``documents`` has a key ``k`` and ``text``. ``near`` gives pairs of sets to look at first.
    """
    order = _common(documents)
    rows = durable.keep(_rows(documents, *order), "rows")
    nodes = durable.keep(rows.select("node", "fp", "size", "bits", "first").dropDuplicates(["node"]), "nodes")
    members = durable.keep(rows.select("k", "node"), "members")
    durable.drop("rows")
    found = Links(documents, members, nodes, order, durable).find(near)
    durable.drop("nodes")
    return members, durable.keep(connected_components(found, durable), "groups")


class Links:
    """Links ``a``, ``b`` between nodes that are similar; all that part the groups, not all in a group."""

    def __init__(self, documents: DataFrame, members: DataFrame, nodes: DataFrame, order: tuple[np.ndarray, np.ndarray], durable: Durable) -> None:
        self.documents, self.members, self.nodes, self.order, self.durable = documents, members, nodes, order, durable
        self.found = documents.sparkSession.createDataFrame([], "a long, b long")

    def texts(self, wanted: DataFrame) -> DataFrame:
        """The key ``k`` of a row that has each ``node``."""
        wanted = self.durable.keep(wanted, "wanted")
        firsts = self.members.join(sized(wanted), "node", "left_semi").groupBy("node").agg(F.min("k").alias("k"))
        return sized(self.durable.keep(firsts, "firsts"))

    def add(self, pairs: DataFrame) -> None:
        """Those of ``pairs`` that are similar become links: held against sketches first, then against whole sets."""
        slim = self.nodes.select("node", "size", "bits")
        left, right = (slim.toDF(k, f"n{k}", f"bits{k}") for k in "ab")
        near = pairs.select("a", "b").distinct().join(left, "a").join(right, "b")
        close = self.durable.keep(near.where(9 * parted(F.col("bitsa"), F.col("bitsb")) <= F.col("na") + F.col("nb")).select("a", "b"), "close")
        if close.isEmpty():
            return
        wanted = self.texts(close.select(F.col("a").alias("node")).union(close.select("b")).distinct())
        sets = self.durable.keep(_sets(self.documents, wanted, *self.order), "sets")
        left, right = (sets.toDF(k, f"all{k}") for k in "ab")
        both = F.size(F.array_intersect("alla", "allb"))
        out = close.join(left, "a").join(right, "b").where(similar(both, F.size("alla"), F.size("allb"))).select("a", "b")
        self.found = self.durable.keep(self.found.unionByName(out), "found")
        self.durable.drop("close", "wanted", "firsts", "sets")

    def posts(self) -> DataFrame:
        """``node``, ``size`` and ``s`` of first shingles that several nodes have, with in how many, ``c``."""
        first = self.nodes.select("node", "size", "first")
        crowded = moved = None
        for turn in range(ROUNDS + 1):
            shared = self.durable.keep(first.select(F.explode("first").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")
            more = shared.where(F.col("c") > CROWD)
            more = more if crowded is None else more.join(crowded.select("s"), "s", "left_anti")
            more = self.durable.keep(more, "more")
            if turn == ROUNDS or more.isEmpty():
                break
            met = first.select("node", F.explode("first").alias("s")).join(sized(more), "s", "left_semi").select("node").distinct()
            met = self.durable.keep(met if moved is None else met.unionByName(moved.select("node")).distinct(), "met")
            crowded = self.durable.keep(more if crowded is None else crowded.unionByName(more), "crowded")
            moved = self.durable.keep(_demoted(self.documents, self.texts(met), self.order, crowded, self.durable), "moved")
            first = self.nodes.select("node", "size", "first").join(sized(moved.select("node")), "node", "left_anti").unionByName(moved)
        self.durable.drop("more", "met", "crowded", "whole", "wanted", "firsts")
        return first.select("node", "size", F.explode("first").alias("s")).join(sized(shared), "s")

    def labelled(self, of: DataFrame) -> DataFrame:
        """With the group that a node is in so far, its ``label``."""
        grouped = self.durable.keep(connected_components(self.found, self.durable), "groups")
        return of.join(sized(grouped), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")

    def find(self, near: Near | None = None) -> DataFrame:
        durable = self.durable
        if near:
            self.add(near(self.nodes, durable))
        met = durable.keep(self.posts().withColumn("label", F.col("node")), "met")
        self.add(_pairs(met.where(F.col("c") <= CROWD), ["s"]))
        # Crowds are told apart by size: similar sets are in the same class or the next, so they share one of two.
        kind = F.floor(F.log("size") / F.log(F.lit(1.26)))
        crowds = durable.keep(met.where(F.col("c") > CROWD).select("node", "size", "s", F.explode(F.array(kind, kind + 1)).alias("kind")), "crowds")
        durable.drop("shared", "met", "moved")
        keys = ["s", "kind"]
        before = None
        for turn in range(PIVOTS + 1) if not crowds.isEmpty() else ():
            if self.found is not before:  # links have come in since
                before, labelled = self.found, durable.keep(self.labelled(crowds), "labelled")
            counts = durable.keep(labelled.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n")), "counts")
            apart = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("n", "label")).alias("main")).where("labels > 1")
            apart = durable.keep(apart, "apart")
            if apart.isEmpty():
                break
            left = labelled.join(sized(apart), keys)
            if turn == PIVOTS:
                self.add(_pairs(left, keys))
                break
            # After the first turn, from those outside of the largest group: the others are linked by now.
            least = F.min_by(F.struct("node", "size", "label"), F.xxhash64("node", F.lit(turn)))
            pivots = durable.keep((left if turn == 0 else left.where("label <> main")).groupBy(*keys).agg(least.alias("p")), "pivots")
            with_pivot = left.join(sized(pivots), keys).where("label <> p.label and 5 * size >= 4 * p.size and 5 * p.size >= 4 * size")
            self.add(with_pivot.select(F.col("node").alias("a"), F.col("p.node").alias("b")))
        durable.drop("crowds", "labelled", "counts", "apart", "pivots")
        return self.found


def _pairs(of: DataFrame, keys: list[str]) -> DataFrame:
    """All two nodes of a key that are in different groups and of like size."""
    a, b = (of.select(*keys, F.col("node").alias(k), F.col("size").alias(f"n{k}"), F.col("label").alias(f"l{k}")) for k in "ab")
    return a.join(b, keys).where("5 * na >= 4 * nb and 5 * nb >= 4 * na and la < lb").select("a", "b")

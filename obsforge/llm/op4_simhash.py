"""SimHash near-duplicates by generalised pigeonhole search with unequal thresholds.

Documents get 64-bit fingerprints; fingerprints that differ in few bits link. The bits are put
into partitions, correlated ones together. A fingerprint ``q`` finds all its partners ``x`` if it
is given thresholds that sum up to ``radius - partitions + 1``, one a partition (-1: not probed):
in some partition ``i`` then ``x`` differs from ``q`` in no more than ``t_i`` bits. Dynamic
programming picks the cheapest thresholds from estimated candidate counts, fingerprint by
fingerprint; every value that its balls hold is probed and each candidate verified.

The same programming picks the number of partitions, from the number of fingerprints and how evenly
their bits are spread: three of 21 bits for millions, two of 32 bits for billions. One partition
belongs to them too, the whole word: there both sides of a pair share the radius, since two words are
within two bits if and only if they have a word within one bit in common. That costs 65 rows a
fingerprint whatever the others are, so it links the crowds of near copies, where any thresholds cost
more, and no link is lost. Rows grow with the number of fingerprints at any size.

``keep_first`` takes sets of five-word shingles and a Jaccard similarity of 0.8, exactly. Fingerprints
find the closest pairs, each verified on the sets; as most pairs at 0.8 are more than two bits apart,
the join of ``near_copies`` goes on from their groups to the links that fingerprints cannot find.
"""

from __future__ import annotations

import itertools
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_copies
from .common import Durable, map_batches, sized, table, unsigned_hex, utf8
from .graph import connected_components
from .near_copies import sketched_fingerprint

BITS = 64
SHINGLE_WORDS = 3
RADIUS = 2
#: Numbers of partitions to choose from, besides one.
PARTITIONS = (2, 3, 4)
#: Fingerprints that share a partition's value count one by one from here on; below it, the bound is used.
CROWD = 20
#: Names of nodes for fingerprints that no document with an id has.
NAMELESS = 1 << 62


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text: bit set if it is in over half of the shingles' XXH64 (seed 42)."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        hashes = [digest(b" ".join(words), 42)]
    else:
        parts = [words[i : n + i] for i in range(shingle_words)]
        hashes = [digest(s, 42) for s in map(b" ".join, zip(*parts, strict=True))]
    return sketched_fingerprint(np.array(hashes, dtype="<u8"))


def fingerprints(documents: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long, of every row. A null text is an empty one: zero."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(x.as_py(), shingle_words) for x in batch.column(1)), "<u8", batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("t")), each, "doc_id long, fp long")


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each two bits, of those with both set; over all rows."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
        return pa.RecordBatch.from_arrays([pa.array([np.append((bits.T @ bits).ravel(), len(bits)).astype(np.int64)])], ["c"])

    rows = map_batches(prints.select("fp"), each, "c array<long>").select(F.posexplode("c").alias("k", "c")).groupBy("k").agg(F.sum("c").alias("c")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for row in rows:
        flat[row.k] = row.c
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, partitions: int) -> list[list[int]]:
    """Bits in groups of nearly equal width, each grown by the bit most correlated with those in it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for i in range(partitions):
        width = (BITS - sum(map(len, groups))) // (partitions - i)
        group = [max(free, key=lambda b: (corr[b, sorted(free)].sum(), -b))]
        free.remove(group[0])
        while len(group) < width:
            b = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(b)
            free.remove(b)
        groups.append(sorted(group))
    return groups


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def balls(bits: list[int], radius: int) -> np.ndarray:
    """What to flip for all values within the radius, as masks."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in itertools.combinations(bits, r)], dtype=np.uint64).view(np.int64)


def allocate(costs: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds of least cost, row by row, by dynamic programming over the partitions.

    ``costs[row, i, t + 1]`` is what threshold ``t`` costs in partition ``i`` (-1: nothing).
    Returns the thresholds (rows, partitions), which sum up to ``total``, and their cost.
    """
    rows, m, kinds = costs.shape
    low = -m
    sums = range(low, m * (kinds - 2) + 1)
    best = {0: np.zeros(rows)}
    back: list[dict[int, np.ndarray]] = []
    for i in range(m):
        now: dict[int, np.ndarray] = {}
        how: dict[int, np.ndarray] = {}
        for s in sums:
            ways = [(t, best[s - t] + costs[:, i, t + 1]) for t in range(-1, kinds - 1) if s - t in best]
            if ways:
                each = np.stack([w for _, w in ways])
                pick = each.argmin(0)
                now[s], how[s] = each.min(0), np.array([t for t, _ in ways])[pick]
        best = now
        back.append(how)
    out, left = np.zeros((rows, m), np.int64), np.full(rows, total)
    for i in reversed(range(m)):
        table_ = np.zeros((rows, len(sums)), np.int64)
        for s, how in back[i].items():
            table_[:, s - low] = how
        out[:, i] = table_[np.arange(rows), left - low]
        left -= out[:, i]
    return out, best[total]


def choose_groups(n: int, both: np.ndarray, radius: int = RADIUS) -> list[list[int]]:
    """The bits in as many partitions as make the cheapest thresholds cheapest, for bits independent but as uneven as they are."""
    p = np.diag(both) / max(n, 1)
    same = np.clip(p * p + (1 - p) * (1 - p), 0.5, 1)

    def cost(groups: list[list[int]]) -> float:
        costs = np.zeros((1, len(groups), radius + 2))
        for i, g in enumerate(groups):
            at = [np.prod(same[g]), 0.0, 0.0]  # two values of the partition differ in no bit, one or two
            odds = (1 - same[g]) / same[g]
            at[1] = at[0] * odds.sum()
            at[2] = at[0] * (odds.sum() ** 2 - (odds**2).sum()) / 2
            for t in range(radius + 1):
                costs[0, i, t + 1] = sum(comb(len(g), k) + n * at[k] for k in range(t + 1))
        return float(allocate(costs, radius - len(groups) + 1)[1][0])

    return min((group_bits(n, both, m) for m in PARTITIONS), key=cost)


def linked(prints: DataFrame, durable: Durable, partitions: int | None = None, radius: int = RADIUS) -> DataFrame:
    """Links ``a``, ``b`` between the names of fingerprints at ``radius`` (2) or fewer differing bits.

    ``prints`` has distinct ``fp`` with a ``name`` each. Links between the same two may repeat;
    in a crowd, each fingerprint is linked to the least one around a word, which joins the same.
    Without ``partitions``, their number is the one that costs least.
    """
    if radius != 2:
        raise ValueError("crowds are linked by words within one bit, which holds for a radius of 2")
    n, both = bit_counts(prints)
    groups = group_bits(n, both, partitions) if partitions else choose_groups(n, both, radius)
    partitions = len(groups)
    masks = [_mask(g) for g in groups]
    total = radius - partitions + 1
    # Values that more than CROWD fingerprints share, and what they add to a ball of radius one or two around another value.
    values = prints.select(F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)])).alias("x")).select("x.*")
    counts = durable.keep(values.groupBy("part", "v").agg(F.count(F.lit(1)).alias("c")), "counts")
    moments = {r.part: r for r in counts.groupBy("part").agg(F.sum((F.col("c") * F.col("c")).cast("double")).alias("sq")).collect()}
    crowds = counts.where(F.col("c") > CROWD)
    crowded = [
        durable.keep(
            crowds.where(F.col("part") == i)
            .select("v", "c", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(int(x)).alias("flip")) for d in (0, 1) for x in balls(g, d)[len(balls(g, d - 1)) if d else 0 :]])).alias("x"))
            .groupBy(F.col("v").bitwiseXOR(F.col("x.flip")).alias(f"v{i}"))
            .agg(F.sum(F.when(F.col("x.d") == 0, F.col("c")).otherwise(0)).alias(f"at{i}"), F.sum("c").alias(f"near{i}")),
            f"crowds{i}",
        )
        for i, g in enumerate(groups)
    ]
    costed = prints
    for i, m in enumerate(masks):
        costed = costed.withColumn(f"v{i}", F.col("fp").bitwiseAND(F.lit(m))).join(crowded[i], f"v{i}", "left")
    usual = [sum(1 for _ in g) for g in groups]
    # Outside of crowds: what a ball of radius t holds if values lie as they do on the whole, and CROWD at most for each.
    mean = [[min(CROWD * 1.0, moments[i].sq / max(n, 1) if i in moments else 0) for i in range(partitions)], [n * comb(w, 1) / 2.0**w for w in usual], [n * comb(w, 2) / 2.0**w for w in usual]]
    around = [[balls(g, t) for t in range(radius + 1)] for g in groups]

    def probe(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp, name = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        costs = np.zeros((len(fp), partitions, radius + 2))
        for i in range(partitions):
            at, near = (np.nan_to_num(batch.column(2 + 2 * i + k).cast(pa.float64()).to_numpy(zero_copy_only=False)) for k in (0, 1))
            costs[:, i, 1] = np.where(at > 0, at, mean[0][i]) + 1
            costs[:, i, 2] = np.maximum(near, at) + np.where(at > 0, 0, mean[0][i]) + mean[1][i] + len(around[i][1])
            costs[:, i, 3] = np.inf if radius > 2 else costs[:, i, 2] + mean[2][i] + len(around[i][2])
        thresholds, cost = allocate(costs, total)
        crowd = cost > CROWD * partitions + BITS
        part, key, who = [np.full(crowd.sum(), -1)], [fp[crowd]], [np.flatnonzero(crowd)]
        for i in range(partitions):
            for t in range(radius + 1):
                rows = np.flatnonzero(~crowd & (thresholds[:, i] == t))
                flips = around[i][t]
                key.append(((fp[rows] & masks[i])[:, None] ^ flips).ravel())
                part.append(np.full(len(rows) * len(flips), i))
                who.append(np.repeat(rows, len(flips)))
        who = np.concatenate(who)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(part).astype(np.int32)), pa.array(np.concatenate(key)), pa.array(fp[who]), pa.array(name[who])], ["part", "v", "fp", "name"])

    asked = durable.keep(map_batches(costed.select("fp", "name", *[c for i in range(partitions) for c in (f"at{i}", f"near{i}")]), probe, "part int, v long, fp long, name long"), "asked")
    # No one asks for a value that so many share, as its count is in the cost.
    index = prints.select("name", "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)])).alias("x")).select(F.col("name").alias("b"), F.col("fp").alias("other"), "x.*")
    index = index.join(counts.where(F.col("c") > CROWD * partitions + BITS).select("part", "v"), ["part", "v"], "left_anti")
    found = asked.where("part >= 0").join(index, ["part", "v"]).where((F.col("name") != F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)).select(F.col("name").alias("a"), "b")
    one = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_mask([b]))) for b in range(BITS)])
    words = asked.where("part < 0").select("name", F.explode(one).alias("word"))
    least = words.groupBy("word").agg(F.min("name").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1")
    close = words.join(least, "word").where("name <> b").select(F.col("name").alias("a"), "b")
    return found.unionByName(close).distinct()


def simhash_groups(documents: DataFrame, partitions: int | None = None, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row of ``documents``.

    Lower-cases A-Z, takes shingles of ``shingle_words`` words (fewer words: all of them). Null and
    empty texts, and those of white space, have fingerprint zero and link like any other. The
    component is named by its smallest ``doc_id``; repeated rows and ids stay, each a row. Rows
    with a null id count as members and get their component's name, null if none of it has an id.
    No rows, no result. Other columns are not looked at.
    """
    spark = documents.sparkSession
    durable = Durable(spark)
    prints = durable.keep(fingerprints(documents, shingle_words), "prints")
    nameless = F.lit(NAMELESS) + F.shiftrightunsigned("fp", 2)
    distinct = durable.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("name")).select("fp", F.coalesce("name", nameless).alias("name")), "distinct")
    edges = durable.keep(linked(distinct, durable, partitions), "links")
    groups = connected_components(edges, durable)
    least = distinct.join(groups, F.col("name") == F.col("node"), "left").select("fp", F.coalesce("component", "name").alias("component_id"))
    least = durable.keep(least, "components")
    return prints.join(least, "fp").select("doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), F.when(F.col("component_id") < NAMELESS, F.col("component_id")).alias("component_id"))


def set_links(nodes: DataFrame, durable: Durable) -> DataFrame:
    """Pairs ``a``, ``b`` of sets whose fingerprints are equal or linked, each set with the first of its fingerprint."""
    first = durable.keep(nodes.groupBy("fp").agg(F.min("node").alias("name")), "firsts_of_prints")
    same = nodes.select("node", "fp").join(first, "fp").where("node <> name").select(F.col("name").alias("a"), F.col("node").alias("b"))
    near = linked(first, durable)
    return durable.keep(same.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), "print_links")


def keep_first(documents: DataFrame) -> DataFrame:
    """One row of each group of near copies: the first by id, nulls last, then by text.

    Near copies have a Jaccard similarity of 0.8 or more of their sets of five-word shingles (fewer
    words: all of them); groups are what such pairs join. Lower-cases A-Z; words are runs without
    ASCII white space. Rows whose texts have the same shingles are one group (all empty and null
    texts are), with an id or without, repeated or not; rows are told apart by id and text, so a
    repeated id takes no other text along. A very long text is a set of as many shingles as words,
    one row's work. No rows, no result. All columns are kept as they are, whatever their names.
    """
    durable = Durable(documents.sparkSession)
    # The rows' own columns travel under other names, so that none of theirs can clash.
    own = [f"c{i}" for i in range(len(documents.columns))]
    doc_id, text = (F.col(own[documents.columns.index(c)]) for c in ("doc_id", "text"))
    docs = documents.toDF(*own)
    keyed = docs.select(near_copies.key(doc_id, text).alias("k"), text.alias("text"))
    members, groups = near_copies.groups(keyed, durable, set_links)
    each = members.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
    each = durable.keep(each.join(sized(groups), "node", "left").select("k", "n", F.coalesce("component", "node").alias("group")), "each")
    stay = each.groupBy("group").agg(F.min("k").alias("k")).select("k")
    gone = durable.keep(each.join(stay, "k", "left_anti").select("k"), "gone")
    twice = durable.keep(each.where("n > 1").join(stay, "k", "left_semi").select("k"), "twice")
    kept = docs.withColumn("k", near_copies.key(doc_id, text)).join(sized(gone), "k", "left_anti")
    once = kept.join(sized(twice), "k", "left_anti")
    again = kept.join(sized(twice), "k", "left_semi").dropDuplicates(["k"])
    return once.unionByName(again).drop("k").toDF(*documents.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))

"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions alone.

Fixed masks read some tokens of a window and ignore the rest. Hashes of what they read, at every
position of benchmark items and of documents, are joined, and each hit is verified along its
diagonal, where substituted tokens cost and others must be equal. The masks are lossless for the
rules that are verified (``tests/llm`` tries all substitutions):

* items of 13 tokens or more: of a window of 13 tokens with two substitutions, wherever they are, at
  least one of two masks of weight six at one position reads none;
* items of 8 to 12 tokens, which must be there as a whole with one substitution at most: a mask of
  half the item, at its first and at its last tokens, which ignores the other half;
* items of 5 to 7 tokens, which must be there as a whole: a mask of the item's length.

Masks for short items are used only where the benchmark has items of that length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Token offsets that a mask reads.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 7, 8))
#: An overlap: so many aligned tokens with no more than so many substitutions.
WINDOW = 13
SUBSTITUTIONS = 2
#: Shorter items are there as a whole: with one substitution at most, from so many tokens on.
MIN_SUBSTITUTED = 8
#: Items with fewer tokens than this are no evidence and never match: they are phrases that any text may have.
MIN_ITEM = 5
#: Seeds, and items' tokens, that are broadcast at most (about 100 bytes each); those of a larger benchmark are joined by a shuffle.
BROADCAST_SEEDS = 100_000
#: Scripts that set no spaces between words: each of their letters is a token.
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]"
#: All such letters are in these ranges, which are looked for first: scripts are dear to tell, and most texts have none.
_MAYBE_UNSPACED = r"[\u0e00-\u0e7f\u2e80-\x{10ffff}]"


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case; letters of scripts without spaces one by one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    apart = F.when(F.rlike(text, F.lit(_MAYBE_UNSPACED)), F.regexp_replace(low, f"({_UNSPACED})", " $1 ")).otherwise(low)
    return F.filter(F.split(apart, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def allowed(size: Column) -> Column:
    """Substitutions that an item of so many tokens tolerates."""
    return F.when(size >= WINDOW, SUBSTITUTIONS).when(size >= MIN_SUBSTITUTED, 1).otherwise(0)


def short_mask(size: int) -> int:
    """The length of the mask, a run of tokens, for items of so many tokens, fewer than WINDOW."""
    return size // 2 if size >= MIN_SUBSTITUTED else size


def _number(mask: tuple[int, ...]) -> Column:
    """What tells the hashes of one mask from those of another."""
    return F.lit(sum(1 << k for k in mask))


def _seeds(h: Column, masks: tuple[tuple[int, ...], ...]) -> Column:
    """For each mask, what it reads at each position where it fits."""

    def at(mask: tuple[int, ...]) -> Column:
        fits = F.size(h) - mask[-1]
        read = F.transform(F.sequence(F.lit(0), fits - 1), lambda i: F.xxhash64(_number(mask), *[h[i + k] for k in mask]))
        return F.when(fits > 0, read).otherwise(F.array().cast("array<bigint>"))

    return F.array(*[at(m) for m in masks])


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """``item_id`` and ``b``, the hashes of its tokens, of all different items that are evidence."""
    items = benchmark.where("item_id is not null").select("item_id", tokens(F.col("text")).alias("w")).where(F.size("w") >= MIN_ITEM).distinct()
    return items.select("item_id", _hashes(F.col("w")).alias("b"))


def benchmark_seeds(items: DataFrame, short: list[int]) -> DataFrame:
    """``seed``, ``mask``, ``q`` (its place in the item), ``before`` (the seed one place earlier), ``item_id``."""
    masks = _masks(short)
    long = items.where(F.size("b") >= WINDOW).select("item_id", _seeds(F.col("b"), MASKS).alias("s"))
    each = long.select("item_id", F.posexplode("s").alias("mask", "s"))
    out = each.select("item_id", "mask", F.col("s"), F.posexplode("s").alias("q", "seed")).select("item_id", "mask", "q", "seed", F.when(F.col("q") > 0, F.get("s", F.col("q") - 1)).alias("before"))
    for k in range(len(MASKS), len(masks)):
        width = len(masks[k])
        sizes = [m for m in range(MIN_ITEM, WINDOW) if short_mask(m) == width]
        some = items.where(F.size("b").isin(sizes)).select("item_id", F.explode(F.array_distinct(F.array(F.lit(0), F.when(F.size("b") >= MIN_SUBSTITUTED, F.size("b") - width).otherwise(0)))).alias("q"), "b")
        seed = F.xxhash64(_number(masks[k]), *[F.get("b", F.col("q") + i) for i in range(width)])
        out = out.unionByName(some.select("item_id", F.lit(k).alias("mask"), "q", seed.alias("seed"), F.lit(None).cast("bigint").alias("before")))
    return out


def _masks(short: list[int]) -> tuple[tuple[int, ...], ...]:
    return MASKS + tuple(tuple(range(w)) for w in short)


def overlaps(documents: DataFrame, benchmark: DataFrame, *keep: str) -> DataFrame:
    """The best overlap of every document with every benchmark item that it overlaps.

    Returns ``keep`` columns of ``documents``, ``item_id``, ``overlap`` (tokens of the longest
    stretch with at most SUBSTITUTIONS substitutions, at least WINDOW; or of the whole item, if
    shorter, with as many as ``allowed``), ``matches`` in it, and where it starts in the document's
    tokens, ``doc_start``, and the item's, ``item_start``; of equals the first. Null or empty texts,
    documents of fewer than MIN_ITEM tokens and items without an id overlap with nothing. Repeated
    items count once, repeated rows of ``documents`` that agree in ``keep`` once. A very long text is
    one row's work, in proportion to its length. Either table empty: no rows.
    """
    items = benchmark_items(benchmark)
    about = items.agg(F.sum(F.size("b")).alias("n"), F.collect_set(F.when(F.size("b") < WINDOW, F.size("b"))).alias("short")).first()
    short = sorted({short_mask(m) for m in about["short"]})
    masks = _masks(short)
    seeds = benchmark_seeds(items, short)
    own = [f"__{i}" for i in range(len(keep))]
    docs = documents.select(*[F.col(c).alias(o) for c, o in zip(keep, own, strict=True)], _hashes(tokens(F.col("text"))).alias("h"))
    if (about["n"] or 0) * len(MASKS) <= BROADCAST_SEEDS:
        found = _verified(_hits(docs.select(*own, "h", _seeds(F.col("h"), masks).alias("s")), F.broadcast(seeds), len(masks), [*own, "h"]), F.broadcast(items), own)
    else:
        # Only a key of the tokens travels with a document's seeds; the tokens are met again at a hit.
        keyed = docs.withColumn("__key", F.xxhash64("h"))
        hits = _hits(keyed.select("__key", _seeds(F.col("h"), masks).alias("s")), seeds, len(masks), ["__key"]).distinct()
        found = _verified(hits.join(keyed, "__key"), items, own)
    best = found.groupBy(*own, "item_id").agg(F.max("rank").alias("rank"))
    return best.select(*[F.col(o).alias(c) for c, o in zip(keep, own, strict=True)], "item_id", F.col("rank.overlap").alias("overlap"), F.col("rank.matches").alias("matches"), (-F.col("rank.p")).alias("doc_start"), (-F.col("rank.q")).alias("item_start"))


def _hits(docs: DataFrame, seeds: DataFrame, masks: int, carry: list[str]) -> DataFrame:
    """``carry``, ``item_id``, ``p`` and ``q`` of each seed that documents and items share and that begins a run of them."""
    ends = [F.lit(0)]
    for m in range(masks - 1):
        ends.append(ends[-1] + F.size(F.col("s")[m]))
    each = docs.select(*carry, "s", F.posexplode(F.flatten("s")).alias("k", "seed"))
    mask = sum(((F.col("k") >= e).cast("int") for e in ends[1:]), F.lit(0))
    first = F.get(F.array(*ends), F.col("m"))
    each = each.join(seeds, "seed").withColumn("m", mask).withColumn("p", F.col("k") - first).where(F.col("mask") == F.col("m"))
    # The hit one place earlier on this diagonal, if there is one, is verified in its stead.
    earlier = F.when(F.col("p") > 0, F.get(F.get("s", F.col("mask")), F.col("p") - 1))
    return each.where(F.coalesce(earlier != F.col("before"), F.lit(True))).select(*carry, "item_id", "p", "q")


def _verified(hits: DataFrame, items: DataFrame, own: list[str]) -> DataFrame:
    """Verified overlaps of hits, which have ``h``: a rank (overlap, matches, -doc_start, -item_start) for each that holds."""
    each = hits.join(items, "item_id")
    back = F.least("p", "q")
    each = each.withColumns({"p": F.col("p") - back, "q": F.col("q") - back})
    n = F.least(F.size("h") - F.col("p"), F.size("b") - F.col("q"))
    each = each.withColumn("n", n)
    each = each.withColumn("off", F.concat(F.array(F.lit(-1)), F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("h", F.col("p") + i) != F.get("b", F.col("q") + i)), F.array(F.col("n"))))
    each = each.withColumn("allowed", F.least(allowed(F.size("b")), F.size("off") - 2))
    starts = F.sequence(F.lit(0), F.size("off") - F.col("allowed") - 2)
    stretch = F.transform(
        starts,
        lambda i: F.struct(
            (F.get("off", i + F.col("allowed") + 1) - F.get("off", i) - 1).alias("overlap"),
            (F.get("off", i + F.col("allowed") + 1) - F.get("off", i) - 1 - F.col("allowed")).alias("matches"),
            (-(F.col("p") + F.get("off", i) + 1)).alias("p"),
            (-(F.col("q") + F.get("off", i) + 1)).alias("q"),
        ),
    )
    # Exploded, not filtered: a filter would be pushed into the join and work all of this out twice.
    enough = F.filter(F.array(F.array_max(stretch)), lambda r: r["overlap"] >= F.least(F.lit(WINDOW), F.size("b")))
    return each.select(*own, "item_id", F.explode(enough).alias("rank"))


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that overlap with no item of ``benchmark``; all columns as they are.

    Rows are told apart by id and text, so a null or repeated id takes no other row along.
    """
    # The rows' own columns travel under other names, so that none of theirs can clash.
    own = [f"c{i}" for i in range(len(documents.columns))]
    rows = documents.toDF(*own)
    doc_id, text = (F.col(own[documents.columns.index(c)]) for c in ("doc_id", "text"))
    gone = overlaps(rows.select(doc_id.alias("id"), F.xxhash64(text).alias("print"), text.alias("text")), benchmark, "id", "print").select("id", "print").distinct()
    return rows.join(gone, doc_id.eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("print")), "left_anti").toDF(*documents.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id")

"""Line dedup over all documents by a deletion neighbourhood, in DataFrame functions alone.

Lines are sequences of words, or of letters where their script sets no spaces; two are alike if one
edit (a word put in, taken out or replaced) makes them equal. Of equal lines the earliest stays. Each line left emits hashed variants within
the edit bound: itself, itself without each word, and the same with the place of the word. Lines
meet where variants are equal: without-a-word and whole (one word more or less), or two
without-a-word at the same place (one word replaced). Each variant names its earliest line, which
costs a row a variant, not a row a pair. Edit distances to it are then verified on the words.

Only lines that could have a partner emit variants: one edit falls into one half of a line and leaves
the other half as it is, so lines are first counted by their halves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import Durable, sized, table

#: Lines of fewer words are not looked at; they stay. Blank lines always do.
MIN_WORDS = 1
#: Lines of fewer words have equals only, no lines alike: an edit may touch a fifth of a line, no more.
MIN_ALIKE = 5
#: Edits between lines that are alike: none or one. Two would take a variant for each two words of a line.
EDITS = 1
#: A line that is one word of so many letters at least, of a script without spaces, is a sequence of letters.
MIN_LETTERS = 10
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]"
#: Zones that an edit can fall into, of equal numbers of words.
ZONES = 2
_SPACE = r" \t\r\x0B\f"


def words(lines_: Column) -> Column:
    """The words of each line; its letters if it is one long word without spaces; one empty word if it has none."""
    cut = F.transform(lines_, lambda x: F.split(F.trim(x, F.lit(" \t\r\x0b\f")), f"[{_SPACE}]+"))
    letters = lambda w: (F.size(w) == 1) & (F.char_length(w[0]) >= MIN_LETTERS) & F.rlike(w[0], F.lit(_UNSPACED))
    return F.transform(cut, lambda w: F.when(letters(w), F.split(w[0], "")).otherwise(w))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _zoned(i: int, length: Column, w: Column) -> Column:
    """For lines of ``length`` words or one fewer: what stands before and after zone ``i`` of ZONES."""
    before, after = _around(i, length)
    return F.xxhash64(F.lit(i), length, F.slice(w, F.lit(1), before), F.slice(w, F.size(w) - after + 1, after))


def _around(i: int, length: Column) -> tuple[Column, Column]:
    """How many words stand before and after a zone."""
    c = F.floor(length / ZONES).cast("int")
    return c * i, c * (ZONES - 1 - i)


def edited_once(a: Column, b: Column) -> Column:
    """Whether one edit at most parts two sequences: what they begin and end with alike leaves no more."""

    def alike(x: Column, y: Column) -> Column:
        least = F.least(F.size(x), F.size(y))
        differs = F.array_position(F.zip_with(F.slice(x, 1, least), F.slice(y, 1, least), lambda p, q: p != q), True)
        return F.when(differs > 0, differs - 1).otherwise(least)

    return alike(a, b) + alike(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1


def _running_xor(x: Column, block: int = 128) -> Column:
    """The exclusive or of the first elements up to each; within blocks, then over them."""

    def run(part: Column) -> Column:
        none = F.array().cast("array<bigint>")
        return F.aggregate(part, none, lambda acc, y: F.concat(acc, F.array(y.bitwiseXOR(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("long"))))))

    last = F.floor((F.size(x) - 1) / block).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: run(F.slice(x, b * block + 1, F.lit(block))))

    def joined(parts: Column) -> Column:
        ends = run(F.transform(parts, lambda p: F.element_at(p, -1)))
        return F.flatten(F.zip_with(parts, F.concat(F.array(F.lit(0).cast("long")), F.slice(ends, F.lit(1), F.size(ends) - 1)), lambda p, before: F.transform(p, lambda y: y.bitwiseXOR(before))))

    # An array of one element, so that the blocks are worked out once.
    return F.transform(F.array(blocks), joined)[0]


#: Where a line stands: rows without an id last, then by id, text and place. A long in each field.
ORDER = ("o_none", "o_id", "o_print", "o_line")


def kept_lines(documents: DataFrame, durable: Durable, min_words: int = MIN_WORDS, min_alike: int = MIN_ALIKE, edits: int = EDITS) -> DataFrame:
    """ORDER of each line that stays, one row for each different line of at least ``min_words`` words."""
    each = documents.select(F.col("doc_id").isNull().cast("long").alias("o_none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("o_id"), F.xxhash64("text").alias("o_print"), F.posexplode(words(lines(F.col("text")))).alias("o_line", "w"))
    each = each.withColumn("o_line", F.col("o_line").cast("long")).where((F.size("w") >= min_words) & (F.col("w")[0] != ""))
    n = F.size("w")
    zoned = [F.when(n >= min_alike, _zoned(i, n + more, F.col("w"))) for more in (0, 1) for i in range(ZONES)]
    keys = [f"k{i}" for i in range(len(zoned))]
    # One row for equal lines. All but their place follows from the words, so any of it will do.
    keyed = each.select(F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(1), "w").alias("h2"), F.struct(*ORDER).alias("o"), *[z.alias(k) for z, k in zip(zoned, keys, strict=True)])
    classes = durable.keep(keyed.groupBy("h1", "h2").agg(F.min("o").alias("o"), *[F.min(k).alias(k) for k in keys if edits]), "classes")
    if not edits:
        return classes.select("o.*")
    # Half of a line's hash names it here: an equal half but asks for a line too many.
    parts = classes.where("k0 is not null").select("h1", F.posexplode(F.array(*keys)).alias("j", "k"))
    shared = durable.keep(parts.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k"), "shared")
    asked = durable.keep(parts.join(sized(shared), "k", "left_semi").groupBy("h1").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("j"))).alias("zones")), "asked")
    few = asked.count() <= common.BROADCAST_ROWS
    wanted = classes.join(F.broadcast(asked) if few else asked, "h1").select("h1", "h2", "o", "zones")
    by_doc = wanted.groupBy("o.o_none", "o.o_id", "o.o_print").agg(F.collect_list(F.struct("h1", "h2", "o", "zones")).alias("x"))
    texts = documents.select(F.col("doc_id").isNull().cast("long").alias("o_none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("o_id"), F.xxhash64("text").alias("o_print"), "text")
    found = texts.join(F.broadcast(by_doc) if few else by_doc, list(ORDER[:3])).select(lines(F.col("text")).alias("ls"), F.explode("x").alias("x")).select("x.*", words(F.array(F.get("ls", F.col("x.o.o_line").cast("int"))))[0].alias("w"))
    # Repeated rows of a document bring a line more than once. The number follows the order of lines.
    found = found.dropDuplicates(["h1", "h2"]).repartitionByRange("o").sortWithinPartitions("o")
    found = durable.keep(found.select("h1", "h2", F.monotonically_increasing_id().alias("r"), "zones", "w"), "lines")
    gone = durable.keep(found.join(_alike(found.select("r", "zones", "w"), durable), "r", "left_semi").select("h1", "h2"), "gone")
    return classes.join(sized(gone), ["h1", "h2"], "left_anti").select("o.*")


def _alike(found: DataFrame, durable: Durable) -> DataFrame:
    """The numbers ``r`` of the lines ``w`` that one of a smaller number is alike to.

    A line's hash is the exclusive or of its words' hashes, each with its place, so that variants
    cost a step each, however long the line: those without a word follow from running values over
    the words before it and, a place earlier, the words after it. Only words in a zone that the line
    may share all around it (a bit of ``zones``) are left out or taken for replaced.
    """
    whole, less, gap = 0, 1, 2
    n = F.size("w")
    hashed = found.select("r", "zones", F.transform("w", lambda x, i: F.xxhash64(i, x)).alias("here"), F.transform("w", lambda x, i: F.xxhash64(i - 1, x)).alias("earlier"), n.alias("n"))
    running = hashed.select("r", "zones", "n", "here", _running_xor(F.col("here")).alias("upto"), _running_xor(F.col("earlier")).alias("upto_earlier"))
    total, total_earlier = F.element_at("upto", -1), F.element_at("upto_earlier", -1)

    def variant(kind: int, *parts: Column) -> Column:
        return F.struct(F.xxhash64(*parts).alias("v"), F.lit(kind).cast("byte").alias("kind"))

    def without(i: Column) -> Column:
        before = F.when(i > 0, F.get("upto", i - 1)).otherwise(F.lit(0).cast("long"))
        return variant(less, F.col("n") - 1, before.bitwiseXOR(total_earlier).bitwiseXOR(F.get("upto_earlier", i)))

    def in_zone(i: Column) -> Column:
        out = F.lit(False)
        for j in range(2 * ZONES):
            before, after = _around(j % ZONES, F.col("n") + j // ZONES)
            out = out | ((F.col("zones").bitwiseAND(1 << j) != 0) & (i >= before) & (i < F.col("n") - after))
        return out

    running = running.withColumn("places", F.filter(F.sequence(F.lit(0), F.col("n") - 1), in_zone))
    each = F.concat(
        F.array(variant(whole, F.col("n"), total)),
        F.transform("places", without),
        F.transform("places", lambda i: variant(gap, F.col("n"), total.bitwiseXOR(F.get("here", i)), i)),
    )
    variants = durable.keep(running.select("r", F.explode(each).alias("x")).select("r", "x.*"), "variants")
    first = [F.min(F.when(F.col("kind") == k, F.col("r"))).alias(f"first{k}") for k in (whole, less, gap)]
    firsts = durable.keep(variants.groupBy("v").agg(*first, F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "firsts")
    partner = F.when(F.col("kind") == whole, F.col(f"first{less}")).when(F.col("kind") == less, F.col(f"first{whole}")).otherwise(F.col(f"first{gap}"))
    met = durable.keep(variants.join(sized(firsts), "v").select("r", partner.alias("by")).where("by < r").distinct(), "met")
    durable.drop("variants", "firsts")
    met = met.join(found, "r").join(found.select(F.col("r").alias("by"), F.col("w").alias("wb")), "by")
    return met.where(edited_once(F.col("w"), F.col("wb"))).select("r").distinct()


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS, min_alike: int = MIN_ALIKE, edits: int = EDITS, counts: bool = False) -> DataFrame:
    """``documents`` without the lines that an earlier line of any document equals or is alike to.

    Lines end at line feeds; words are runs without white space, or single letters (``words``).
    Lines stand in the order of doc_id (nulls last), text and place. Of equal lines (the same words)
    the first stays; a line of ``min_alike`` or more words also goes if an earlier different line,
    itself kept or not, becomes equal to it by one word put in, taken out or replaced (``edits`` 0:
    equal lines only). Blank lines, and those of fewer than ``min_words`` words, stay. Every row
    stays, some with fewer lines or an empty text; null texts stay null, a text that loses nothing
    stays as it is. Rows with the same id and text keep the same lines. An ``n_chars`` column is set
    to the new length; others are as they were, whatever their names. A very long line has as many
    variants as words, whose hashes follow from running values. With ``counts``, columns ``n_lines``
    and ``n_kept`` are set too.
    """
    if edits not in (0, 1):
        raise ValueError("a bound of no edit or one")
    durable = Durable(documents.sparkSession)
    # The rows' own columns travel under other names, so that none of theirs can clash.
    own = [f"c{i}" for i in range(len(documents.columns))]
    doc_id, text = (F.col(own[documents.columns.index(c)]) for c in ("doc_id", "text"))
    docs = documents.toDF(*own)
    stay = kept_lines(docs.select(doc_id.alias("doc_id"), text.alias("text")), durable, min_words, min_alike, edits)
    stay = durable.keep(stay.groupBy(*ORDER[:3]).agg(F.collect_list(F.col("o_line").cast("int")).alias("stay")), "stay")
    docs = docs.withColumns({"o_none": doc_id.isNull().cast("long"), "o_id": F.coalesce(doc_id.cast("long"), F.lit(0)), "o_print": F.xxhash64(text)})
    docs = docs.join(stay, list(ORDER[:3]), "left").withColumn("lines", lines(text))
    enough = rf"(?:[^{_SPACE}]+[{_SPACE}]+){{{min_words - 1}}}[^{_SPACE}]"
    short = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: ~F.rlike(F.get("lines", i), F.lit(enough)))
    docs = docs.withColumn("at", F.array_sort(F.concat(F.coalesce("stay", F.array().cast("array<int>")), short)))
    whole = F.size("at") == F.size("lines")
    left = F.when(text.isNull() | whole, text).otherwise(F.array_join(F.transform("at", lambda i: F.get("lines", i)), "\n"))
    docs = docs.withColumn("left", left)
    out = [F.col("left" if name == "text" else c).alias(name) for name, c in zip(documents.columns, own, strict=True)]
    if "n_chars" in documents.columns:
        out[documents.columns.index("n_chars")] = F.char_length("left").cast(documents.schema["n_chars"].dataType).alias("n_chars")
    if counts:
        out = [c for c, name in zip(out, documents.columns, strict=True) if name not in ("n_lines", "n_kept")]
        out += [F.size("lines").cast("long").alias("n_lines"), F.size("at").cast("long").alias("n_kept")]
    return docs.select(*out)


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)

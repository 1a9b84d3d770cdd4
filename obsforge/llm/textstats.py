"""Statistics of whole texts that rules, forests and classifiers judge by."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_share, map_batches, utf8

WINDOW_WORDS = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "upper_share", "symbols_per_word", "exclaims_per_word", "pipes_per_word", "digit_share", "distinct_words", "adjacent_repeats", "dup_line_share", "repeat_share", "stops_per_word", "letter_share")
SCHEMA = "".join(f", {c} long" for c in COUNTS) + "".join(f", {c} double" for c in FEATURES)

_SYMBOLS = list(b"#*$%&|<>")
_SPACES = list(b"\x20\x09\x0a\x0b\x0c\x0d")
_STOPS = list(b".,;:?")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def repeated_words(words: list[bytes], window: int = WINDOW_WORDS, hashes: np.ndarray | None = None) -> int:
    """Words that lie in a window of so many words which the text has twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64) if hashes is None else hashes
    mixed = sum(h[i : i + n] * _MIX[i % len(_MIX)] for i in range(window))
    order = np.sort(mixed)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    seen: dict[tuple[bytes, ...], int] = {}
    covered = np.zeros(len(words), bool)
    for i in np.flatnonzero(np.isin(mixed, twice)):  # the words decide, not their hash
        key = tuple(words[i : i + window])
        if (first := seen.setdefault(key, i)) != i:
            covered[i : i + window] = True
            covered[first : first + window] = True
    return int(covered.sum())


def statistics(text: bytes) -> tuple[float, ...]:
    """COUNTS and FEATURES of a text in UTF-8; words are runs without space, tab or line end."""
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n = len(words)
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    points = len(text) - int(c[0x80:0xC0].sum())
    chars = points - int(c[_SPACES].sum())
    symbols = int(c[_SYMBOLS].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words, hashes=h)
    upper, lower = int(c[65:91].sum()), int(c[97:123].sum())
    some, w = max(chars, 1), max(n, 1)
    return (
        n, chars, symbols, dup_lines, repeats,
        float(np.log1p(n)), chars / w, upper / max(upper + lower, 1), symbols / w, int(c[33]) / w, int(c[124]) / w, int(c[48:58].sum()) / some,
        len(set(words)) / w, float((h[1:] == h[:-1]).sum()) / w, dup_lines / max(len(lines), 1), repeats / w, int(c[_STOPS].sum()) / w, (upper + lower + int(c[0xC0:].sum())) / some,
    )


def text_statistics(documents: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, COUNTS and FEATURES of every row; a null text counts as an empty one, all zero."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        k = batch.num_columns - 1
        rows = [statistics(x.as_py()) for x in batch.column(k)]
        columns = list(zip(*rows, strict=True))
        out = [pa.array(x, pa.int64()) for x in columns[: len(COUNTS)]] + [pa.array(x, pa.float64()) for x in columns[len(COUNTS) :]]
        return pa.RecordBatch.from_arrays([*batch.columns[:k], *out], [*keep, *COUNTS, *FEATURES])

    kinds = dict(documents.dtypes)
    return map_batches(documents.select(*keep, utf8("text").alias("__text")), each, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + SCHEMA)


def truth(labels: DataFrame, label: str, fold: tuple[int, int] | None = None) -> DataFrame:
    """``doc_id`` and ``y`` of every id with a label.

    Labels are 0 or 1; null ids and labels are left out, several of one id are averaged and tied ones
    left out. ``fold=(m, r)`` leaves out ids whose crc32, as text, is ``r`` modulo ``m``.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    if fold:
        known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold[0] != fold[1])
    return known.groupBy("doc_id").agg(F.avg("y").alias("y")).where("y <> 0.5").withColumn("y", (F.col("y") > 0.5).cast("int"))


def labelled(documents: DataFrame, labels: DataFrame, label: str, most: int, fold: tuple[int, int] | None = None) -> DataFrame:
    """``doc_id``, ``y`` and ``text`` of about ``most`` ids with a label, or of all if there are fewer.

    Labels are those of ``truth``. Of more ids than ``most``, those with a small hash are taken, a
    share of all 2^64 that their number sets, so the sample is bounded, repeatable, as large as asked
    for at any size and small enough to broadcast. Of several rows of an id, the one with the least
    text counts.
    """
    known = truth(labels, label, fold)
    n = known.count()
    if n > most:
        known = known.where(hashed_share(F.xxhash64("doc_id"), most / n))
        if known.isEmpty():
            raise RuntimeError(f"a sample of {most} out of {n} labelled ids came out empty")
    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))

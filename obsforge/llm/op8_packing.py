"""Packing into token windows by Karmarkar-Karp multiway differencing.

Documents become pieces: whole windows are cut off long ones, and what is left goes into blocks
of some tens of windows. Pieces far smaller than a window are tied into bundles first, so that a
block has a bounded number of items however short its documents are. In a block, the differencing
method merges partial partitions with opposing imbalances until one partition into windows is left,
its windows nearly equal; if one is over capacity, the block is partitioned anew into one window more.

The windows that go out are full, though: what the differencing leaves nearly equal and short of
capacity is topped up from the least windows, the only ones whose pieces are cut or moved, and what
is left of those goes on to the next block. A task ends with sequences at powers of two, so nothing
is padded.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, utf8
from .tokens import encoder, vocabulary

WINDOW = 4096
END_ID = 2
#: Windows of a block: bounds what a task holds, and the cost of a merge.
BLOCK_WINDOWS = 64
#: Pieces are tied into bundles of at most this share of a window: at most so many twice over for each window of a block.
BUNDLES = 64
VOCABULARY = "word_bpe_49k.json"

#: doc_id, the document's tokens, where the piece starts in it, and its ids in little-endian 32-bit bytes.
Piece = tuple[int | None, int, int, bytes]


def difference(sizes: list[int], parts: int) -> list[list[int]]:
    """Partition items into ``parts`` groups of nearly equal sums; returns the items of each group.

    Each partial partition is a list of (sum, items) with its least sum taken off. The two of the
    largest spread are merged, largest sums with smallest, until one is left.
    """
    heap = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, [(0, None)] * (parts - 1) + [(size, i)]))
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = [(x[0] + y[0], x[1] if y[1] is None else y[1] if x[1] is None else (x[1], y[1])) for x, y in zip(a, reversed(b), strict=True)]
        merged.sort(key=lambda x: x[0])
        low = merged[0][0]
        if low:
            merged = [(s - low, t) for s, t in merged]
        n += 1
        heapq.heappush(heap, (-merged[-1][0], n, merged))
    return [_leaves(t) for _, t in heap[0][2]] if heap else [[] for _ in range(parts)]


def _leaves(tree) -> list[int]:
    out, stack = [], [tree]
    while stack:
        t = stack.pop()
        if isinstance(t, tuple):
            stack.extend(t)
        elif t is not None:
            out.append(t)
    return out


def partition(sizes: list[int], capacity: int) -> list[list[int]]:
    """Differencing into the fewest windows that it fits into, from the least number that could do."""
    parts = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = difference(sizes, parts)
        if max(sum(sizes[i] for i in g) for g in groups) <= capacity:
            return groups
        parts += 1


def bundles(sizes: list[int], most: int) -> list[list[int]]:
    """Items in their order, tied together as long as a bundle is no larger than ``most``; larger ones stay alone.

    Any two bundles next to each other are larger than ``most`` together, so there are at most
    twice as many, and one, as ``most`` goes into all.
    """
    out: list[list[int]] = []
    total = 0
    for i, size in enumerate(sizes):
        if out and total + size <= most:
            out[-1].append(i)
            total += size
        else:
            out.append([i])
            total = size
    return out


class Packer:
    """Takes documents one by one and gives out full sequences, each a list of pieces."""

    def __init__(self, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> None:
        self.window, self.block = window, window * block_windows
        self.pieces: list[Piece] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[list[Piece]]:
        n, start = len(ids) // 4, 0
        while n - start >= self.window:
            yield [(doc_id, n, start, ids[4 * start : 4 * (start + self.window)])]
            start += self.window
        if start < n:
            self.pieces.append((doc_id, n, start, ids[4 * start :]))
            self.held += n - start
        if self.held >= self.block:
            yield from self.pack()

    def pack(self) -> Iterator[list[Piece]]:
        """The block's full windows; keeps what they leave over."""
        sizes = [len(p[3]) // 4 for p in self.pieces]
        tied = bundles(sizes, max(1, self.window // BUNDLES))
        groups = partition([sum(sizes[i] for i in b) for b in tied], self.window)
        windows = sorted(([self.pieces[i] for b in g for i in tied[b]] for g in groups), key=_length, reverse=True)
        full = self.held // self.window
        rest = [p for w in windows[full:] for p in w]
        for window in windows[:full]:
            room = self.window - _length(window)
            while room:
                doc_id, n, start, ids = rest.pop()
                if len(ids) > 4 * room:
                    rest.append((doc_id, n, start + room, ids[4 * room :]))
                    ids = ids[: 4 * room]
                window.append((doc_id, n, start, ids))
                room -= len(ids) // 4
            yield window
        self.pieces, self.held = rest, self.held - full * self.window

    def end(self) -> Iterator[list[Piece]]:
        if self.held >= self.window:
            yield from self.pack()
        size, rest = self.window, self.pieces[::-1]
        while self.held:
            size //= 2
            if self.held >= size:
                sequence, room = [], size
                while room:
                    doc_id, n, start, ids = rest.pop()
                    if len(ids) > 4 * room:
                        rest.append((doc_id, n, start + room, ids[4 * room :]))
                        ids = ids[: 4 * room]
                    sequence.append((doc_id, n, start, ids))
                    room -= len(ids) // 4
                self.held -= size
                yield sequence
        self.pieces = []


def _length(pieces: Iterable[Piece]) -> int:
    return sum(len(p[3]) for p in pieces) // 4


SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(documents: DataFrame, vocabulary_path: str, window: int = WINDOW, end_id: int = END_ID, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Pieces of token sequences that hold every id of every document once.

    Ids are those of the tokenizer in ``vocabulary_path`` and then ``end_id``; a null or empty text
    has that alone. Each row is a piece: ``doc_id``, ``start`` and ``length`` in its document of
    ``doc_tokens`` ids, ``sequence_id`` and ``offset`` in a sequence of at most ``window`` (a
    power of two) tokens, and ``ids`` in little-endian 32-bit bytes. Sequences are full but for
    the last few of each task, whose lengths are powers of two. Tasks pack what they read and
    shuffle nothing. Null ids and repeated rows are documents of their own; no rows, no pieces.
    """
    if window & (window - 1) or window < 2:
        raise ValueError("window must be a power of two")
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, end = encoder(vocabulary_path).encode, Packer(window, block_windows), np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        def note(sequences: Iterator[list[Piece]]) -> None:
            nonlocal number
            for sequence in sequences:
                offset = 0
                for doc_id, n, start, ids in sequence:
                    rows.append((doc_id, start, len(ids) // 4, n, number, offset, ids))
                    offset += len(ids) // 4
                number += 1

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                note(packer.add(doc_id, encode(text.as_py()) + end))
                if len(rows) >= 1024:
                    yield out()
        note(packer.end())
        if rows:
            yield out()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("t")).mapInArrow(run, SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), vocabulary(VOCABULARY))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

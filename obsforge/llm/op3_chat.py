"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn and then user and assistant in turn, ending with
the assistant. Each source turn is kept, relabelled, merged into the turn before it, or preceded by
an empty turn, at a cost; dynamic programming over the automaton of legal turns finds the cheapest
repair of a conversation, which is then rendered.

Conversations may be of any length. Turns are sorted over the cluster by conversation and turn, so
a long one lies in many pieces. A piece costs a small matrix, from each state before it to each
state after it; matrices of the few conversations that lie in several pieces are joined on the
driver (two a partition at most), which gives each piece its states at both ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ARROW_ROWS, Durable, small_batches, table

ROLES = ("system", "user", "assistant")
#: States of the automaton: nothing yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
MERGE, RELABEL, UNKNOWN, INSERT = 1.0, 2.0, 1.0, 2.5
#: State, action and inserted roles that lead to a role from a state.
_LEGAL = {START: ("system", "user"), SYSTEM: ("user",), USER: ("assistant",), ASSISTANT: ("user",)}


def _moves(role: str | None) -> list[tuple[int, int, float, str, str, str]]:
    """(from, to, cost, action, role given, role inserted before or '') for a source turn; of equal costs the first is taken."""
    known = role in ROLES
    out = []
    for state in range(4):
        for given in ROLES:
            to = 1 + ROLES.index(given)
            relabel = 0.0 if given == role else RELABEL if known else UNKNOWN
            named = "keep" if given == role else "relabel"
            if given in _LEGAL[state]:
                out.append((state, to, relabel, named, given, ""))
            elif state == to:
                out.append((state, to, MERGE + relabel, "merge", given, ""))
            else:
                for between in _LEGAL[state]:
                    if given in _LEGAL[1 + ROLES.index(between)]:
                        out.append((state, to, INSERT + relabel, named, given, between))
    return out


MOVES = {role: _moves(role) for role in (*ROLES, None)}
#: What it costs to end in each state, and the empty turns that are put at the end.
ENDS = ((0.0, ()), (2 * INSERT, ("user", "assistant")), (INSERT, ("assistant",)), (0.0, ()))


def forward(roles: list[str | None], start: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """Least costs in each state after the turns, and for each turn the move that led to each state."""
    cost, back = list(start), []
    for role in roles:
        now, how = [float("inf")] * 4, [-1] * 4
        for k, (a, b, c, *_) in enumerate(MOVES[role if role in ROLES else None]):
            if cost[a] + c < now[b]:
                now[b], how[b] = cost[a] + c, k
        cost = now
        back.append(how)
    return np.array(cost), back


def decode(roles: list[str | None], back: list[list[int]], end: int) -> list[tuple[int, int, float, str, str, str]]:
    out = []
    for role, how in zip(reversed(roles), reversed(back), strict=True):
        move = MOVES[role if role in ROLES else None][how[end]]
        out.append(move)
        end = move[0]
    return out[::-1]


def _from(state: int) -> np.ndarray:
    v = np.full(4, np.inf)
    v[state] = 0
    return v


def repair(roles: list[str | None], entry: int = START, exit_: int | None = None) -> list[tuple[int, int, float, str, str, str]]:
    """The cheapest moves for the turns of a conversation, or of a piece of one between two states."""
    cost, back = forward(roles, _from(entry))
    if exit_ is None:
        exit_ = int(np.argmin(cost + [c for c, _ in ENDS]))
    return decode(roles, back, exit_)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Rows of each piece (``seg``, ``conv_id``), gathered over batches that are sorted by it."""
    key, held = None, None
    for batch in batches:
        rows = batch.to_pydict()
        for i, k in enumerate(zip(rows["seg"], rows["conv_id"], strict=True)):
            if held is None or k != key:
                if held is not None:
                    yield key, held
                key, held = k, {name: [] for name in rows}
            for name, values in rows.items():
                held[name].append(values[i])
    if held is not None:
        yield key, held


SCHEMA = "conv_id long, seq long, turn long, role string, source_role string, action string, copies long, rendered string"


def format_chats(conversations: DataFrame) -> DataFrame:
    """Each conversation repaired at the least cost and rendered, a row a piece of text.

    ``rendered``, joined in the order of ``seq`` within a ``conv_id``, is the conversation as
    ``<|im_start|>role`` ... ``<|im_end|>`` turns. ``role`` is the role given, ``action`` what was
    done: ``keep``, ``relabel``, ``merge`` (joined to the turn before by a line feed) or ``insert``
    (an empty turn; ``turn`` and ``source_role`` are null). The cost is the least possible; of equal
    repairs the first in a fixed order is taken.

    Turns stand by ``turn`` (nulls first), then role and text. Repeated rows, all four columns the
    same, are one turn with their number in ``copies``. Roles other than system, user and assistant
    and null ones are relabelled; null texts are empty; rows without an id are one conversation. Other
    columns are not looked at; no rows, no result.
    """
    spark = conversations.sparkSession
    small_batches(spark, 4 * ARROW_ROWS)
    durable = Durable(spark)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").alias("source_role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.groupBy("conv_id", "turn", "source_role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("print", F.xxhash64("text"))
    order = ["conv_id", "turn", "source_role", "print", "text"]
    turns = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    turns = durable.keep(turns.select("conv_id", "turn", "source_role", "text", "copies", F.spark_partition_id().alias("seg"), F.monotonically_increasing_id().alias("pos")), "turns")
    spans = durable.keep(turns.groupBy("conv_id").agg(F.min("seg").alias("first"), F.max("seg").alias("last")).where("first < last"), "spans")

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (seg, conv_id), rows in _pieces(batches):
            costs = [forward(rows["source_role"], _from(s))[0].tolist() for s in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([conv_id], pa.int64()), pa.array([costs], pa.list_(pa.list_(pa.float64())))], ["seg", "conv_id", "costs"])

    # At most two conversations of a partition lie in others too.
    split = turns.select("seg", "conv_id", "pos", "source_role").join(spans.select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    split = split.repartition("seg", "conv_id").sortWithinPartitions("seg", "conv_id", "pos")
    found: dict[int | None, list[tuple[int, np.ndarray]]] = {}
    for r in split.mapInArrow(matrix, "seg int, conv_id long, costs array<array<double>>").collect():
        found.setdefault(r.conv_id, []).append((r.seg, np.array(r.costs)))
    ends: dict[tuple[int, int | None], tuple[int, int, bool]] = {}
    for conv_id, parts in found.items():
        parts.sort(key=lambda p: p[0])
        costs = [_from(START)]
        for _, m in parts:
            costs.append((costs[-1][:, None] + m).min(0))
        state = int(np.argmin(costs[-1] + [c for c, _ in ENDS]))
        for k in reversed(range(len(parts))):
            before = int(np.argmin(costs[k] + parts[k][1][:, state]))
            ends[parts[k][0], conv_id] = (before, state, k == len(parts) - 1)
            state = before

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "seq", "turn", "role", "source_role", "action", "copies", "rendered"])

        for (seg, conv_id), rows in _pieces(batches):
            entry, exit_, last = ends.get((seg, conv_id), (START, None, True))
            n = len(rows["pos"])
            moves = repair(rows["source_role"], entry, exit_)
            for i, (state, to, _, action, role, inserted) in enumerate(moves):
                # A turn is closed by the next one, and the last one at the conversation's end.
                close = "" if state == START else "<|im_end|>\n"
                seq = 4 * rows["pos"][i]
                if inserted:
                    out.append((conv_id, seq, None, inserted, None, "insert", 0, f"{close}<|im_start|>{inserted}\n"))
                    close = "<|im_end|>\n"
                text = "\n" + rows["text"][i] if action == "merge" else f"{close}<|im_start|>{role}\n{rows['text'][i]}"
                more = ENDS[to][1] if last and i == n - 1 else ()
                done = "<|im_end|>\n" if last and i == n - 1 and not more else ""
                out.append((conv_id, seq + 1, rows["turn"][i], role, rows["source_role"][i], action, rows["copies"][i], text + done))
                for k, extra in enumerate(more):
                    out.append((conv_id, seq + 2 + k, None, extra, None, "insert", 0, f"<|im_end|>\n<|im_start|>{extra}\n" + "<|im_end|>\n" * (k == len(more) - 1)))
                if len(out) >= 1024:
                    yield batch()
        if out:
            yield batch()

    return turns.repartition("seg", "conv_id").sortWithinPartitions("seg", "conv_id", "pos").mapInArrow(render, SCHEMA)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))

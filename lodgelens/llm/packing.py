"""Best-fit packing of tokenized documents by linear grouping.

Lengths above ``large`` of a sequence are put in descending order, cut into groups of equal
cardinality and rounded up to the largest of their group. A linear program over the few rounded
sizes picks how often each way to fill a sequence is used (columns are found with a knapsack).
Actual documents then take the slots, and what is left over in each sequence, rounding
included, goes to the shorter documents by best fit. Lengths that leave no room for another long
one open a sequence each beforehand.

The plan needs only the number of pieces of each length, at most ``capacity`` numbers whatever
the input, and is a list of intervals "the pieces of length L with rank r..r' go to sequences
s..s' at offset o". Spark counts the lengths, ranks the pieces of each length (a count per
task, so a length that a third of all pieces share is no hot key) and looks the intervals up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgelens.llm.subwords import default_tokenizer, encoder
from lodgelens.llm.words import slices
from lodgelens.session import materialise

CAPACITY = 4096
END_ID = 1
GROUPS = 14
LARGE = 1 / 8

_PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("_task", T.IntegerType()),
        T.StructField("_nth", T.LongType()),
    ]
)


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Ids of each document plus an end id, cut into pieces of ``capacity``.

    Columns: doc_id, piece, start, length, ids_crc32, and with ``_task`` and ``_nth`` the number
    of the piece among those of its length in its task. A null text has only the end id.
    """
    path = tokenizer or default_tokenizer()
    kinds = {f.name: f.dataType for f in docs.schema.fields}

    def cut(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for part in slices(batches):
            ids, per_doc = encoder(path).encode(part["text"])
            length = per_doc + 1
            pieces = -(-length // capacity)
            doc = np.repeat(np.arange(len(length)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(length[doc] - piece * capacity, capacity)
            stream = np.insert(ids, np.cumsum(per_doc), END_ID).astype("<u4")
            ends = np.cumsum(size)
            crc = [zlib.crc32(stream[e - s : e]) for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
            order = np.argsort(size, kind="stable")
            ranked = size[order]
            first = np.searchsorted(ranked, ranked)
            nth = np.empty(len(size), np.int64)
            nth[order] = seen[ranked] + np.arange(len(size)) - first
            seen += np.bincount(size, minlength=capacity + 1)
            yield pa.record_batch(
                [
                    part["doc_id"].take(pa.array(doc)).cast(pa.int64()),
                    pa.array(piece, pa.int32()),
                    pa.array(piece * capacity, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array(np.full(len(doc), task), pa.int32()),
                    pa.array(nth, pa.int64()),
                ],
                names=_PIECES.names,
            )

    assert isinstance(kinds["doc_id"], (T.LongType, T.IntegerType)), "doc_id is an integer"
    return docs.select("doc_id", "text").mapInArrow(cut, _PIECES)


def _best_filling(sizes: list[int], worth: np.ndarray, capacity: int) -> list[int]:
    """Counts per size that fit one sequence and are worth most (unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    least = min(sizes)
    for room in range(least, capacity + 1):
        best[room], last[room] = best[room - 1], -2
        for i, size in enumerate(sizes):
            if size <= room and best[room - size] + worth[i] > best[room] + 1e-12:
                best[room], last[room] = best[room - size] + worth[i], i
    counts, room = [0] * len(sizes), capacity
    while room >= least and last[room] != -1:
        if last[room] == -2:
            room -= 1
        else:
            counts[last[room]] += 1
            room -= sizes[last[room]]
    return counts


def optimal_fillings(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """Ways to fill a sequence and how often to use each: the linear program's optimum."""
    k = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, float)
    for _ in range(60 * k):
        duals = np.linalg.solve(basis.T, np.ones(k))
        new = np.array(_best_filling(sizes, duals, capacity), float)
        if duals @ new <= 1 + 1e-7:
            break
        level, step = np.linalg.solve(basis, need), np.linalg.solve(basis, new)
        ratio = np.full(k, np.inf)
        np.divide(level, step, out=ratio, where=step > 1e-9)
        leave = int(np.argmin(ratio))
        basis[:, leave] = new
    level = np.linalg.solve(basis, need)
    return [([int(c) for c in basis[:, j]], max(0.0, float(level[j]))) for j in range(k)]


class _Plan:
    """Runs of equal sequences: (room, first sequence, how many, used), and the intervals."""

    def __init__(self, counts: np.ndarray):
        self.next_sequence = 0
        self.open: list[tuple[int, int, int]] = []
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.taken = np.zeros(len(counts), np.int64)

    def place(self, length: int, sequences: int, each: int, first: int, offset: int, total: int) -> None:
        """``total`` pieces of ``length``: ``each`` per sequence from ``first`` on, at ``offset``."""
        rank = int(self.taken[length])
        self.rows.append((length, rank, rank + total, each, first, offset))
        self.taken[length] += total


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> np.ndarray:
    """Intervals (length, rank from, rank to, pieces per sequence, first sequence, offset).

    ``counts[n]`` is the number of pieces of length n. A piece with rank r of an interval goes to
    sequence ``first + (r - from) // per``, at ``offset + (r - from) % per * length``.
    """
    plan = _Plan(counts)
    limit = int(capacity * large)
    alone = max(limit, capacity - limit - 1)
    for n in range(capacity, alone, -1):  # no other long piece fits beside these
        if counts[n]:
            many = int(counts[n])
            plan.place(n, many, 1, plan.next_sequence, 0, many)
            if n < capacity:
                insort(plan.open, (capacity - n, plan.next_sequence, many))
            plan.next_sequence += many
    long_lengths = [n for n in range(alone, limit, -1) if counts[n]]
    total_long = int(sum(counts[n] for n in long_lengths))
    if total_long:
        k = min(groups, total_long)
        edges = [total_long * i // k for i in range(k + 1)]
        # The pieces in descending order, as (length, how many) per group.
        members: list[list[list[int]]] = [[] for _ in range(k)]
        at, group = 0, 0
        for n in long_lengths:
            left = int(counts[n])
            while left:
                while at >= edges[group + 1]:
                    group += 1
                take = min(left, edges[group + 1] - at)
                members[group].append([n, take])
                at, left = at + take, left - take
        merged: dict[int, list[list[int]]] = {}
        for part in members:
            merged.setdefault(part[0][0], []).extend(part)
        sizes = list(merged)
        pools = list(merged.values())
        left = [sum(m for _, m in pool) for pool in pools]
        for filling, level in optimal_fillings(sizes, left, capacity):
            times = int(level + 1e-6)
            for i, c in enumerate(filling):
                if c:
                    times = min(times, left[i] // c)
            if times and any(filling):
                _fill(plan, filling, times, pools, left, capacity)
        # What the rounding of the program leaves: few pieces per group, longest first.
        for i in range(len(sizes)):
            for n, m in pools[i]:
                _best_fit(plan, n, m, capacity)
    for n in range(limit, 0, -1):
        if counts[n]:
            _best_fit(plan, n, int(counts[n]), capacity)
    return np.array(plan.rows, np.int64).reshape(-1, 6)


def _fill(plan: _Plan, filling: list[int], times: int, pools: list, left: list[int], capacity: int) -> None:
    """``times`` sequences, each with ``filling[i]`` pieces of group i."""
    slots = []
    for i, c in enumerate(filling):
        for _ in range(c):
            run, need = [], times
            while need:
                n, m = pools[i][0]
                take = min(m, need)
                run.append((n, take))
                need -= take
                if take == m:
                    pools[i].pop(0)
                else:
                    pools[i][0] = [n, m - take]
            left[i] -= times
            slots.append(run)
    cuts = sorted({0, times} | {int(x) for run in slots for x in np.cumsum([m for _, m in run])})
    where, first = [[0, run[0][1]] for run in slots], plan.next_sequence
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        offset = 0
        for slot, run in zip(where, slots, strict=True):
            while slot[1] <= begin:
                slot[0] += 1
                slot[1] += run[slot[0]][1]
            n = run[slot[0]][0]
            plan.place(n, end - begin, 1, first + begin, offset, end - begin)
            offset += n
        if capacity - offset:
            insort(plan.open, (capacity - offset, first + begin, end - begin))
    plan.next_sequence += times


def _best_fit(plan: _Plan, length: int, count: int, capacity: int) -> None:
    """``count`` pieces of one length, each to the fullest sequence that takes it."""
    at = bisect_left(plan.open, (length, -1, -1))
    back = []
    while count and at < len(plan.open):
        room, first, many = plan.open.pop(at)
        each = room // length
        full = min(many, count // each)
        offset = capacity - room
        if full:
            plan.place(length, full, each, first, offset, full * each)
            count -= full * each
            if room - each * length:
                back.append((room - each * length, first, full))
        if full < many:
            some = min(count, each)
            if some:  # fewer than a sequence takes: the last pieces of this length
                plan.place(length, 1, some, first + full, offset, some)
                count -= some
                if room - some * length:
                    back.append((room - some * length, first + full, 1))
                full += 1
            if full < many:
                back.append((room, first + full, many - full))
    if count:
        each = capacity // length
        full, some = divmod(count, each)
        first = plan.next_sequence
        if full:
            plan.place(length, full, each, first, 0, full * each)
            if capacity - each * length:
                back.append((capacity - each * length, first, full))
        if some:
            plan.place(length, 1, some, first + full, 0, some)
            back.append((capacity - some * length, first + full, 1))
        plan.next_sequence += full + bool(some)
    for run in back:
        insort(plan.open, run)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack the texts of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Rows with the
    same doc_id are packed each on its own; a null text counts as empty, a null doc_id is kept.
    Other columns are ignored; an empty table gives no rows. Runs two Spark jobs when called: it
    stores the pieces and reads the number of pieces of each length.
    """
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, tokenizer, capacity), "pieces")
    per_task = pieces.groupBy("_task", "length").agg(F.count("*").alias("_n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most `capacity` rows
        counts[row["length"]] = row["n"]
    plan = plan_packing(counts, capacity)
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    held = spark.sparkContext.broadcast(plan[order])  # a few rows per length
    before = per_task.withColumn(
        "_before",
        F.sum("_n").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)),
    ).select("_task", "length", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = pieces.join(before, ["_task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_nth")).alias("_rank")
    )
    schema = T.StructType(
        [f for f in _PIECES.fields if not f.name.startswith("_")]
        + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def look_up(batches):
        rows = held.value
        key = rows[:, 0] << 48 | rows[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            hit = rows[np.searchsorted(key, length << 48 | rank, side="right") - 1]
            nth = rank - hit[:, 1]
            arrays = [batch[f] for f in schema.names[:5]]
            arrays += [pa.array(hit[:, 4] + nth // hit[:, 3]), pa.array(hit[:, 5] + nth % hit[:, 3] * length)]
            yield pa.record_batch(arrays, names=schema.names)

    return ranked.mapInArrow(look_up, schema)

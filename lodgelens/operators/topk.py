"""Best items per query under a score, without joining every pair.

Scores are computed as numpy blocks inside tasks and only ``k`` rows per query leave a
block. Two plans, chosen by the measured size of the query side:

* few queries: they go to every task as a broadcast variable, and the items are read
  where they lie, without a shuffle;
* many queries: both sides are dealt by hash into blocks of bounded size and each pair
  of blocks is scored in a cogroup task.

A ``route`` column restricts a query to items with the same route. A route holding a
third of all items is cut into many blocks like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodgelens.bounds import broadcast_if_small, measured_bytes
from lodgelens.operators.ranking import top_per_key

#: Queries are broadcast up to this many values in bytes; beyond it blocks are paired.
BROADCAST_QUERY_BYTES = 16 * 1024 * 1024
#: Rows of a query block and of an item block on the paired plan. Query blocks get smaller, down to
#: the least, while there are fewer pairs of blocks than four per core.
QUERY_BLOCK, LEAST_QUERY_BLOCK = 16384, 2048
ITEM_BLOCK = 65536
#: Cells of one score matrix held at a time, and queries scored at once against a run of items.
MATRIX_CELLS = 2_000_000
STRIP = 2048
#: Arrow data of items turned into pandas at once.
PART_BYTES = 2 * 1024 * 1024
#: Rows found since the best were last picked, at least; more if the best themselves are many.
WAITING_ROWS = 200_000
#: Scores are rounded to six places: a rounded score is at most this far from the plain one.
ROUNDING = 1e-6


class BlockScore(Protocol):
    """Scores of items against queries. Pairs that do not qualify score ``-inf``.

    Three members are optional: ``ready(items)`` gives what ``score`` and ``exact`` take instead of the
    items, made once per run of items; ``order`` names a column by which the items of a part are sorted;
    ``error(state)`` is how far ``score`` may be from ``exact(state, queries, items, i)``, the scores of
    pairs of query positions and item columns, which then are the result.
    """

    def prepare(self, queries: pd.DataFrame) -> Any: ...

    def width(self, state: Any) -> int:
        """Values held per item while scoring, to size the blocks."""

    def score(self, state: Any, picked: np.ndarray, items: pd.DataFrame) -> np.ndarray:
        """Matrix of queries at positions ``picked`` (rows) by ``items`` (columns)."""


def _best(query_pos, item_ids, scores, k):
    """Rows of the ``k`` best items per query; the lowest item id wins ties."""
    id_rank = item_ids if item_ids.dtype.kind in "iu" else np.unique(item_ids, return_inverse=True)[1]
    order = np.lexsort((id_rank, -scores, query_pos))
    sorted_pos = query_pos[order]
    start = np.searchsorted(sorted_pos, sorted_pos, side="left")
    kept = order[np.arange(len(order)) - start < k]
    return query_pos[kept], item_ids[kept], scores[kept]


def _candidates(matrix: np.ndarray, k: int, least: np.ndarray, error: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions that can be among their row's ``k`` best: at or above ``least`` and, where these are many,
    at or above the row's k-th best. Ties at the edge all stay."""
    mask = matrix >= least[:, None]
    if matrix.shape[1] > k and np.count_nonzero(mask) > 4 * k * len(matrix):
        edge = np.partition(matrix, -k, axis=1)[:, -k].astype(float) - 2 * error
        mask = matrix >= np.maximum(least, edge)[:, None]
    q, i = np.nonzero(mask)
    real = matrix[q, i] > -np.inf
    return q[real], i[real]


class _Blocks:
    """Runs a score over blocks and keeps the best rows seen so far.

    What a query's k-th best row scores is its floor: later items below it are not looked at again.
    """

    def __init__(self, score: BlockScore, queries: pd.DataFrame, k: int):
        self.scorer, self.queries, self.k = score, queries.reset_index(drop=True), k
        self.state = score.prepare(self.queries)
        self.by_route = {r: np.asarray(v) for r, v in self.queries.groupby("route").indices.items()}
        self.ready = getattr(score, "ready", lambda items: items)
        self.error = ROUNDING + (score.error(self.state) if hasattr(score, "error") else 0.0)
        self.floor = np.full(len(self.queries), -np.inf)
        self.best: tuple | None = None
        self.waiting: list[tuple] = []
        self.held = 0

    def add(self, items: pd.DataFrame) -> None:
        if hasattr(self.scorer, "order"):
            items = items.sort_values(self.scorer.order, kind="stable")
        for route, rows in items.groupby("route").indices.items():
            picked = self.by_route.get(route)
            if picked is None:
                continue
            step = max(1, MATRIX_CELLS // max(min(len(picked), STRIP), self.scorer.width(self.state)))
            strip = max(1, MATRIX_CELLS // step)
            for at in range(0, len(rows), step):
                part = items.iloc[rows[at : at + step]]
                ids, ready = part["item_id"].to_numpy(), self.ready(part)
                for first in range(0, len(picked), strip):
                    self._compare(picked[first : first + strip], ids, ready)

    def _compare(self, picked: np.ndarray, ids: np.ndarray, ready: Any) -> None:
        matrix = self.scorer.score(self.state, picked, ready)
        q, i = _candidates(matrix, self.k, self.floor[picked] - self.error, self.error)
        if hasattr(self.scorer, "exact"):
            found = self.scorer.exact(self.state, picked[q], ready, i)
        else:
            found = matrix[q, i]
        found = np.round(found, 6)
        kept = found >= self.floor[picked[q]]
        self.waiting.append((picked[q[kept]], ids[i[kept]], found[kept]))
        self.held += int(kept.sum())
        if self.held > max(WAITING_ROWS, self.k * len(self.queries) // 2):
            self._merge()

    def _merge(self) -> None:
        if not self.waiting:
            return
        found = self.waiting if self.best is None else [self.best, *self.waiting]
        self.best = _best(*[np.concatenate(column) for column in zip(*found)], self.k)
        self.waiting, self.held = [], 0
        counts = np.bincount(self.best[0], minlength=len(self.floor))
        full = np.flatnonzero(counts >= self.k)  # rows come by query, best first
        self.floor[full] = self.best[2][np.cumsum(counts)[full] - 1]

    def result(self) -> pd.DataFrame | None:
        self._merge()
        if self.best is None:
            return None
        q, ids, scores = self.best
        return _hits_frame(self.queries["query_id"].to_numpy()[q], ids, scores)


def _parts(batch: pa.RecordBatch) -> Iterator[pd.DataFrame]:
    """A batch as pandas frames of about ``PART_BYTES`` of Arrow data."""
    rows = max(1, batch.num_rows * PART_BYTES // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows).to_pandas()


def _hits_frame(query_ids, item_ids, scores) -> pd.DataFrame:
    def column(values):
        # Text ids stay plain objects: Arrow-backed strings do not convert back.
        values = np.asarray(values)
        return pd.Series(values, dtype=values.dtype if values.dtype.kind in "iuf" else object)

    return pd.DataFrame(
        {
            "query_id": column(query_ids),
            "item_id": column(item_ids),
            "score": pd.Series(scores, dtype=float),
        }
    )


def _by_broadcast(queries: DataFrame, items: DataFrame, score: BlockScore, k: int, schema):
    session = queries.sparkSession
    asked = queries.toPandas()
    if asked.empty:
        return session.createDataFrame([], schema)
    shared = session.sparkContext.broadcast(asked)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(score, shared.value, k)
        for batch in batches:
            for part in _parts(batch):
                blocks.add(part)
        best = blocks.result()
        if best is not None:
            yield pa.RecordBatch.from_pandas(best, arrow, preserve_index=False)

    return items.mapInArrow(run, schema)


def _by_block_pairs(queries, items, score, k, schema, query_block, item_block):
    def slots(column: str, rows: int):
        return F.greatest(F.lit(1), F.ceil(F.col(column) / rows)).cast("int")

    busy = 4 * queries.sparkSession.sparkContext.defaultParallelism
    per_route = (
        queries.groupBy("route")
        .agg(F.count("*").alias("nq"))
        .join(items.groupBy("route").agg(F.count("*").alias("ni")), "route")
        .withColumn("bn", slots("ni", item_block))
        .withColumn("few", F.least(slots("nq", LEAST_QUERY_BLOCK), F.ceil(F.lit(busy) / F.col("bn")).cast("int")))
        .select("route", F.greatest(slots("nq", query_block), "few").alias("qn"), "bn")
    )
    per_route = broadcast_if_small(per_route)

    def dealt(df: DataFrame, key: str, own: str, own_n: str, other: str, other_n: str):
        # Fresh aliases, as both sides may come from the same table.
        fresh = df.select(*[F.col(c).alias(c) for c in df.columns])
        return (
            fresh.join(per_route, "route")
            .withColumn(own, F.pmod(F.xxhash64(key), F.col(own_n)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
            .drop("qn", "bn")
        )

    left = dealt(queries, "query_id", "qb", "qn", "ib", "bn")
    right = dealt(items, "item_id", "ib", "bn", "qb", "qn")

    arrow = to_arrow_schema(schema)

    def run(q: pa.Table, i: pa.Table) -> pa.Table:
        best = None
        if q.num_rows and i.num_rows:
            blocks = _Blocks(score, q.to_pandas(), k)
            for batch in i.to_batches():
                for part in _parts(batch):
                    blocks.add(part)
            best = blocks.result()
        return arrow.empty_table() if best is None else pa.Table.from_pandas(best, arrow, preserve_index=False)

    keys = ["route", "qb", "ib"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def top_items(
    queries: DataFrame,
    items: DataFrame,
    score: BlockScore,
    k: int,
    query_bytes: int | None = None,
    broadcast_bytes: int | None = None,
    query_block: int = QUERY_BLOCK,
    item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """``(query_id, item_id, score, rank)``: the ``k`` best items per query.

    Both frames need ``query_id`` or ``item_id`` and what the score reads. ``route``
    columns are optional but must come on both sides; drop items on routes nobody asks for
    beforehand (``filters.wanted_items``). Scores are rounded to six places
    before ranking and the lowest item id breaks ties, so the result does not depend on
    how rows fell into blocks. ``query_bytes`` is an upper bound the caller already knows;
    without it the query side is measured.
    """
    if "route" not in queries.columns:
        queries = queries.withColumn("route", F.lit("all"))
        items = items.withColumn("route", F.lit("all"))
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("item_id", items.schema["item_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    if query_bytes is None:
        query_bytes = measured_bytes(queries)
    if query_bytes <= (BROADCAST_QUERY_BYTES if broadcast_bytes is None else broadcast_bytes):
        partial = _by_broadcast(queries, items, score, k, schema)
    else:
        partial = _by_block_pairs(queries, items, score, k, schema, query_block, item_block)
    return top_per_key(partial, ["query_id"], [F.desc("score")], k, tie="item_id")

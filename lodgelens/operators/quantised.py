"""Approximate vector search over product-quantised residuals in two-level cells.

A vector is its coarse centre, plus one of the fine centres (shared by all coarse ones), plus a residual
whose parts of ``PART`` dimensions are replaced by the nearest entry of a codebook. An item is stored as a
cell and one byte per part; a search puts its vector together again, in floats and for a run of items at a
time, and compares it with all queries of a block in one product. The best of a query's cells are scored
again with their stored vectors; only this short list, whose length does not depend on the table, is scored
exactly.

A query that probes few of the cells is dealt to them. Where most cells must be probed, blocks of queries
meet blocks of items instead, and a bit per cell tells what a query probes: a row per query and cell would
be many times the table.

Cells grow with the table at a constant number of rows each, centres only with its square root. How many
cells a query must probe depends on how clustered the vectors are; fitting measures it on the sample.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgelens.operators.ranking import top_per_key
from lodgelens.operators.topk import top_items
from lodgelens.session import materialise

#: Vectors the centres and codebooks are fitted on, chosen by a hash of their id. Every vector is indexed.
SAMPLE_ROWS = 65_536
ROWS_PER_CELL = 256
#: Centres of one level at most: a million cells.
MAX_CENTRES = 1024
#: Dimensions per code and entries per codebook; a code is one byte.
PART, ENTRIES = 2, 256
#: Queries are dealt to their cells while they probe at most this part of them.
ROUTED_SHARE = 1 / 16
#: Distances of vectors to centres held at once.
DISTANCES = 1_000_000
#: Items scored exactly per query.
SHORTLIST = 50
#: Share of true neighbours that must lie in the probed cells of the sample, and vectors asked for it.
CELL_RECALL, ASKED = 0.97, 256
ITERATIONS = 10


@dataclass(frozen=True)
class Quantiser:
    coarse: np.ndarray  # (coarse centres, d)
    fine: np.ndarray  # (fine centres, d)
    books: np.ndarray  # (parts, entries, PART)
    probes: int

    @property
    def cells(self) -> int:
        return len(self.coarse) * len(self.fine)

    def centre(self, cell: int) -> np.ndarray:
        return self.coarse[cell // len(self.fine)] + self.fine[cell % len(self.fine)]

    def nearest_cells(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` cells nearest to each vector, nearest first: those of the nearest coarse centres."""
        width = min(len(self.coarse), max(1, math.ceil(2 * probes / len(self.fine))))
        step = max(1, DISTANCES // (width * len(self.fine) + len(self.coarse)))
        found = [self._nearest_cells(unit[at : at + step], probes, width) for at in range(0, len(unit), step)]
        return np.concatenate(found) if found else np.empty((0, min(probes, width * len(self.fine))), np.int64)

    def _nearest_cells(self, unit: np.ndarray, probes: int, width: int) -> np.ndarray:
        apart = (self.coarse**2).sum(axis=1) - 2 * unit @ self.coarse.T
        near = np.argsort(apart, axis=1, kind="stable")[:, :width]
        own = np.take_along_axis(apart, near, axis=1)
        # |x - c - f|^2 = |x - c|^2 - 2 x.f + 2 c.f + |f|^2
        across = 2 * self.coarse @ self.fine.T + (self.fine**2).sum(axis=1)
        total = own[:, :, None] + across[near] - 2 * (unit @ self.fine.T)[:, None, :]
        flat = total.reshape(len(unit), -1)
        best = np.argsort(flat, axis=1, kind="stable")[:, :probes]
        return np.take_along_axis(near, best // len(self.fine), axis=1) * len(self.fine) + best % len(self.fine)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each vector and the codes (one byte per part) of its residual."""
        cell = self.nearest_cells(unit, 1)[:, 0]
        rest = unit - self.coarse[cell // len(self.fine)] - self.fine[cell % len(self.fine)]
        parts = _parts(rest, len(self.books))
        codes = np.empty((len(unit), len(self.books)), np.uint8)
        for m, book in enumerate(self.books):
            codes[:, m] = _nearest(parts[:, m], book)[0]
        return cell, codes

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that cells and codes stand for, in floats."""
        rest = np.concatenate([book.astype(np.float32)[codes[:, m]] for m, book in enumerate(self.books)], axis=1)
        rest = rest[:, : self.coarse.shape[1]]
        rest += (self.coarse[cell // len(self.fine)] + self.fine[cell % len(self.fine)]).astype(np.float32)
        return rest


def _parts(rest: np.ndarray, parts: int) -> np.ndarray:
    """Vectors as (n, parts, PART), zeros after their last dimension."""
    return np.pad(rest, ((0, 0), (0, parts * PART - rest.shape[1]))).reshape(len(rest), parts, PART)


def _units(vectors) -> np.ndarray:
    raw = np.stack([np.asarray(v, float) for v in vectors])
    norm = np.linalg.norm(raw, axis=1)
    return raw / np.where(norm > 0, norm, 1.0)[:, None]


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of each point and its squared distance less the point's own square."""
    weight, step = (centres**2).sum(axis=1), max(1, DISTANCES // len(centres))
    own, apart = np.empty(len(points), np.int64), np.empty(len(points))
    for at in range(0, len(points), step):
        part = weight - 2 * points[at : at + step] @ centres.T
        own[at : at + step] = part.argmin(axis=1)
        apart[at : at + step] = part.min(axis=1)
    return own, apart


def _centres(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` means of a bounded sample; a centre without points takes a point far from its own centre."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), k, replace=len(points) < k)].copy()
    for _ in range(ITERATIONS):
        own, apart = _nearest(points, centres)
        n = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, weights=points[:, i], minlength=k) for i in range(points.shape[1])], axis=1)
        centres[n > 0] = total[n > 0] / n[n > 0][:, None]
        far = np.argsort(-(apart + (points**2).sum(axis=1)), kind="stable")
        empty = np.flatnonzero(n == 0)[: len(points)]
        centres[empty] = points[far[: len(empty)]]
    return centres


def _needed_probes(q: Quantiser, unit: np.ndarray, recall: float) -> int:
    """Cells to probe so that ``recall`` of the ten nearest of some sampled vectors lie in them."""
    asked = unit[:ASKED]
    near = []
    for i, vector in enumerate(asked):
        alike = -(unit @ vector)
        alike[i] = 2
        near.append(np.argsort(alike, kind="stable")[: min(10, len(unit) - 1)])
    near = np.stack(near) if near else np.empty((0, 0), np.int64)
    if not near.size:
        return 1
    # Place of each neighbour's cell in the order in which the query would probe.
    order = q.nearest_cells(asked, q.cells)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
    cell = q.nearest_cells(unit, 1)[:, 0]
    places = np.sort(np.take_along_axis(rank, cell[near], axis=1).ravel())
    return int(places[min(len(places) - 1, math.ceil(recall * len(places)) - 1)]) + 1


def fit_quantiser(chunks: DataFrame, recall: float = CELL_RECALL, seed: int = 7) -> Quantiser:
    """Centres, codebooks and number of probes for ``chunks`` (chunk_id, embedding of one length)."""
    usable = chunks.filter(F.col("embedding").isNotNull()).select("chunk_id", "embedding")
    n = usable.count()
    if not n:
        raise ValueError("no vectors")
    slots = 1 << 30
    share = min(slots, math.ceil(slots * SAMPLE_ROWS / n))
    sample = usable.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(slots)) < share)
    sample = materialise(sample.select(F.xxhash64("chunk_id", F.lit(seed)).alias("h"), F.col("embedding").cast("array<double>").alias("v")), "sample")
    side = min(MAX_CENTRES, max(1, math.ceil(math.sqrt(n / ROWS_PER_CELL))))

    def levels(rows: pd.DataFrame) -> pd.DataFrame:
        unit = _units(rows.sort_values("h")["v"])
        coarse = _centres(unit, side, seed)
        own = _nearest(unit, coarse)[0]
        fine = _centres(unit - coarse[own], side, seed + 1)
        probes = _needed_probes(Quantiser(coarse, fine, np.empty((0, 0, 0)), 1), unit, recall)
        return pd.DataFrame({"level": [0] * len(coarse) + [1] * len(fine), "centre": [*coarse, *fine], "probes": probes})

    found = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(levels, "level int, centre array<double>, probes int").toPandas()
    coarse, fine = (np.stack(found["centre"][found["level"] == i]) for i in (0, 1))
    parts = -(-coarse.shape[1] // PART)
    bare = Quantiser(coarse, fine, np.empty((0, 0, 0)), 1)

    def residuals(batches):
        for batch in batches:
            for at in range(0, len(batch), 1000):
                rows = batch.iloc[at : at + 1000]
                unit = _units(rows["v"])
                cell = bare.nearest_cells(unit, 1)[:, 0]
                rest = _parts(unit - coarse[cell // len(fine)] - fine[cell % len(fine)], parts)
                yield pd.DataFrame({"h": np.repeat(rows["h"].to_numpy(), parts), "m": np.tile(np.arange(parts), len(rows)), "p": list(rest.reshape(-1, PART))})

    def book(rows: pd.DataFrame) -> pd.DataFrame:
        centres = _centres(np.stack(rows.sort_values("h")["p"]), ENTRIES, seed)
        return pd.DataFrame({"m": rows["m"].iloc[0], "e": np.arange(ENTRIES), "centre": list(centres)})

    cut = sample.mapInPandas(residuals, "h long, m int, p array<double>")
    entries = cut.groupBy("m").applyInPandas(book, "m int, e int, centre array<double>").toPandas().sort_values(["m", "e"])
    return Quantiser(coarse, fine, np.stack(entries["centre"]).reshape(parts, ENTRIES, PART), int(found["probes"].iloc[0]))


def with_codes(chunks: DataFrame, model: Quantiser) -> DataFrame:
    """``chunks`` that have a vector, with ``cell`` and ``codes``."""

    @F.pandas_udf("struct<cell:int,codes:binary>")
    def coded(vectors: pd.Series) -> pd.DataFrame:
        cell, codes = model.encode(_units(vectors))
        return pd.DataFrame({"cell": cell.astype("int32"), "codes": [c.tobytes() for c in codes]})

    usable = chunks.filter(F.col("embedding").isNotNull())
    return usable.withColumn("_c", coded.asNondeterministic()("embedding")).select(*chunks.columns, "_c.cell", "_c.codes")


def write_index(chunks: DataFrame, model: Quantiser, path: str) -> DataFrame:
    """Store chunks with their codes by cell, and the model beside them; return the stored table.

    Rows are dealt by range over cell and id, so a cell with a third of all rows is written by many tasks
    and a file holds neighbouring cells: a search for few cells reads few row groups.
    """
    spark = chunks.sparkSession
    rows = [("coarse", i, 0, c.tolist()) for i, c in enumerate(model.coarse)]
    rows += [("fine", i, 0, c.tolist()) for i, c in enumerate(model.fine)]
    rows += [("book", m, e, c.tolist()) for m, book in enumerate(model.books) for e, c in enumerate(book)]
    rows.append(("probes", 0, 0, [float(model.probes)]))
    spark.createDataFrame(rows, "kind string, i int, j int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    coded = materialise(with_codes(chunks, model), "codes")  # the range sampling would run the model twice
    dealt = coded.repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell", "chunk_id")
    dealt.write.mode("overwrite").parquet(f"{path}/rows")
    return spark.read.parquet(f"{path}/rows")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, Quantiser]:
    """Rows and model stored by :func:`write_index`."""
    model = spark.read.parquet(f"{path}/model").toPandas().sort_values(["kind", "i", "j"])
    part = {kind: np.stack(rows["v"]) for kind, rows in model.groupby("kind")}
    books = part["book"].reshape(-1, ENTRIES, PART)
    return spark.read.parquet(f"{path}/rows"), Quantiser(part["coarse"], part["fine"], books, int(part["probes"][0, 0]))


class CodeScore:
    """Cosine of queries with the vectors that the items' cells and codes stand for, in floats.

    ``probed`` of a query holds a bit per cell; items of other cells do not qualify. Without that column
    all do. The cosine of a vector put together from codes comes from its distance to the query.
    """

    order = "cell"

    def __init__(self, model: Quantiser):
        self.model = model

    def prepare(self, queries: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        unit = _units(queries["embedding"])
        free = None
        if "probed" in queries.columns:
            bits = np.frombuffer(b"".join(queries["probed"]), np.uint8).reshape(len(queries), -1)
            free = np.unpackbits(bits, axis=1, count=self.model.cells).T == 0  # cells not probed, by cell
        return unit.astype(np.float32), (1 - (unit**2).sum(axis=1) / 2).astype(np.float32), free

    def width(self, state: tuple) -> int:
        return state[0].shape[1]

    def ready(self, items: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell = items["cell"].to_numpy()
        codes = np.frombuffer(b"".join(items["codes"]), np.uint8).reshape(len(items), -1)
        vectors = self.model.decode(cell, codes)
        return np.ascontiguousarray(vectors.T), (vectors**2).sum(axis=1) / 2, cell

    def score(self, state: tuple, picked: np.ndarray, items: tuple) -> np.ndarray:
        unit, own, free = state
        vectors, half, cell = items
        out = unit[picked] @ vectors
        out -= half
        out += own[picked][:, None]
        if free is not None:
            edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]  # items come by cell
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                out[free[cell[start]][picked], start:stop] = -np.inf
        return out


def probed(queries: DataFrame, model: Quantiser, probes: int | None = None) -> DataFrame:
    """query_id, embedding, and the cells that a query probes: a row per ``cell``, or if they are many
    (``ROUTED_SHARE``) one row with a bit per cell in ``probed``."""
    wanted = min(model.cells, model.probes if probes is None else probes)
    usable = queries.filter(F.col("embedding").isNotNull())
    if wanted <= model.cells * ROUTED_SHARE:

        @F.pandas_udf("array<int>")
        def nearest(vectors: pd.Series) -> pd.Series:
            return pd.Series(list(model.nearest_cells(_units(vectors), wanted).astype("int32")))

        return usable.select("query_id", "embedding", F.explode(nearest.asNondeterministic()("embedding")).alias("cell"))

    @F.pandas_udf("binary")
    def bits(vectors: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(vectors), 500):
            cells = model.nearest_cells(_units(vectors.iloc[at : at + 500]), wanted)
            has = np.zeros((len(cells), model.cells), np.uint8)
            np.put_along_axis(has, cells, 1, axis=1)
            out += [row.tobytes() for row in np.packbits(has, axis=1)]
        return pd.Series(out, dtype=object)

    return usable.select("query_id", "embedding", bits.asNondeterministic()("embedding").alias("probed"))


def short_lists(asked: DataFrame, index: DataFrame, model: Quantiser, shortlist: int = SHORTLIST, **plan) -> DataFrame:
    """query_id, item_id: the best items of the probed cells by their codes. ``asked`` is what :func:`probed` gives."""
    right = index.select(F.col("chunk_id").alias("item_id"), "codes", "cell")
    if "cell" in asked.columns:
        asked, right = asked.withColumnRenamed("cell", "route"), right.withColumn("route", F.col("cell"))
    return top_items(asked, right, CodeScore(model), shortlist, **plan).select("query_id", "item_id")


def rescored(short: DataFrame, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, chunk_id, score)``: the ``k`` best of the short lists by exact cosine."""

    def unit(df: DataFrame, key: str, out: str) -> DataFrame:
        v = F.col("embedding")  # travels as it is stored
        norm = F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
        return df.select(F.col(key).alias(out), F.struct(v.alias("v"), norm.alias("n")).alias(f"_{out}"))

    pairs = short.join(unit(chunks, "chunk_id", "item_id"), "item_id").join(unit(queries, "query_id", "query_id"), "query_id")
    a, b = F.col("_query_id"), F.col("_item_id")
    dot = F.aggregate(F.zip_with(a["v"], b["v"], lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    score = F.round(F.coalesce(F.try_divide(dot, a["n"] * b["n"]), F.lit(0.0)), 6)
    top = top_per_key(pairs.select("query_id", "item_id", score.alias("score")), ["query_id"], [F.desc("score")], k, tie="item_id")
    return top.select("query_id", "rank", F.col("item_id").alias("chunk_id"), "score")


def knn_quantised(
    queries: DataFrame, index: DataFrame, model: Quantiser, k: int = 20, probes: int | None = None, shortlist: int = SHORTLIST, **plan
) -> DataFrame:
    """``(query_id, rank, chunk_id, score)`` of the ``k`` nearest, approximately.

    ``index`` is what :func:`with_codes` or :func:`write_index` gives. Scores are exact cosines; only which
    items are scored is approximate. ``k`` must not exceed ``shortlist``.
    """
    if k > shortlist:
        raise ValueError("the short list must hold k items")
    asked = materialise(probed(queries, model, probes), "probed")
    return rescored(short_lists(asked, index, model, shortlist, **plan), queries, index, k)

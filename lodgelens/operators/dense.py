"""Vector search: exact, filtered and by cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.operators.filters import FILTERS, asked_route, offered_routes, wanted_items
from lodgelens.operators.topk import top_items


def _unit(vectors: pd.Series) -> np.ndarray:
    raw = np.stack(vectors.to_numpy()).astype(float)
    norm = np.linalg.norm(raw, axis=1)
    return raw / np.where(norm > 0, norm, 1.0)[:, None]


class CosineScore:
    """Cosine similarity of ``embedding`` columns, in doubles; blocks are compared in floats first."""

    def prepare(self, queries: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        unit = _unit(queries["embedding"])
        return unit, unit.astype(np.float32)

    def width(self, state: tuple) -> int:
        return state[0].shape[1]

    def error(self, state: tuple) -> float:
        return 4 * state[0].shape[1] * float(np.finfo(np.float32).eps)

    def ready(self, items: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        unit = _unit(items["embedding"])
        return unit, np.ascontiguousarray(unit.astype(np.float32).T)

    def score(self, state: tuple, picked: np.ndarray, items: tuple) -> np.ndarray:
        return state[1][picked] @ items[1]

    def exact(self, state: tuple, queries: np.ndarray, items: tuple, i: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        for at in range(0, len(i), 50_000):
            to = slice(at, at + 50_000)
            out[to] = np.einsum("ij,ij->i", state[0][queries[to]], items[0][i[to]])
        return out


def _sides(queries: DataFrame, chunks: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    left = queries.filter(F.col("embedding").isNotNull())
    right = chunks.filter(F.col("embedding").isNotNull())
    return (
        left.select("query_id", "embedding", *more),
        right.select(F.col("chunk_id").alias("item_id"), "embedding", *more),
    )


def _hits(top: DataFrame) -> DataFrame:
    return top.select("query_id", "rank", F.col("item_id").alias("chunk_id"), "score")


def knn_exact(queries: DataFrame, chunks: DataFrame, k: int = 20, **plan) -> DataFrame:
    """``(query_id, rank, chunk_id, score)``: the ``k`` nearest chunks per query."""
    left, right = _sides(queries, chunks)
    return _hits(top_items(left, right, CosineScore(), k, **plan))


def knn_filtered(queries: DataFrame, chunks: DataFrame, k: int = 20, **plan) -> DataFrame:
    """Like :func:`knn_exact`, within each query's own filters.

    A query may name a ``listing_id``, a ``neighbourhood``, both or none. A chunk is
    offered under each combination it satisfies, and combinations no query uses are
    dropped before any vector is touched, so filters apply ahead of the ranking.
    """
    left, right = _sides(queries, chunks, *FILTERS)
    left = left.select("query_id", "embedding", asked_route().alias("route"))
    right = right.select("item_id", "embedding", F.explode(offered_routes()).alias("route"))
    return _hits(top_items(left, wanted_items(right, left), CosineScore(), k, **plan))


def fit_cells(
    chunks: DataFrame, cells: int, seed: int = 7, iterations: int = 10, fraction: float = 1.0
) -> KMeansModel:
    """Cell centres over unit vectors; the model is ``cells`` x ``dim`` doubles.

    ``fraction`` below 1 fits the centres on a share of the vectors. Search stays whole:
    every vector is assigned to a cell either way.
    """
    points = chunks.filter(F.col("embedding").isNotNull()).select(
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    if fraction < 1.0:
        points = points.sample(fraction, seed)
    return KMeans(k=cells, seed=seed, maxIter=iterations).fit(points)


def with_cells(df: DataFrame, model: KMeansModel, probes: int = 1, out: str = "cell") -> DataFrame:
    """One row per vector and each of its ``probes`` nearest cells."""
    centres = np.array(model.clusterCenters())
    weight = (centres**2).sum(axis=1)
    probes = min(probes, len(centres))

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        distance = weight[None, :] - 2.0 * (_unit(vectors) @ centres.T)
        near = np.argsort(distance, axis=1, kind="stable")[:, :probes]
        return pd.Series(list(near.astype("int32")))

    return df.filter(F.col("embedding").isNotNull()).withColumn(
        out, F.explode(nearest("embedding"))
    )


def write_cell_index(chunks: DataFrame, model: KMeansModel, path: str) -> DataFrame:
    """Store chunks by cell and return the stored table.

    Rows are dealt by cell and a salt, so a cell holding a third of all rows is written by
    many tasks while small cells stay in few files.
    """
    celled = with_cells(chunks, model).withColumn("_salt", F.pmod(F.xxhash64("chunk_id"), F.lit(64)))
    spread = celled.repartition("cell", "_salt").drop("_salt")
    spread.write.mode("overwrite").partitionBy("cell").parquet(path)
    return chunks.sparkSession.read.parquet(path)


def knn_ann(
    queries: DataFrame,
    chunks: DataFrame,
    model: KMeansModel,
    k: int = 20,
    probes: int = 4,
    filtered: bool = False,
    **plan,
) -> DataFrame:
    """Approximate search: each query sees only the chunks of its ``probes`` nearest cells.

    ``chunks`` with a ``cell`` column are taken as assigned. Stored by
    :func:`write_cell_index`, the probed cells prune whole folders at run time. With
    ``filtered`` the queries' own filters apply inside the cells, ahead of the ranking.
    """
    celled = chunks if "cell" in chunks.columns else with_cells(chunks, model)
    asked = with_cells(queries, model, probes)
    celled = wanted_items(celled, asked, "cell")
    cell = F.col("cell").cast("string")
    left_route = F.concat(cell, F.lit("/"), asked_route()) if filtered else F.col("cell")
    left = asked.select("query_id", "embedding", left_route.alias("route"))
    right = celled.withColumnRenamed("chunk_id", "item_id")
    if filtered:
        right = right.select("item_id", "embedding", cell.alias("in_cell"),
                             F.explode(offered_routes()).alias("offer"))
        route = F.concat("in_cell", F.lit("/"), "offer").alias("route")
        right = wanted_items(right.select("item_id", "embedding", route), left)
    else:
        right = right.select("item_id", "embedding", F.col("cell").alias("route"))
    return _hits(top_items(left, right, CosineScore(), k, **plan))

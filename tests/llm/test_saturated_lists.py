"""Vectors whose neighbour lists are full of links to their own group."""

import math

import numpy as np
import pytest

from lodgelens.llm import embedding_dedup


def brute_force(ids, x):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    root = np.array(ids)
    while True:
        new = np.minimum(root, np.where(near, root[None, :], 2**60).min(axis=1))
        if (new == root).all():
            return {i: (int(c), int(r)) for i, c, r in zip(ids, near.sum(axis=1), root, strict=True)}
        root = new


def found(spark, ids, x):
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    rows = embedding_dedup.near_duplicates(table.repartition(4)).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows}


@pytest.mark.parametrize("size, noise, others", [(20, 0.0, 0), (12, 0.002, 400), (300, 0.002, 0)])
def test_groups_bridged_by_a_weaker_link(spark, size, noise, others):
    rng = np.random.default_rng(size)
    u = np.eye(32)[0]
    v = 0.955 * u + math.sqrt(1 - 0.955**2) * np.eye(32)[1]
    x = np.concatenate([np.repeat([u], size, axis=0), np.repeat([v], size, axis=0)]) + noise * rng.normal(size=(2 * size, 32))
    x = np.concatenate([x, rng.normal(size=(others, 32))])
    ids = list(rng.permutation(len(x)))
    got, want = found(spark, ids, x), brute_force(ids, x)
    assert {i: r for i, (_, r) in got.items()} == {i: r for i, (_, r) in want.items()}
    linked = [i for i in ids if want[i][0]]
    assert np.mean([got[i][0] / want[i][0] for i in linked]) >= 0.9 and all(got[i][0] <= want[i][0] for i in ids)


def test_one_hot_group_of_copies(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 16)), 1500, axis=0), rng.normal(size=(300, 16))])
    ids = list(range(len(x)))
    assert found(spark, ids, x) == brute_force(ids, x)

"""Near duplicates among vectors by NN-descent.

1. Starting lists: random hyperplanes put vectors into buckets, once per table; within a bucket every
   vector takes its nearest others. The number of tables keeps the chance that a linked pair never
   shares a bucket at ``MISS``, whatever the number of vectors.
2. Refinement: for every vector, its neighbours (and those whose list it is in) are compared with each
   other; each keeps its nearest. This repeats until no round finds new links.
3. Saturation: a list full of links hides others. Components with more members than a list holds are
   contracted to one member each, and lists are made anew among these and the other vectors. Two vectors
   that link are at most their components' radii and the threshold's angle apart in these members, so
   every pair of components that near is compared in full, in blocks. This repeats until nothing joins.
   Then all members of a component are compared with each other, and only counts leave a block.
4. Audit: vectors picked by hash are compared with all vectors. If too few of their links were found,
   more tables and another refinement follow; a recall below ``REQUIRED_RECALL`` is an error.

Equal vectors (by two 64-bit hashes) are one node with a count. Similarities are double precision. Buckets and components of
any size are dealt into chunks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgelens.llm.graph import components
from lodgelens.session import materialise

THRESHOLD = 0.95
NEIGHBOURS = 8
#: Vectors of a bucket, and of a component, that are compared in one block.
CHUNK = 512
PER_BUCKET = 96
MISS = 0.005
MAX_ROUNDS = 4
#: Vectors of the audit and the share of their links that must have been found.
AUDIT, LEAST_RECALL = 256, 0.98
#: Recall without which no result is given, and refinements tried for it.
REQUIRED_RECALL, MAX_SEEDS = 0.9, 8
#: Nodes per task of the refinement.
NODES_PER_GROUP = 2000


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double, length one) and d (dimensions) of the vectors that can link."""
    values = F.col("embedding").cast("array<double>")
    rows = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sane = rows.where(F.coalesce((F.size("e") > 0) & finite, F.lit(False)))
    scaled = sane.withColumn("_m", F.array_max(F.transform("e", F.abs))).where("_m > 0")
    one = scaled.groupBy("vec_id").agg(F.max(F.struct("_m", "e")).alias("s"))
    small = one.select("vec_id", F.transform("s.e", lambda x: x / F.col("s._m")).alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    return small.select("vec_id", F.transform("e", lambda x: x / norm).alias("v"), F.size("e").alias("d"))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(flat), -1) if len(flat) else np.empty((0, 1))


def _nearest(ids: np.ndarray, x: np.ndarray, k: int):
    """For every row its ``k`` most similar other rows: from, to, similarity."""
    s = x @ x.T
    np.fill_diagonal(s, -2)
    k = min(k, len(ids) - 1)
    to = np.argpartition(-s, k - 1, axis=1)[:, :k]
    sim = np.take_along_axis(s, to, axis=1)
    return np.repeat(ids, k), ids[to].ravel(), sim.ravel()


_EDGE = "a long, b long, s double"


def _edges(a, b, s) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "s": pa.array(s, pa.float64())})


def starting_lists(nodes: DataFrame, n: int, tables: int, bits: int, seed: int, only: DataFrame | None = None) -> DataFrame:
    """Edges (a, b, s) to the nearest others in each bucket of ``tables`` random partitions.

    With ``only`` (vec_id), buckets without any of these vectors are left out.
    """

    def sign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            d = batch["d"].to_numpy()
            bucket = np.zeros((len(d), tables), np.int64)
            for size in np.unique(d):
                at = np.flatnonzero(d == size)
                x = _matrix(batch["v"].take(pa.array(at)))
                for t in range(tables):
                    planes = np.random.default_rng([seed, t, int(size)]).normal(size=(int(size), max(bits, 1)))
                    bucket[at, t] = ((x @ planes > 0)[:, :bits] << np.arange(bits)).sum(axis=1)
            yield pa.record_batch(
                [batch["vec_id"], batch["v"], batch["d"], pa.ListArray.from_arrays(np.arange(len(d) + 1, dtype=np.int32) * tables, bucket.ravel())],
                names=["vec_id", "v", "d", "buckets"],
            )

    signed = nodes.mapInArrow(sign, "vec_id long, v array<double>, d int, buckets array<long>")
    rows = materialise(signed, "signed").select("vec_id", "v", "d", F.posexplode("buckets").alias("t", "bucket"))
    if only is not None:
        asked = rows.select("vec_id", "t", "d", "bucket").join(only, "vec_id", "left_semi").select("t", "d", "bucket").distinct()
        rows = rows.join(asked, ["t", "d", "bucket"], "left_semi").select("vec_id", "v", "d", "t", "bucket")
    sizes = rows.groupBy("t", "d", "bucket").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = rows.join(sizes, ["t", "d", "bucket"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id", "t", F.lit(seed)), F.col("chunks")))

    def search(table: pa.Table) -> pa.Table:
        if table.num_rows < 2:
            return _edges([], [], [])
        return _edges(*_nearest(table["vec_id"].to_numpy(), _matrix(table["v"]), NEIGHBOURS))

    return dealt.groupBy("t", "d", "bucket", "chunk").applyInArrow(search, _EDGE)


def _lists(edges: DataFrame) -> DataFrame:
    """The nearest ``NEIGHBOURS`` of every vector; ties by id."""
    best = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    once = edges.groupBy("a", "b").agg(F.max("s").alias("s"))
    return once.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= NEIGHBOURS).drop("_r")


def refined(lists: DataFrame, nodes: DataFrame, groups: int) -> DataFrame:
    """Edges among the neighbours of every vector: its list, and the nearest whose list it is in."""
    back = _lists(lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    around = lists.select("a", "b").union(back.select("a", "b")).union(lists.select("a", F.col("a").alias("b"))).distinct()
    held = around.join(nodes.select(F.col("vec_id").alias("b"), "v", "d"), "b")
    dealt = held.withColumn("g", F.pmod(F.xxhash64("a"), F.lit(groups)))

    def join(table: pa.Table) -> pa.Table:
        a, b, x = table["a"].to_numpy(), table["b"].to_numpy(), _matrix(table["v"])
        order = np.argsort(a, kind="stable")
        cut = np.flatnonzero(np.diff(a[order])) + 1
        found = [_nearest(b[at], x[at], 3) for at in np.split(order, cut) if len(at) > 1]
        if not found:
            return _edges([], [], [])
        return _edges(*(np.concatenate(c) for c in zip(*found, strict=True)))

    return dealt.groupBy("g", "d").applyInArrow(join, _EDGE)


def _link_counts(members: DataFrame, nodes: DataFrame, groups: int) -> DataFrame:
    """vec_id, n_links: vectors of other nodes of its component that each member (node, root) links with."""
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    rows = members.join(sizes, "root").join(nodes.select(F.col("vec_id").alias("node"), "v", "d", "m"), "node")
    chunk = F.pmod(F.hash("node"), F.col("chunks"))
    paired = rows.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    small = F.col("chunks") == 1  # small components share a group; the task tells them apart
    keyed = paired.select(
        "node", "root", "v", "m", "chunk",
        F.when(small, -1 - F.pmod(F.xxhash64("root"), F.lit(groups))).otherwise(F.xxhash64("root")).alias("g"),
        F.when(small, -1).otherwise(F.least("chunk", "other")).alias("i"),
        F.when(small, F.col("d")).otherwise(F.greatest("chunk", "other")).alias("j"),
    )

    def count(table: pa.Table) -> pa.Table:
        ids, root, part, x = table["node"].to_numpy(), table["root"].to_numpy(), table["chunk"].to_numpy(), _matrix(table["v"])
        links, many = np.zeros(len(ids), np.int64), table["m"].to_numpy()
        order = np.argsort(root, kind="stable")
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        for at in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
            if i == j or i < 0:
                links[at] = (x[at] @ x[at].T >= THRESHOLD) @ many[at] - many[at]
            else:
                one, two = at[part[at] == i], at[part[at] == j]
                near = x[one] @ x[two].T >= THRESHOLD
                links[one], links[two] = near @ many[two], many[one] @ near
        return pa.table({"vec_id": pa.array(ids), "n": pa.array(links)})

    return keyed.groupBy("g", "i", "j").applyInArrow(count, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n_links"))


def _audited_recall(nodes: DataFrame, counts: DataFrame) -> float:
    """Share of a vector's links that were found, as mean over the audited; half of these have links."""
    order = [F.xxhash64("vec_id"), F.col("vec_id")]
    some = nodes.select("vec_id").orderBy(*order).limit(AUDIT // 2)
    linked = counts.where("n_links > 0").select("vec_id").orderBy(*order).limit(AUDIT // 2)
    picked = nodes.join(F.broadcast(some.union(linked).distinct()), "vec_id").collect()  # AUDIT vectors at most
    queries = {r["vec_id"]: np.array(r["v"]) for r in picked}
    copies = {r["vec_id"]: r["m"] for r in picked}

    def scan(batches):
        total = dict.fromkeys(queries, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            d, many = batch["d"].to_numpy(), batch["m"].to_numpy()
            for size in np.unique(d):
                at = np.flatnonzero(d == size)
                x = _matrix(batch["v"].take(pa.array(at)))
                same = [q for q, v in queries.items() if len(v) == size]
                if same:
                    near = np.stack([queries[q] for q in same]) @ x.T >= THRESHOLD
                    for q, row in zip(same, near, strict=True):
                        total[q] += int(many[at][row].sum())
        yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["vec_id", "n"])

    if not queries:
        return 1.0
    truth = nodes.mapInArrow(scan, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    own = nodes.sparkSession.createDataFrame([(int(q), int(m)) for q, m in copies.items()], "vec_id long, own long")
    both = truth.join(own, "vec_id").withColumn("n", F.col("n") - F.col("own")).where("n > 0").join(counts, "vec_id", "left")
    mean = both.agg(F.avg(F.coalesce("n_links", F.lit(0)) / F.col("n"))).first()[0]
    return 1.0 if mean is None else mean


def _bridges(roots: DataFrame, nodes: DataFrame, n: int, tables: int, bits: int, seed: int) -> DataFrame:
    """Links (a, b) between components (node, root) too large for their members' lists."""
    full = roots.groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") > NEIGHBOURS).select("root")
    inside = roots.join(full, "root")
    vector = nodes.select(F.col("vec_id").alias("node"), "v")
    first = vector.select(F.col("node").alias("root"), F.col("v").alias("c"))
    dot = F.aggregate(F.zip_with("v", "c", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    angle = lambda cosine: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    spread = inside.join(vector, "node").join(first, "root").groupBy("root").agg(angle(F.min(dot)).alias("r"))
    spread = materialise(spread, "spread")
    # A contracted component is its smallest member; nodes outside of such components are themselves.
    others = nodes.join(inside.select(F.col("node").alias("vec_id")).where("node <> root"), "vec_id", "left_anti")
    start = starting_lists(others, n, tables, bits, seed, full.select(F.col("root").alias("vec_id")))
    near = start.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s")
    radius = lambda side: spread.select(F.col("root").alias(side), F.col("r").alias(f"r_{side}"))
    reach = F.coalesce("r_a", F.lit(0.0)) + F.coalesce("r_b", F.lit(0.0))
    near = near.join(radius("a"), "a", "left").join(radius("b"), "b", "left").where("r_a IS NOT NULL OR r_b IS NOT NULL")
    wanted = materialise(near.where(angle(F.col("s")) <= reach + math.acos(THRESHOLD) + 1e-9).select("a", "b").distinct(), "component-pairs")

    whole = inside.union(nodes.select(F.col("vec_id").alias("node"), F.col("vec_id").alias("root")).join(full, "root", "left_anti").select("root", "node"))
    whole = whole.select("root", "node")
    sizes = whole.groupBy("root").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    asked = wanted.join(sizes.toDF("a", "i_n"), "a").join(sizes.toDF("b", "j_n"), "b")
    held = whole.join(nodes.select(F.col("vec_id").alias("node"), "v"), "node")
    of = lambda side, own, other: asked.join(held.withColumnRenamed("root", side), side).select(
        "a", "b", F.lit(side).alias("side"), F.pmod(F.hash("node"), F.col(own)).alias("own"),
        F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("other"), "node", "v",
    )
    left = of("a", "i_n", "j_n").withColumnsRenamed({"own": "i", "other": "j"})
    right = of("b", "j_n", "i_n").withColumnsRenamed({"own": "j", "other": "i"})

    def meet(table: pa.Table) -> pa.Table:
        one = np.array(table["side"].to_pylist()) == "a"
        ids, x = table["node"].to_numpy(), _matrix(table["v"])
        close = x[one] @ x[~one].T >= THRESHOLD
        if not close.any():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        i, j = np.unravel_index(close.argmax(), close.shape)
        return pa.table({"a": pa.array([ids[one][i]]), "b": pa.array([ids[~one][j]])})

    return left.unionByName(right).groupBy("a", "b", "i", "j").applyInArrow(meet, "a long, b long")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    A link is a cosine of at least 0.95. Vectors that are null, zero or hold null or non-finite values
    link with nothing, and so do vectors of different length. Rows that share a vec_id are one vector
    (the largest). A null vec_id has no links, a null component and is kept. Other columns are ignored;
    an empty table gives no rows. Runs Spark jobs when called.
    """
    usable = materialise(usable_vectors(vectors), "vectors")
    same = usable.select("vec_id", "d", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    copies = materialise(same.groupBy("h1", "h2", "d").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "copies")
    nodes = usable.join(copies.select(F.col("rep").alias("vec_id"), "m"), "vec_id").select("vec_id", "v", "d", "m")
    nodes = materialise(nodes, "nodes")
    n = nodes.count()
    groups = max(1, n // NODES_PER_GROUP)
    bits = max(0, round(math.log2(max(n, 1) / PER_BUCKET)))
    meet = (1 - math.acos(THRESHOLD) / math.pi) ** bits
    tables = max(2, math.ceil(math.log(MISS) / math.log(1 - min(meet, 0.99))))
    edges, seed = None, 0
    while True:
        start = starting_lists(nodes, n, tables, bits, seed)
        lists = materialise(_lists(start if edges is None else start.union(edges)), "lists")
        links = lists.where(F.col("s") >= THRESHOLD).count()
        for _ in range(MAX_ROUNDS):
            lists = materialise(_lists(lists.union(refined(lists, nodes, groups))), "lists")
            before, links = links, lists.where(F.col("s") >= THRESHOLD).count()
            if links <= before:
                break
        found = lists.where(F.col("s") >= THRESHOLD).select("a", "b")
        roots = materialise(components(found), "roots")
        while roots.groupBy("root").count().where(F.col("count") > NEIGHBOURS).limit(1).count():
            bridges = materialise(_bridges(roots, nodes, n, tables, bits, seed), "bridges")
            if not bridges.limit(1).count():
                break
            found = found.union(bridges)
            roots = materialise(components(found), "roots")
        counts = materialise(_link_counts(roots, nodes, groups), "counts")
        seed += 1
        recall = _audited_recall(nodes, counts)
        if recall >= LEAST_RECALL or (seed >= 3 and recall >= REQUIRED_RECALL):
            break
        if seed == MAX_SEEDS:
            raise RuntimeError(f"only {recall:.3f} of the links were found")
        edges = lists
    by_node = copies.join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(counts.withColumnRenamed("vec_id", "rep"), "rep", "left")
    by_node = by_node.select(
        "h1", "h2", "d", F.coalesce("root", "rep").alias("root"), (F.coalesce("n_links", F.lit(0)) + F.col("m") - 1).alias("n_links")
    )
    by_vector = same.join(by_node, ["h1", "h2", "d"]).select("vec_id", "root", "n_links")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(by_vector, "vec_id", "left")
    component = F.coalesce("root", "vec_id")
    return rows.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )

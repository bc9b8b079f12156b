"""Prefix trie of conversations, rolled up by centroid decomposition.

1. Turns are numbered inside their conversation, conversations are rebuilt, and every prefix gets a
   128-bit key: the exclusive or of a hash of each depth and turn, combined over ranges of rows, so that
   neither a conversation with a third of all turns nor a very long one needs a task of its own.
2. Equal keys are one node, named by its smallest member and its depth. ``steps`` say at which node a
   conversation stands at each depth; one lookup there tells whether a node lies below another.
3. Rollup of the parent-edge forest: a component's centroid is the deepest node that still holds half of
   its weight (rows of members below it, which needs no rollup). The centroid's subtree total is added to
   every node on the path from it to the component's top; what is left falls apart into the part above
   and one component per child. Large components are split in rounds over Spark tables, as many as the
   logarithm of the rows; components of at most ``COMPONENT`` nodes are finished inside tasks, by the
   same method. A chain of any length so costs as few rounds as a star.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.llm.running import numbered
from lodgelens.session import materialise

#: Shared turns of a rebuilt conversation: fewer than this many.
SHARED = 6
FAMILY = 100
#: Nodes of a component that one task finishes.
COMPONENT = 20_000
#: Member ids joined before the last hash.
IDS_PER_BLOCK = 500

_NODE = ["conv_id", "depth"]


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth from 1, h1, h2, length) and conversations (conv_id, total) as rebuilt.

    h1 and h2 are hashes of role and text. Turns come by ``turn`` (null first), then role and hash.
    Rows without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text)
    hashed = rows.select(
        "conv_id", "turn", "role", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "role", "text").alias("h2"), F.length("text").alias("length")
    )
    turns = materialise(numbered(hashed, "conv_id", ["turn", "role", "h1", "h2"]).drop("turn", "role"), "turns")

    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = own.withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % SHARED, "base": base})
    sizes = own.select(F.col("conv_id").alias("base"), F.col("n").alias("_m"))
    shared = F.least("h", F.coalesce("_m", F.lit(0)))
    convs = convs.join(sizes, "base", "left").withColumn("shared", shared)
    total = F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = materialise(convs.select("conv_id", "base", "h", "shared", total.alias("total")), "conversations")

    heads = turns.where(F.col("pos") < SHARED - 1).withColumnRenamed("conv_id", "base")
    borrowed = convs.join(heads, "base").where("pos < h").withColumn("depth", F.col("pos") + 1)
    kept = turns.join(convs, "conv_id").where("pos >= h").withColumn("depth", F.col("pos") - F.col("h") + F.col("shared") + 1)
    columns = ["conv_id", "depth", "h1", "h2", "length", "total"]
    return borrowed.select(*columns).union(kept.select(*columns)), convs.select("conv_id", "total")


def trie(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, steps and conversations (conv_id, total) of the rebuilt conversations, all stored.

    Nodes: conv_id, depth, parent_conv_id, n_convs, n_children, length (of the last text) and w, the
    rows of all members from this depth on. Steps: of each conversation and depth (from 0) the node
    there (node) and its parent (above), both by their smallest member.
    """
    turns, convs = rebuilt_turns(conversations)
    x = {f"x{i}": F.xxhash64(F.lit(i), "depth", "h1", "h2") for i in (1, 2)}
    placed = turns.withColumns({**x, **{f"g{i}": x[f"x{i}"] for i in (1, 2)}}).drop("h1", "h2")
    paths = materialise(numbered(placed, "conv_id", ["depth"], ("g1", "g2")).drop("pos"), "paths")

    key = ["depth", "g1", "g2"]
    weight = F.sum(F.col("total") - F.col("depth") + 1).alias("w")
    found = materialise(
        paths.groupBy(*key).agg(
            F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("length").cast("long").alias("length"), weight
        ),
        "prefixes",
    )
    root = convs.agg(
        F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("length"), F.sum(F.col("total") + 1).alias("w")
    ).where("n_convs > 0")
    root = materialise(root.select(F.lit(0).cast("long").alias("depth"), "node", "n_convs", "length", "w"), "root")
    top = root.select("node").first()
    first = F.lit(top["node"] if top else None).cast("long")

    at = materialise(paths.join(found.select(*key, "node"), key).select("conv_id", "depth", "node"), "at")
    below = at.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("above"))
    steps = at.join(below, ["conv_id", "depth"], "left").withColumn("above", F.coalesce("above", first))
    start = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), first.alias("node"), F.lit(None).cast("long").alias("above"))
    steps = materialise(steps.select("conv_id", "depth", "node", "above").union(start), "steps")

    nodes = found.select("depth", "node", "n_convs", "length", "w").union(root)
    up = steps.select(F.col("conv_id").alias("node"), "depth", F.col("above").alias("parent_conv_id"))
    nodes = nodes.join(up, ["node", "depth"]).withColumnRenamed("node", "conv_id")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    nodes = nodes.join(children.agg(F.count("*").alias("n_children")), _NODE, "left")
    return materialise(nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes"), steps, convs


def centroid_sums(parent: list[int], values: list[tuple[int, ...]]) -> list[list[int]]:
    """Subtree sums of every node of a forest by centroid decomposition.

    ``parent`` gives each node's parent (-1 for a top); parents come before their children.
    """
    n, wide = len(parent), len(values[0]) if values else 0
    sums = [[0] * wide for _ in range(n)]
    size, part = [0] * n, [None] * n
    trees: dict[int, list[int]] = {}
    for u in range(n):
        size[u] = u if parent[u] < 0 else size[parent[u]]
        trees.setdefault(size[u], []).append(u)
    waiting = list(trees.values())
    while waiting:
        nodes = waiting.pop()
        top = nodes[0]
        for u in nodes:
            size[u] = 1
        for u in reversed(nodes[1:]):
            size[parent[u]] += size[u]
        centre = next(u for u in reversed(nodes) if 2 * size[u] >= len(nodes))
        above: list[int] = []
        pieces: list[list[int]] = []
        total = list(values[centre])
        for u in nodes:
            if u == centre:
                part[u] = None
                continue
            if u == top:
                part[u] = above
            elif parent[u] == centre:
                part[u] = []
                pieces.append(part[u])
            else:
                part[u] = part[parent[u]]
            part[u].append(u)
            if part[u] is not above:
                for i in range(wide):
                    total[i] += values[u][i]
        u = centre
        while True:
            for i in range(wide):
                sums[u][i] += total[i]
            if u == top:
                break
            u = parent[u]
        waiting += [p for p in (above, *pieces) if p]
    return sums


def _finish(values: list[str]):
    """Inside tasks: add the subtree sums of whole components to what their nodes hold."""

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["conv_id"].to_numpy(), table["depth"].to_numpy()))
        table = table.take(pa.array(order))
        columns = {c: table[c].to_pylist() for c in table.column_names}
        place = {key: i for i, key in enumerate(zip(columns["conv_id"], columns["depth"], strict=True))}
        parent = [
            -1 if (c, d) == (tc, td) else place[(p, d - 1)]
            for c, d, p, tc, td in zip(*(columns[x] for x in ("conv_id", "depth", "parent", "top", "top_depth")), strict=True)
        ]
        sums = centroid_sums(parent, list(zip(*(columns[v] for v in values), strict=True)))
        found = {v: [s[i] + more for s, more in zip(sums, columns[f"{v}_sum"], strict=True)] for i, v in enumerate(values)}
        return pa.table({"conv_id": columns["conv_id"], "depth": columns["depth"], **found}).cast(
            pa.schema([(c, pa.int64()) for c in ("conv_id", "depth", *values)])
        )

    return run


def rolled_up(nodes: DataFrame, steps: DataFrame, values: list[str]) -> DataFrame:
    """conv_id, depth and, for each of ``values`` (long columns of ``nodes``), its sum over the subtree."""
    spark = nodes.sparkSession
    root = nodes.where("depth = 0").select("conv_id").first()
    at = [F.lit(root["conv_id"] if root else None).cast("long").alias("top"), F.lit(0).cast("long").alias("top_depth")]
    zero = [F.lit(0).cast("long").alias(f"{v}_sum") for v in values]
    kept = ["conv_id", "depth", "parent", *values]
    open_nodes = nodes.withColumnRenamed("parent_conv_id", "parent").select(*kept, "w", *at, *zero)
    comp = ["top", "top_depth"]
    columns = open_nodes.columns
    ready, done = [], []
    while True:
        sizes = open_nodes.groupBy(*comp).agg(F.count("*").alias("_size"), F.max("w").alias("_all"))
        sizes = materialise(sizes, "components")
        small = open_nodes.join(sizes.where(F.col("_size") <= COMPONENT), comp).select(*columns)
        ready.append(small)
        large = sizes.where(F.col("_size") > COMPONENT)
        if not large.limit(1).count():
            break
        # The deepest node with half of the weight: those with half or more are a chain.
        held = open_nodes.join(large, comp)
        centre = held.where("2 * w >= _all").groupBy(*comp).agg(F.max(F.struct("depth", "conv_id", "w")).alias("_c"))
        centre = materialise(centre.select(*comp, F.col("_c.depth").alias("c_depth"), F.col("_c.conv_id").alias("c"), F.col("_c.w").alias("c_w")), "centres")
        # Nodes up to the centre's depth ask for the centre's step there, deeper ones for their own step below it.
        deep = F.col("depth") > F.col("c_depth")
        asked = open_nodes.join(centre, comp).withColumns(
            {"_conv": F.when(deep, F.col("conv_id")).otherwise(F.col("c")), "_depth": F.when(deep, F.col("c_depth") + 1).otherwise(F.col("depth"))}
        )
        looked = steps.select(F.col("conv_id").alias("_conv"), F.col("depth").alias("_depth"), "node", "above")
        marked = asked.join(looked, ["_conv", "_depth"], "left").withColumns(
            {
                "below": F.coalesce(deep & (F.col("above") == F.col("c")), F.lit(False)),
                "on_path": F.coalesce(~deep & (F.col("node") == F.col("conv_id")), F.lit(False)),
            }
        )
        marked = marked.withColumn("is_centre", F.col("on_path") & (F.col("depth") == F.col("c_depth")))
        marked = materialise(marked.drop("_conv", "_depth", "above"), "marked")
        totals = marked.where("below OR is_centre").groupBy(*comp).agg(*(F.sum(v).alias(f"{v}_total") for v in values))
        added = marked.join(totals, comp).withColumns(
            {f"{v}_sum": F.col(f"{v}_sum") + F.when(F.col("on_path"), F.col(f"{v}_total")).otherwise(0) for v in values}
        )
        added = materialise(
            added.withColumns(
                {
                    "w": F.col("w") - F.when(F.col("on_path"), F.col("c_w")).otherwise(0),
                    "top": F.when(F.col("below"), F.col("node")).otherwise(F.col("top")),
                    "top_depth": F.when(F.col("below"), F.col("c_depth") + 1).otherwise(F.col("top_depth")),
                }
            ).select(*columns, "is_centre"),
            "split",
        )
        done.append(added.where("is_centre").select(*_NODE, *(F.col(f"{v}_sum").alias(v) for v in values)))
        open_nodes = added.where("NOT is_centre").select(*columns)
    left = ready[0]
    for more in ready[1:]:
        left = left.union(more)
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes.count() // COMPONENT + 1)
    schema = ", ".join(f"{c} long" for c in (*_NODE, *values))
    binned = left.withColumn("_bin", F.pmod(F.xxhash64(*comp), F.lit(bins)))
    out = binned.groupBy("_bin").applyInArrow(_finish(values), schema)
    for more in done:
        out = out.union(more)
    return out


def ends_digests(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of the nodes at which a conversation ends.

    Ids are joined in blocks by many tasks; the last hash reads a node's blocks in order, one at a time.
    """
    ends = convs.withColumnRenamed("total", "depth").join(steps.select("conv_id", "depth", "node"), ["conv_id", "depth"])
    keyed = ends.select(F.struct(F.col("node").alias("conv_id"), "depth").alias("end"), "conv_id")
    placed = numbered(keyed, "end", ["conv_id"]).withColumn("block", F.floor(F.col("pos") / IDS_PER_BLOCK))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = placed.groupBy("end", "block").agg(ids.alias("ids")).select("end.conv_id", "end.depth", "block", "ids")

    def digest(batches):
        key, state = None, None

        def row():
            return pa.record_batch([pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], names=["conv_id", "depth", "ends_sha256"])

        for batch in batches:
            for conv, depth, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
                if key != (conv, depth):
                    if key:
                        yield row()
                    key, state = (conv, depth), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
        if key:
            yield row()

    dealt = blocks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "block")
    return dealt.mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` needs conv_id, turn, role and text; others are ignored. A null role or text is
    empty, a null turn comes first, equal turns come by role and then by a hash of the text, repeated
    rows are turns each. Rows with a null conv_id belong to no conversation. An empty table has no
    conversation and gives no rows, not even the root. Runs Spark jobs when called.
    """
    nodes, steps, convs = trie(conversations)
    own = nodes.withColumns(
        {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("length")}
    )
    sums = rolled_up(own, steps, ["n_leaves", "saved_tokens"])
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        nodes.join(sums, _NODE)
        .join(ends_digests(steps, convs), _NODE, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
        )
    )

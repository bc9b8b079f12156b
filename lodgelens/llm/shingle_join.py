"""Exact Jaccard join of documents on word shingles by trees over count vectors.

A document is the set of its distinct five-word shingles. Shingles are dealt by hash into groups,
so a set has a count per group, and the overlap of two sets is at most the sum over groups of the
smaller count. In so many dimensions the boxes of one tree over all documents would overlap
everywhere, so the tree's upper level is a partition that loses no pair:

* Two sets of sizes p <= q with similarity >= 0.8 differ in at most (p + q) / 9 <= p / 4 shingles.
  Each difference touches one group. A set occupies more groups than that, so linked sets agree
  on the whole content of some groups; a group's content is one *group key*.
* Group keys are dealt by hash in packed blocks, and those that occur in one text only are dropped.
  A set with too few shared group keys has no partner. The others keep their rarest keys (prefix
  filter: all but as many as may be missing), so common passages are not compared.
* Sets below one key form a small tree: leaves are runs of sets of one component and size, with a
  box of smallest and largest counts. Leaf pairs, then pairs, whose summed coordinate minima are too
  small go; survivors are verified on their shingles.

Equal sets are merged first. Sets of a key are first compared with one of them (the one with fewest
own keys), components are formed, and only pairs of different components are compared further, so a
large group of near copies costs a comparison per copy. Long keys are cut into chunks and the chunks
are paired, so a task holds a bounded number of sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgelens.llm.graph import components
from lodgelens.llm.words import mix, release_memory, shingles, slices
from lodgelens.session import materialise

WIDTH = 5
#: Groups of a set of the size class [L, 2L): GROUP_RATIO * 2L, enough for every set to occupy more
#: than a quarter of its size; below SINGLE shingles each is a group of its own.
GROUP_RATIO = 0.36
SINGLE = 64
_CONTENT = np.uint64(28)
#: Dimensions of the points in the trees.
DIMENSIONS = 256
LEAF = 32
CHUNK = 1024
#: Group keys per part of the packed exchange.
PART_KEYS = 500_000
#: Group keys that a task holds before it sends them.
BUFFER_KEYS = 250_000
#: Probes of an id in the bit set, as shifts of its hash.
PROBES = (0, 12, 24, 36)


def digests(found: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each set, the same for equal sets only; the first is even."""
    ends, sums = np.cumsum(n), []
    for salt in (0, 0x9E3779B97F4A7C15):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(found ^ np.uint64(salt)), dtype=np.uint64)])
        sums.append((total[ends] - total[ends - n]).view(np.int64))
    return [sums[0] & ~1, sums[1]]


def set_digests(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n (distinct shingles), a digest of the set, group keys it has.

    ``keys`` counts those of the set's own size class, ``keys_up`` those of the next one.
    """

    def digest(batches):
        for part in slices(batches):
            found, owner = shingles(part["text"], WIDTH)
            n = np.bincount(owner, minlength=len(part))
            _, own, up = group_keys(found, owner, n)
            keys = (np.bincount(own[up == u], minlength=len(part)) for u in (0, 1))
            yield pa.record_batch(
                [part["doc_id"].cast(pa.int64()), pa.array(n, pa.int64()), *map(pa.array, (*digests(found, n), *keys))],
                names=["doc_id", "n", "h1", "h2", "keys", "keys_up"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        digest, "doc_id long, n long, h1 long, h2 long, keys long, keys_up long"
    )


def allowed(n):
    """Shingles by which a set of this size may differ from a linked one."""
    return n // 4


def group_keys(found: np.ndarray, owner: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, document and class (0: the set's own, 1: the next) of every occupied group of every set.

    The class of a size in [2^k, 2^(k+1)) is k. A set whose size is within a quarter of the next
    class is grouped for that class too, so that linked sets meet in the class of the larger.
    """
    classes = np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1
    keys, owners, where = [], [], []
    for up in (0, 1):
        wanted = n > 0 if not up else (n > 0) & (n + allowed(n) >= 2 << classes)
        pick = wanted[owner]
        if not pick.any():
            continue
        own, value = owner[pick], found[pick]
        kind = (classes + up)[own]
        groups = np.where(2.0**kind < SINGLE, 2.0**20, np.ceil(GROUP_RATIO * 2.0 ** (kind + 1)))
        groups = np.minimum(groups, 2.0**22).astype(np.uint64)
        group = (mix(value ^ np.uint64(0x51ED2701)) >> np.uint64(20)) % groups
        # Owner (14 bits), group (22) and content (28) in one number: one plain sort.
        content = mix(value ^ np.uint64(0x2C1B)) >> np.uint64(36)
        packed = np.sort(own.astype(np.uint64) << np.uint64(50) | group << _CONTENT | content)
        place = packed >> _CONTENT
        own, group = (packed >> np.uint64(50)).astype(np.int64), place & np.uint64((1 << 22) - 1)
        kind = (classes + up)[own]
        at = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        total = np.add.reduceat(mix((packed & ((np.uint64(1) << _CONTENT) - np.uint64(1))) + np.uint64(1)), at)
        keys.append(mix(total + mix(group[at] * np.uint64(64) + kind[at].astype(np.uint64))))
        owners.append(own[at])
        where.append(np.full(len(at), up))
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(where)


def _packed_keys(docs: DataFrame, parts: int) -> DataFrame:
    """Group keys in blocks: part, 32 bits of each key, the keys of each owner in turn, the owners.

    An owner is the digest of a set, with its last bit set for keys of the next size class. Equal keys
    stay equal; of the ``PART_KEYS`` of a part about one in ten thousand meets another key by chance,
    which adds a candidate and loses none.
    """

    def send(held, owners):
        keys, place = (np.concatenate(x) for x in zip(*held, strict=True))
        owners = np.concatenate(owners)
        part = (keys % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part * len(owners) + place)
        part, keys, place = part[order], keys[order], place[order]
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        rows = []
        for s, e in zip(begin, np.append(begin[1:], len(part)), strict=True):
            names, held_by = np.unique(place[s:e], return_counts=True)
            low = (keys[s:e] >> np.uint64(32)).astype("<u4")
            kind = "<u1" if held_by.max() < 1 << 8 else "<u4"
            rows.append((int(part[s]), low.tobytes(), held_by.astype(kind).tobytes(), owners[names].tobytes()))
        for i in range(0, len(rows), 64):
            columns = list(zip(*rows[i : i + 64], strict=True))
            yield pa.record_batch(
                [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                names=["part", "keys", "held", "owners"],
            )

    def run(batches):
        held, owners, base, waiting = [], [], 0, 0
        for piece in slices(batches):
            found, owner = shingles(piece["text"], WIDTH)
            n = np.bincount(owner, minlength=len(piece))
            keys, own, up = group_keys(found, owner, n)
            names, place = np.unique(own * 2 + up, return_inverse=True)
            held.append((keys, place + base))
            owners.append(digests(found, n)[0][names // 2] | names % 2)
            base, waiting = base + len(names), waiting + len(keys)
            if waiting >= BUFFER_KEYS:
                yield from send(held, owners)
                held, owners, base, waiting = [], [], 0, 0
                release_memory()
        if waiting:
            yield from send(held, owners)

    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    return texts.mapInArrow(run, "part int, keys binary, held binary, owners binary")


def shared_keys(docs: DataFrame, parts: int) -> DataFrame:
    """Group keys of more than one set: key, owner (as in the blocks) and the number of sets.

    Equal sets are one owner here, so copies neither count nor multiply.
    """

    def repeated(batches):
        keys, places, owners, base, part = [], [], [], 0, []
        for batch in batches:
            for number, low, held, names in zip(*(batch[c] for c in ("part", "keys", "held", "owners")), strict=True):
                key = np.frombuffer(low.as_buffer(), "<u4").astype(np.uint64)
                keys.append(key | np.uint64(number.as_py()) << np.uint64(32))
                owners.append(np.frombuffer(names.as_buffer(), np.int64))
                own, count = len(owners[-1]), held.as_buffer()
                places.append(np.repeat(np.arange(base, base + own), np.frombuffer(count, "<u1" if count.size == own else "<u4")))
                base += own
        if not keys:
            return
        key, owner = np.concatenate(keys), np.concatenate(owners)
        keys.clear()
        order = np.argsort(key)
        ranked = key[order]
        same = ranked[1:] == ranked[:-1]
        kept = order[np.append(False, same) | np.append(same, False)]
        key, owner = key[kept], owner[np.concatenate(places)[kept]]
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        if not len(key):
            return
        new = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))
        key, owner = key[new], owner[new]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sets = np.diff(np.append(first, len(key)))
        number = np.repeat(sets, sets)
        key, owner, number = key[number > 1], owner[number > 1], number[number > 1]
        for i in range(0, len(key), 200_000):
            to = slice(i, i + 200_000)
            yield pa.record_batch(
                [pa.array(key[to].view(np.int64)), pa.array(owner[to]), pa.array(number[to])], names=["key", "owner", "sets"]
            )
        del key, owner, number, kept, order, ranked, same
        release_memory()

    packed = _packed_keys(docs, parts)
    return packed.repartition(parts, "part").mapInArrow(repeated, "key long, owner long, sets long")


def _id_bits(ids: DataFrame) -> tuple[int, np.ndarray]:
    """A bit set of hashed ids, at most 2^26 bits (8 MB) whatever the number of ids.

    Ten to twenty bits per id, of which ``PROBES`` sets some; with more ids it only lets more rows through.
    """
    bits = 1 << min(26, max(16, (10 * ids.count()).bit_length()))
    hashed = F.xxhash64(F.col("doc_id").cast("long"))
    words = (
        ids.select(F.explode(F.array(*(F.shiftright(hashed, s).bitwiseAND(F.lit(bits - 1)) for s in PROBES))).alias("p"))
        .groupBy(F.shiftright("p", 5).alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(p & 31 as int)))").alias("b"))
    )
    held = np.zeros(bits // 32, np.uint32)
    for row in words.toLocalIterator():
        held[row["w"]] = row["b"]
    return bits, held


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, h1, n, values (distinct shingles) and counts (the point) of the documents in ``ids``.

    A bit set keeps most other texts from being cut into shingles; the join is exact.
    """
    bits, held = _id_bits(ids)
    words = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        def wanted():
            for batch in batches:
                inside = np.ones(len(batch), bool)
                for shift in PROBES:
                    place = batch["p"].to_numpy() >> shift & bits - 1
                    inside &= words.value[place >> 5] >> (place & 31).astype(np.uint32) & 1 == 1
                yield batch.filter(pa.array(inside))

        for part in slices(wanted()):
            found, owner = shingles(part["text"], WIDTH)
            n = np.bincount(owner, minlength=len(part))
            at = np.concatenate([[0], np.cumsum(n)])
            group = (mix(found ^ np.uint64(0x7A3D)) >> np.uint64(11)).astype(np.int64) % DIMENSIONS
            counts = np.bincount(owner * DIMENSIONS + group, minlength=len(part) * DIMENSIONS)
            yield pa.record_batch(
                [
                    part["doc_id"].cast(pa.int64()),
                    pa.array(digests(found, n)[0]),
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found.view(np.int64))),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(part) + 1) * DIMENSIONS, pa.int32()), pa.array(counts.astype(np.int32))
                    ),
                ],
                names=["doc_id", "h1", "n", "values", "counts"],
            )

    placed = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64(F.col("doc_id").cast("long")).alias("p"))
    sets = placed.mapInArrow(run, "doc_id long, h1 long, n long, values array<long>, counts array<int>")
    # An id of ``ids`` has one digest: repeats of a row are dropped where the join left them, without an exchange.
    return sets.join(ids, ["doc_id", "h1"], "left_semi").dropDuplicates(["doc_id", "h1"])


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with similarity 0.8 or more: first by the bound of their points, then exactly."""
    points = sets.select("doc_id", "n", "counts")
    bounded = (
        pairs.join(points.toDF("a", "n_a", "counts_a"), "a")
        .join(points.toDF("b", "n_b", "counts_b"), "b")
        .where("9 * aggregate(zip_with(counts_a, counts_b, (x, y) -> least(x, y)), 0, (s, x) -> s + x) >= 4 * (n_a + n_b)")
        .select("a", "b", "n_a", "n_b")
    )
    values = sets.select("doc_id", "values")
    return (
        bounded.join(values.toDF("b", "values_b"), "b")
        .join(values.toDF("a", "values_a"), "a")
        .where("9 * size(array_intersect(values_a, values_b)) >= 4 * (n_a + n_b)")
        .select("a", "b")
    )


def tree_pairs(left: dict[str, np.ndarray], right: dict[str, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions whose summed coordinate minima allow a similarity of 0.8.

    Each side holds root, n and counts. Points are sorted by root and size and cut into leaves with
    boxes; leaf pairs go by the bound of their boxes, then pairs by their own. Pairs of one root
    are left out. ``right`` None: pairs within ``left``.
    """

    def leaves(side):
        order = np.lexsort((side["n"], side["root"]))
        starts = np.arange(0, len(order), LEAF)
        c, n, r = side["counts"][order], side["n"][order], side["root"][order]
        top = np.maximum.reduceat(c, starts, axis=0)
        ends = np.append(starts[1:], len(order))
        # Rows are sorted by root: a leaf whose first and last root are equal holds that root only.
        return order, starts, ends, c, n, r, top, np.minimum.reduceat(n, starts), r[starts], r[starts] == r[ends - 1]

    a = leaves(left)
    b = a if right is None else leaves(right)
    found_a, found_b = [], []
    for i in range(len(a[1])):
        bound = np.minimum(a[6][i], b[6]).sum(axis=1)
        same = a[9][i] & b[9] & (a[8][i] == b[8])
        fits = (9 * bound >= 4 * (a[7][i] + b[7])) & ~same
        if right is None:
            fits[:i] = False
        rows = slice(a[1][i], a[2][i])
        for j in np.flatnonzero(fits):
            columns = slice(b[1][j], b[2][j])
            least = np.minimum(a[3][rows][:, None, :], b[3][columns][None, :, :]).sum(axis=2)
            near = (9 * least >= 4 * (a[4][rows][:, None] + b[4][columns][None, :])) & (
                a[5][rows][:, None] != b[5][columns][None, :]
            )
            x, y = np.nonzero(near)
            x, y = a[0][rows][x], b[0][columns][y]
            if right is None and i == j:
                x, y = x[x < y], y[x < y]
            found_a.append(x)
            found_b.append(y)
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def _different_blocks(blocks: DataFrame) -> DataFrame:
    """One key of those that have the same sets (by two 64-bit sums), without keys of one set."""
    member = [F.xxhash64("doc_id"), F.xxhash64("doc_id", F.lit(1))]
    whole = blocks.groupBy("key").agg(F.count("*").alias("many"), *(F.bit_xor(m).alias(f"x{i}") for i, m in enumerate(member)))
    kept = whole.where("many > 1").groupBy("many", "x0", "x1").agg(F.min("key").alias("key")).select("key")
    return blocks.join(kept, "key")


def _tree_candidates(blocks: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of different components below one key, by a tree per pair of chunks."""
    sizes = blocks.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    chunked = blocks.join(sizes, "key").withColumn("chunk", F.pmod(F.hash("doc_id"), F.col("chunks")))
    others = F.sequence(F.lit(0), F.col("chunks") - 1)
    paired = chunked.withColumn("other", F.explode(others)).select(
        "key",
        F.least("chunk", "other").alias("i"),
        F.greatest("chunk", "other").alias("j"),
        F.col("chunk"),
        "doc_id",
        "root",
        "n",
        "counts",
    )

    def search(table: pa.Table) -> pa.Table:
        chunk = table["chunk"].to_numpy()
        ids = table["doc_id"].to_numpy()
        counts = table["counts"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        root, n = table["root"].to_numpy(), table["n"].to_numpy()
        side = lambda at: {"root": root[at], "n": n[at], "counts": counts[at]}
        low, high = np.flatnonzero(chunk == chunk.min()), np.flatnonzero(chunk != chunk.min())
        if table["i"][0] == table["j"][0]:
            x, y = tree_pairs(side(low), None)
            one, two = ids[low][x], ids[low][y]
        elif len(high):
            x, y = tree_pairs(side(low), side(high))
            one, two = ids[low][x], ids[high][y]
        else:
            one = two = np.empty(0, np.int64)
        return pa.table({"a": np.minimum(one, two), "b": np.maximum(one, two)})

    return paired.groupBy("key", "i", "j").applyInArrow(search, "a long, b long").distinct()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, class_id.

    ``component_id`` is the smallest doc_id reachable by links (100 * intersection >= 80 * union),
    ``class_id`` the smallest doc_id with an equal set. Null and empty texts have no shingles and
    only themselves. Rows that share a doc_id are one node: the one with the largest (n, digest)
    links, all get its component. A null doc_id links with nothing and has a null component.
    Other columns are ignored; an empty table gives no rows. Runs Spark jobs when called.
    """
    spark = docs.sparkSession
    rows = materialise(set_digests(docs), "digests")
    whole = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.struct("n", "h1", "h2", "keys", "keys_up")).alias("s"))
    nodes = whole.select("doc_id", "s.*").where("n > 0")
    classes = nodes.groupBy("n", "h1", "h2", "keys", "keys_up").agg(F.min("doc_id").alias("rep"))
    classes = materialise(classes, "classes")
    total = rows.agg(F.coalesce(F.sum(F.col("keys") + F.col("keys_up")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_KEYS + 1)

    # Keys of one set are dropped in the exchange's tasks; the rest learn which set they belong to.
    up = F.col("owner").bitwiseAND(1)
    shared = shared_keys(docs, parts).withColumn("up", up).withColumn("h1", F.col("owner") - up)
    shared = shared.join(classes.withColumnRenamed("rep", "doc_id"), "h1")
    shared = shared.withColumn("total", F.when(F.col("up") == 1, F.col("keys_up")).otherwise(F.col("keys")))
    own = Window.partitionBy("doc_id", "up")
    lacking = shared.withColumn("alone", F.col("total") - F.count("*").over(own)).where("alone <= n div 4")
    rarest = lacking.withColumn("_r", F.row_number().over(own.orderBy("sets", "key"))).where("_r <= n div 4 + 1 - alone")
    prefix = rarest.select("key", "doc_id", "h1", "n", (F.col("alone") / F.col("total")).alias("own"))
    blocks = materialise(_different_blocks(materialise(prefix, "blocks")), "blocks")
    ids = materialise(blocks.select("doc_id", "h1").distinct(), "ids")
    sets = materialise(sets_of(docs, ids), "sets")

    # One set of each key against the others.
    pivots = blocks.groupBy("key").agg(F.min(F.struct("own", "doc_id", "n")).alias("p"))
    star = (
        blocks.join(pivots, "key")
        .where("doc_id <> p.doc_id AND 5 * least(n, p.n) >= 4 * greatest(n, p.n)")
        .select(F.least("doc_id", "p.doc_id").alias("a"), F.greatest("doc_id", "p.doc_id").alias("b"))
        .distinct()
    )
    tested = materialise(star, "star")
    links = materialise(_linked(tested, sets), "links")
    roots = components(links)

    # Below each key, the components that are still apart.
    placed = blocks.join(roots.toDF("doc_id", "_root"), "doc_id", "left").withColumn("root", F.coalesce("_root", "doc_id"))
    # Keys with the same least component share a tree, so a pair is found once and not once per key.
    apart = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    open_rows = placed.join(apart, "key").select(F.col("lo").alias("key"), "doc_id", "root").distinct()
    points = sets.select("doc_id", "n", "counts")
    more = _tree_candidates(open_rows.join(points, "doc_id")).join(tested, ["a", "b"], "left_anti")
    links = materialise(links.union(_linked(materialise(more, "more"), sets)), "links")

    roots = components(links)
    by_rep = classes.join(roots.toDF("rep", "root"), "rep", "left")
    found = nodes.join(by_rep, ["n", "h1", "h2"]).select(
        "doc_id", F.coalesce("root", "rep").alias("component_id"), F.col("rep").alias("class_id")
    )
    return rows.join(found, "doc_id", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
    )

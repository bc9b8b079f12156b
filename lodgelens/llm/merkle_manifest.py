"""Merkle manifest of a document table, kept as a tree of SHA-256 midstates.

A parent's digest is the hash of its children's digests as hex text. Such a digest is 64 bytes, one
block of SHA-256, so the hash state before each child slot is a chaining value of eight words. The
manifest retains these states next to the digests. To replace a child, its slot's state is resumed
with the replacement and the siblings to the right only; nothing to the left is read again.

Leaves are numbered inside their language by ranges (``running.numbered``). Runs of ``RUN`` leaves,
four levels of eight, become one packed row; their tops are the entries of the next round, so the
number of rounds is the logarithm of the leaves to base 4,096 and every group holds at most ``RUN``
entries. Languages' subroots go through the same rounds. Paths (states and siblings of the steps
above a run) come down again, one row per run.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgelens.llm.running import numbered
from lodgelens.llm.words import release_memory
from lodgelens.session import materialise

FANOUT = 8
#: Levels and entries of one packed row.
LEVELS = 4
RUN = FANOUT**LEVELS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _primes(count: int) -> list[int]:
    found: list[int] = []
    n = 2
    while len(found) < count:
        if all(n % p for p in found):
            found.append(n)
        n += 1
    return found


def _root_bits(n: int, power: int) -> int:
    """First 32 bits of the fractional part of the ``power``-th root of ``n``."""
    scaled, low, high = n << (32 * power), 0, 1 << 40
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**power <= scaled else (low, middle - 1)
    return low & 0xFFFFFFFF


#: SHA-256's own constants: fractional parts of the roots of the first primes.
_ROUND = np.array([_root_bits(p, 3) for p in _primes(64)], np.uint32)
START = np.array([_root_bits(p, 2) for p in _primes(8)], np.uint32)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def compress(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """SHA-256 states (n, 8) after one block of sixteen words each (n, 16)."""
    w = list(blocks.T.copy())
    a, b, c, d, e, f, g, h = states.T.copy()
    for i in range(64):
        if i >= 16:
            x, y = w[i - 15], w[i - 2]
            low = _turned(x, 7) ^ _turned(x, 18) ^ (x >> np.uint32(3))
            w.append(w[i - 16] + low + w[i - 7] + (_turned(y, 17) ^ _turned(y, 19) ^ (y >> np.uint32(10))))
        one = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + ((e & f) ^ (~e & g)) + _ROUND[i] + w[i]
        two = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return states + np.stack([a, b, c, d, e, f, g, h], axis=1)


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def hex_blocks(digests: np.ndarray) -> np.ndarray:
    """Digests (n, 32 bytes) as hex text, one block (16 words) each."""
    text = np.stack([_HEX[digests >> 4], _HEX[digests & 15]], axis=2).reshape(len(digests), 64)
    return np.ascontiguousarray(text).view(">u4").astype(np.uint32)


def finished(states: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Digests (n, 32 bytes) of nodes that have absorbed so many children each."""
    last = np.zeros((len(states), 16), np.uint32)
    last[:, 0] = 0x80000000
    last[:, 15] = children.astype(np.uint32) * np.uint32(512)
    return compress(states, last).astype(">u4").view(np.uint8).reshape(len(states), 32)


def midstate_levels(digests: np.ndarray, levels: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Digests of each level from the given one up, and the state before each child below the top."""
    nodes, states = [digests], []
    for _ in range(levels):
        child = nodes[-1]
        parents = -(-len(child) // FANOUT)
        count = np.minimum(FANOUT, len(child) - FANOUT * np.arange(parents))
        blocks = hex_blocks(child)
        now = np.repeat(START[None, :], parents, axis=0)
        before = np.empty((len(child), 8), np.uint32)
        for slot in range(FANOUT):
            has = np.flatnonzero(count > slot)
            before[has * FANOUT + slot] = now[has]
            now[has] = compress(now[has], blocks[has * FANOUT + slot])
        states.append(before)
        nodes.append(finished(now, count))
    return nodes, states


def fold_run(replaced: np.ndarray, nodes: list[np.ndarray], states: list[np.ndarray]) -> np.ndarray:
    """Top digest of a run for each leaf on its own being replaced (n, 32 bytes)."""
    now, at = replaced, np.arange(len(replaced))
    for level, before in enumerate(states):
        blocks = hex_blocks(nodes[level])
        slot, parent = at % FANOUT, at // FANOUT
        count = np.minimum(FANOUT, len(nodes[level]) - FANOUT * parent)
        state = compress(before[at], hex_blocks(now))
        for step in range(1, FANOUT):
            more = np.flatnonzero(slot + step < count)
            if len(more):
                state[more] = compress(state[more], blocks[at[more] + step])
        now, at = finished(state, count), parent
    return now


def _step(nodes: np.ndarray, states: np.ndarray, at: int) -> bytes:
    """One step of a path: slot, children, the state before the slot and the siblings."""
    first = at // FANOUT * FANOUT
    end = min(first + FANOUT, len(nodes))
    siblings = nodes[first:at].tobytes() + nodes[at + 1 : end].tobytes()
    return struct.pack("<II", at - first, end - first) + states[at].tobytes() + siblings


def _steps(path: bytes):
    """Slot, children, state and siblings of each step."""
    at = 0
    while at < len(path):
        slot, children = struct.unpack_from("<II", path, at)
        state = np.frombuffer(path, np.uint32, 8, at + 8)
        siblings = np.frombuffer(path, np.uint8, 32 * (children - 1), at + 40).reshape(-1, 32)
        yield slot, children, state, siblings
        at += 40 + 32 * (children - 1)


def fold_path(tops: np.ndarray, path: bytes) -> np.ndarray:
    """Root digest for each top (n, 32 bytes) put below ``path``."""
    for slot, children, state, siblings in _steps(path):
        now = compress(np.repeat(state[None, :], len(tops), axis=0), hex_blocks(tops))
        for block in hex_blocks(siblings[slot:]):
            now = compress(now, np.repeat(block[None, :], len(now), axis=0))
        tops = finished(now, np.full(len(now), children))
    return tops


def _rows_of(batch: pa.RecordBatch):
    """Packed rows one at a time: each holds thousands of leaves, as Python objects many times its size."""
    for at in range(batch.num_rows):
        yield batch.slice(at, 1).to_pylist()[0]
    release_memory()


_PACKED = "g string, chunk long, k int, n int, digests binary, states binary, top binary"


def _pack(entries: DataFrame, done: int) -> DataFrame:
    """One row per run of ``RUN`` entries (g, pos, digest, depth): all digests and states below its top.

    ``doc_id`` and ``changed`` of entries that are leaves stay with them.
    """
    leaves = "changed" in entries.columns
    run, levels = RUN, LEVELS

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        digests = np.frombuffer(b"".join(table["digest"].to_pylist()), np.uint8).reshape(-1, 32)
        k = max(0, min(levels, table["depth"][0].as_py() - done))
        nodes, states = midstate_levels(digests, k)
        columns = {
            "g": pa.array([table["g"][0].as_py()], pa.string()),
            "chunk": pa.array([table["pos"][0].as_py() // run], pa.int64()),
            "k": pa.array([k], pa.int32()),
            "n": pa.array([len(digests)], pa.int32()),
            "digests": pa.array([b"".join(x.tobytes() for x in nodes[: max(k, 1)])], pa.binary()),
            "states": pa.array([b"".join(x.tobytes() for x in states)], pa.binary()),
            "top": pa.array([nodes[-1][0].tobytes()], pa.binary()),
        }
        if leaves:
            columns["doc_id"] = pa.array([table["doc_id"].to_pylist()], pa.list_(pa.int64()))
            columns["changed"] = pa.array([b"".join(table["changed"].to_pylist())], pa.binary())
        release_memory()
        return pa.table(columns)

    schema = _PACKED + (", doc_id array<long>, changed binary" if leaves else "")
    kept = ["g", "pos", "digest", "depth", *(["doc_id", "changed"] if leaves else [])]
    keyed = entries.select(*kept, F.floor(F.col("pos") / RUN).alias("_c"))
    # Runs are few bytes and much work: a fixed count keeps AQE from putting them into one task.
    tasks = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(tasks, "g", "_c").groupBy("g", "_c").applyInArrow(build, schema)


def _unpacked(row: dict) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Digests and states of each level of a packed row."""
    digests = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
    kept = np.frombuffer(row["states"], np.uint32).reshape(-1, 8)
    nodes, states, size, at = [], [], row["n"], 0
    for _ in range(row["k"]):
        nodes.append(digests[at : at + size])
        states.append(kept[at : at + size])
        at, size = at + size, -(-size // FANOUT)
    return nodes or [digests], states


def midstate_tree(entries: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The manifest's rounds, lowest first, and the top digest of each group: g, digest.

    ``entries`` hold g, pos (from 0 in each group) and digest. Each round is a stored table of packed
    rows; ``depth`` of a group comes from its number of entries.
    """
    sizes = entries.groupBy("g").agg(F.count("*").alias("n"))
    # Levels between n nodes and one: how many powers of eight are below n.
    depth = sum((F.col("n") > FANOUT**i).cast("int") for i in range(21))
    sizes = materialise(sizes.select("g", depth.alias("depth")), "depths")
    deepest = sizes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    rounds, now = [], entries
    for done in range(0, max(deepest, 1), LEVELS):
        rounds.append(materialise(_pack(now.join(sizes, "g"), done), "packed"))
        now = rounds[-1].join(sizes, "g").where(F.col("depth") > done + LEVELS)
        now = now.select("g", F.col("chunk").alias("pos"), F.col("top").alias("digest"))
    tops = [
        p.join(sizes, "g").where((F.col("depth") <= done + LEVELS) & ((F.col("depth") > done) | F.lit(done == 0))).select("g", F.col("top").alias("digest"))
        for done, p in zip(range(0, max(deepest, 1), LEVELS), rounds, strict=True)
    ]
    top = tops[0]
    for t in tops[1:]:
        top = top.union(t)
    return rounds, top


def _with_paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest round's rows with the ``path`` from their top to the root, and what ``above`` holds.

    ``above`` has one row per group: g, path (of its top) and further columns that are handed down.
    """
    run, held = RUN, None  # paths of the tops of the round below, by group and run
    for i in reversed(range(len(rounds))):
        packed = rounds[i]
        here = packed.join(above, "g")
        if held is not None:
            # A run below the top of its group gets its path from the round above.
            here = here.join(held.withColumnRenamed("path", "_path"), ["g", "chunk"], "left").withColumn("path", F.coalesce("_path", "path")).drop("_path")
        if not i:
            return here

        def expand(batches):
            for batch in batches:
                for row in _rows_of(batch):
                    nodes, states = _unpacked(row)
                    paths = [
                        b"".join(_step(nodes[level], states[level], at // FANOUT**level) for level in range(row["k"])) + row["path"]
                        for at in range(row["n"])
                    ]
                    first = row["chunk"] * run
                    yield pa.record_batch(
                        [
                            pa.array([row["g"]] * len(paths), pa.string()),
                            pa.array(range(first, first + len(paths)), pa.int64()),
                            pa.array(paths, pa.binary()),
                        ],
                        names=["g", "chunk", "path"],
                    )

        held = materialise(here.select("g", "chunk", "k", "n", "digests", "states", "path").mapInArrow(expand, "g string, chunk long, path binary"), "paths")
    raise ValueError("no rounds")


def _proofs(batches):
    """Per leaf of packed rows: its digest, proof and folded root."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    for batch in batches:
        for row in _rows_of(batch):
            nodes, states = _unpacked(row)
            n, root = row["n"], row["root"]
            above = b"".join(siblings.tobytes() for _, _, _, siblings in _steps(row["path"])).hex()
            text = [x.tobytes().hex() for x in nodes]
            proofs = []
            for at in range(n):
                parts, here = [], at
                for level in range(row["k"]):
                    first = here // FANOUT * FANOUT
                    parts += [text[level][64 * first : 64 * here], text[level][64 * here + 64 : 64 * (first + FANOUT)]]
                    here //= FANOUT
                proofs.append(hashlib.sha256(("".join(parts) + above).encode()).hexdigest())
            replaced = np.frombuffer(row["changed"], np.uint8).reshape(-1, 32)
            # Leaves that were not replaced reach the same top: each different top climbs once.
            tops, which = np.unique(fold_run(replaced, nodes, states), axis=0, return_inverse=True)
            roots = [x.tobytes().hex() for x in fold_path(tops, row["path"])]
            folded = [roots[i] for i in which.ravel().tolist()]
            wanted = root.hex()
            columns = [
                pa.array(row["doc_id"], pa.int64()),
                pa.array([text[0][64 * i : 64 * i + 64] for i in range(n)]),
                pa.array([row["subroot"].hex()] * n),
                pa.array([wanted] * n),
                pa.array(proofs),
                pa.array(folded),
                pa.array([f == wanted for f in folded]),
            ]
            yield pa.record_batch(columns, names=names)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 (32 bytes) of the fields of one row."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """g (language key: empty for null, else ``v`` and the language), doc_id, digest, changed.

    ``changed`` is the leaf of the row as tampered with: where 3 divides the unsigned crc32 of the
    decimal doc_id, A-Z of the text become a-z; else, and for a null doc_id, the leaf itself.
    """
    def of(text: Column) -> Column:
        return leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    return docs.select(
        F.coalesce(F.concat(F.lit("v"), F.col("lang")), F.lit("")).alias("g"),
        F.col("doc_id").cast("long").alias("doc_id"),
        of(F.col("text")).alias("digest"),
        F.when(tampered, of(F.translate("text", _UPPER, _LOWER))).alias("changed"),
    ).withColumn("changed", F.coalesce("changed", "digest"))


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``docs`` needs doc_id, source, lang, n_chars and text; others are ignored. Null and empty values
    differ (``-`` and ``0:``). Null doc_ids come first, rows that share a doc_id in the order of their
    leaves, repeated rows are leaves each. An empty table gives no rows. Runs Spark jobs when called.
    """
    stored = materialise(leaves(docs), "leaves")
    rounds, subroots = midstate_tree(numbered(stored, "g", ["doc_id", "digest"]))
    subroots = materialise(subroots, "subroots")
    # Languages in order are the leaves of one more tree.
    named = subroots.select(F.lit("").alias("all"), F.col("g").alias("lang"), "digest")
    entries = numbered(named, "all", ["lang"]).withColumnRenamed("all", "g")
    top_rounds, root = midstate_tree(entries)
    start = root.select("g", F.col("digest").alias("root"), F.lit("").cast("binary").alias("path"))
    lowest = _with_paths(top_rounds, start)
    run = RUN

    def expand(batches):
        for batch in batches:
            for row in _rows_of(batch):
                nodes, states = _unpacked(row)
                first = row["chunk"] * run
                for at in range(row["n"]):
                    path = b"".join(_step(nodes[level], states[level], at // FANOUT**level) for level in range(row["k"]))
                    yield pa.record_batch(
                        [pa.array([first + at], pa.int64()), pa.array([path + row["path"]], pa.binary()), pa.array([row["root"]], pa.binary())],
                        names=["pos", "path", "root"],
                    )

    climbs = lowest.mapInArrow(expand, "pos long, path binary, root binary")
    above = entries.join(climbs, "pos").select(F.col("lang").alias("g"), "path", F.col("digest").alias("subroot"), "root")
    found = _with_paths(rounds, materialise(above, "above"))
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    kept = ["k", "n", "digests", "states", "doc_id", "changed", "path", "subroot", "root"]
    return found.select(*kept).mapInArrow(_proofs, schema)

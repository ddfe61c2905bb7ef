"""Op 12. A SHA-256 tree over a dataset's rows whose parents keep copied hash states."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import shuffle_partitions
from newsloom.session import materialize

FANOUT = 2
LEVELS = 12  # of the tree, that one task works on at a time: blocks of fanout ** levels nodes


def _fraction(prime: int, root: int) -> int:
    """The first 32 bits behind the point of a prime's square or cube root."""
    value = prime << 32 * root
    low, high = 0, 1 << 40
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if mid ** root <= value else (low, mid)
    return low & 0xFFFFFFFF


_PRIMES = [p for p in range(2, 312) if all(p % d for d in range(2, math.isqrt(p) + 1))]
START = np.array([_fraction(p, 2) for p in _PRIMES[:8]], np.uint32)
_ROUND = [np.uint32(_fraction(p, 3)) for p in _PRIMES]
_NIBBLES = np.arange(1 << 16, dtype=np.uint32)[:, None] >> np.array([12, 8, 4, 0], np.uint32) & 15
_HEX = ((_NIBBLES + 48 + 39 * (_NIBBLES > 9)).astype(np.uint32)
        << np.array([24, 16, 8, 0], np.uint32)).sum(axis=1).astype(np.uint32)


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return x >> np.uint32(bits) | x << np.uint32(32 - bits)


def absorb(states: np.ndarray, block: np.ndarray) -> np.ndarray:
    """SHA-256 states (8, n) after one more 64-byte block each, given as words (16, n)."""
    words = list(block)
    a, b, c, d, e, f, g, h = states
    for k in range(64):
        if k >= 16:
            x, y = words[k - 15], words[k - 2]
            words.append(words[k - 16] + words[k - 7]
                         + (_turn(x, 7) ^ _turn(x, 18) ^ x >> np.uint32(3))
                         + (_turn(y, 17) ^ _turn(y, 19) ^ y >> np.uint32(10)))
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ e & (f ^ g)) + _ROUND[k] + words[k]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + (a & b | c & (a | b))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return states + np.stack((a, b, c, d, e, f, g, h))


def hex_block(digests: np.ndarray) -> np.ndarray:
    """Digests (8, n) as the 64 characters of their hexadecimal text, in words (16, n)."""
    out = np.empty((16, digests.shape[1]), np.uint32)
    out[0::2], out[1::2] = _HEX[digests >> np.uint32(16)], _HEX[digests & np.uint32(0xFFFF)]
    return out


def finish(states: np.ndarray, blocks: np.ndarray | int) -> np.ndarray:
    """Digests of messages that end after so many whole blocks."""
    last = np.zeros((16, states.shape[1]), np.uint32)
    last[0], last[15] = 0x80000000, np.asarray(blocks, np.uint32) * 512
    return absorb(states, last)


def fresh(count: int) -> np.ndarray:
    return np.repeat(START[:, None], count, axis=1)


def to_bytes(digests: np.ndarray) -> bytes:
    return np.ascontiguousarray(digests.T).astype(">u4").tobytes()


def from_bytes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, ">u4").reshape(-1, 8).T).astype(np.uint32)


def _stack(values: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return from_bytes(b"".join(values.to_pylist()))


def _binary(digests: np.ndarray) -> pa.Array:
    raw = to_bytes(digests)
    return pa.array([raw[k:k + 32] for k in range(0, len(raw), 32)], pa.binary())


class Block:
    """A piece of the tree: the digests of each level and, for each parent, the state before each
    child slot."""

    def __init__(self, leaves: np.ndarray, height: int, fanout: int):
        self.fanout, self.levels, self.states = fanout, [leaves], []
        for _ in range(height):
            below = self.levels[-1]
            count = -(-below.shape[1] // fanout)
            state, kept = fresh(count), np.empty((fanout, 8, count), np.uint32)
            for slot in range(fanout):
                kept[slot] = state
                children = below[:, slot::fanout]
                have = children.shape[1]
                state[:, :have] = absorb(state[:, :have], hex_block(children))
            self.states.append(kept)
            self.levels.append(finish(state, self._sizes(len(self.levels) - 1, np.arange(count))))

    def _sizes(self, level: int, parents: np.ndarray) -> np.ndarray:
        return np.minimum(self.fanout, self.levels[level].shape[1] - parents * self.fanout)

    def packed(self) -> tuple[bytes, bytes]:
        return (b"".join(map(to_bytes, self.levels)),
                b"".join(to_bytes(s[k]) for s in self.states for k in range(self.fanout)))

    @classmethod
    def unpacked(cls, count: int, height: int, fanout: int, digests: bytes, states: bytes) -> Block:
        out = cls.__new__(cls)
        out.fanout, out.levels, out.states = fanout, [], []
        nodes, kept, a, b = from_bytes(digests), from_bytes(states), 0, 0
        for level in range(height + 1):
            out.levels.append(nodes[:, a:a + count])
            a, count = a + count, -(-count // fanout)
            if level < height:
                part = kept[:, b:b + fanout * count].reshape(8, fanout, count)
                out.states.append(part.transpose(1, 0, 2))
                b += fanout * count
        return out

    def steps(self, at: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """For leaves: each level's (slot, children, state before the slot, all children)."""
        out = []
        for level, states in enumerate(self.states):
            parent, slot = at // self.fanout, at % self.fanout
            nodes = self.levels[level]
            children = [nodes[:, np.minimum(parent * self.fanout + k, nodes.shape[1] - 1)]
                        for k in range(self.fanout)]
            out.append((slot, self._sizes(level, parent), states[slot, :, parent].T, children))
            at = parent
        return out


def climb(steps, value: np.ndarray, proof: np.ndarray, taken: np.ndarray):
    """Fold replaced digests along their steps: (digests, proof states, siblings so far).

    At each parent the kept state before the slot resumes with the replacement and the right
    siblings only. The siblings themselves, left to right, go into the proof's state.
    """
    proof = proof.copy()
    for slot, size, state, children in steps:
        state = state.copy()
        for k, child in enumerate(children):
            mine, there = slot == k, k < size
            go, other = mine | (there & (k > slot)), there & ~mine
            words = hex_block(np.where(mine, value, child))
            if go.any():
                state[:, go] = absorb(state[:, go], words[:, go])
            if other.any():
                proof[:, other] = absorb(proof[:, other], words[:, other])
        value, taken = finish(state, size), taken + size - 1
    return value, proof, taken


def _step_size(fanout: int) -> int:
    return 2 + 32 * (fanout + 1)


def _pack_steps(steps, count: int) -> list[bytes]:
    """Each leaf's steps as bytes: slot, number of children, state, all children."""
    out = [[] for _ in range(count)]
    for slot, size, state, children in steps:
        parts = [to_bytes(x) for x in (state, *children)]
        for k in range(count):
            out[k].append(bytes((int(slot[k]), int(size[k])))
                          + b"".join(p[32 * k:32 * k + 32] for p in parts))
    return [b"".join(parts) for parts in out]


def _unpack_steps(raw: bytes, fanout: int, count: int):
    """Steps that ``count`` rows share."""
    wide = _step_size(fanout)
    for at in range(0, len(raw), wide):
        slot, size = raw[at], raw[at + 1]
        nodes = from_bytes(raw[at + 2:at + wide])
        yield (np.full(count, slot), np.full(count, size), np.repeat(nodes[:, :1], count, axis=1),
               [np.repeat(nodes[:, k + 1:k + 2], count, axis=1) for k in range(fanout)])


def _height(nodes: int, fanout: int, levels: int) -> int:
    """Levels that a block of a stage with so many nodes of its group rises."""
    height, reach = 0, 1
    while reach < nodes and height < levels:
        height, reach = height + 1, reach * fanout
    return height


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``pos``, from 0 within ``grp`` by ``order``, and ``nodes``, the group's rows.

    Rows are sorted by ranges over all groups, numbered within each range and moved by the totals of
    the ranges before, so a group of any size is spread. ``order`` must tell rows apart.
    """
    spark = rows.sparkSession
    keys = [F.col("grp"), *order]
    ranged = rows.repartitionByRange(shuffle_partitions(spark, rows), *keys)
    placed = materialize(ranged.sortWithinPartitions(*keys).withColumn(
        "seq", F.monotonically_increasing_id()), "merkle-order")
    placed = placed.withColumn("range", F.shiftright("seq", 33))
    totals = placed.groupBy("grp", "range").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    group = Window.partitionBy("grp")
    before = group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("grp", "range", (F.coalesce(F.sum("n").over(before), F.lit(0))
                                            - F.col("first")).alias("shift"),
                           F.sum("n").over(group).alias("nodes"))
    return placed.join(totals, ["grp", "range"]).withColumn(
        "pos", F.col("seq") + F.col("shift")).drop("seq", "range", "shift")


def build(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """The tree over ``leaves`` (grp, pos, nodes, digest), as written tables of blocks.

    Each block of a stage is (grp, block, nodes, count, height, root, digests, states): ``levels``
    levels of the tree over ``fanout ** levels`` nodes, with the state before every child slot. The
    roots are the next stage's nodes; in the last stage each group has one block.
    """
    size = fanout ** levels

    def make(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        nodes = table["nodes"][0].as_py()
        block = Block(_stack(table["digest"]), _height(nodes, fanout, levels), fanout)
        digests, states = block.packed()
        return pa.table({
            "grp": pa.array([key[0].as_py()], pa.string()), "block": pa.array([key[1].as_py()], pa.int64()),
            "nodes": pa.array([nodes], pa.int64()), "count": pa.array([len(table)], pa.int64()),
            "height": pa.array([len(block.states)], pa.int64()), "root": _binary(block.levels[-1]),
            "digests": pa.array([digests], pa.binary()), "states": pa.array([states], pa.binary())})

    schema = ("grp string, block long, nodes long, count long, height long, root binary, "
              "digests binary, states binary")
    most, stages = leaves.agg(F.max("nodes")).first()[0] or 0, []
    while True:
        rows = leaves.select("grp", F.floor(F.col("pos") / size).cast("long").alias("block"),
                             "pos", "nodes", "digest")
        stages.append(materialize(rows.groupBy("grp", "block").applyInArrow(make, schema), "merkle"))
        if most <= size:
            return stages
        most = -(-most // size)
        leaves = stages[-1].select("grp", F.col("block").alias("pos"), F.ceil(
            F.col("nodes") / size).cast("long").alias("nodes"), F.col("root").alias("digest"))


def paths(stages: list[DataFrame], above: DataFrame | None = None, fanout: int = FANOUT,
          levels: int = LEVELS, leaves: bool = False) -> DataFrame:
    """The way up of each block of the first stage, or of each leaf: (grp, block, path, subroot, top).

    ``path`` holds the packed steps from the block's root (the leaf of that number) to the top.
    ``above`` (grp, path, top) continues it over the groups' roots; without it the group's root is
    the top.
    """
    out = stages[-1].select("grp", "block", F.col("root").alias("subroot"))
    if above is None:
        out = out.select("*", F.lit(b"").alias("path"), F.col("subroot").alias("top"))
    else:
        out = out.join(above, "grp")
    size = fanout ** levels

    def down(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = row["count"]
                block = Block.unpacked(n, row["height"], fanout, row["digests"], row["states"])
                steps = _pack_steps(block.steps(np.arange(n)), n)
                yield pa.RecordBatch.from_pydict({
                    "grp": pa.array([row["grp"]] * n, pa.string()),
                    "block": pa.array(np.arange(n) + row["block"] * size, pa.int64()),
                    "path": pa.array([s + row["path"] for s in steps], pa.binary()),
                    "subroot": pa.array([row["subroot"]] * n, pa.binary()),
                    "top": pa.array([row["top"]] * n, pa.binary())})

    for stage in reversed(stages[0 if leaves else 1:]):
        out = stage.drop("root", "nodes").join(out, ["grp", "block"]).mapInArrow(
            down, "grp string, block long, path binary, subroot binary, top binary")
    return out


def fold(replaced: DataFrame, stage: DataFrame, ways: DataFrame, fanout: int = FANOUT,
         levels: int = LEVELS) -> DataFrame:
    """``replaced`` (grp, pos, digest, and more columns) with the root that each row alone leads to.

    Adds ``folded`` (root recomputed from the row's digest and the tree's other nodes),
    ``proof_sha256`` (of all siblings' hexadecimal texts), ``subroot`` and ``top``. Each block's rows
    meet that block and the way up that all of them share.
    """
    size = fanout ** levels
    rows = replaced.withColumn("block", F.floor(F.col("pos") / size).cast("long"))
    blocks = stage.drop("root", "nodes").join(ways, ["grp", "block"])
    extra = [f for f in rows.schema.fields if f.name not in ("grp", "block", "pos", "digest")]
    kept = [f.name for f in extra]

    def meet(mine: pa.Table, there: pa.Table) -> pa.Table:
        row = there.to_pylist()[0]
        block = Block.unpacked(row["count"], row["height"], fanout, row["digests"], row["states"])
        n = len(mine)
        value, proof, taken = climb(block.steps(mine["pos"].to_numpy() - row["block"] * size),
                                    _stack(mine["digest"]), fresh(n), np.zeros(n, np.int64))
        value, proof, taken = climb(_unpack_steps(row["path"], fanout, n), value, proof, taken)
        columns = {name: mine[name] for name in kept}
        return pa.table(columns | {
            "folded": _binary(value), "proof": _binary(finish(proof, taken)),
            "subroot": pa.array([row["subroot"]] * n, pa.binary()),
            "top": pa.array([row["top"]] * n, pa.binary())})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in extra)
    return rows.groupBy("grp", "block").cogroup(blocks.groupBy("grp", "block")).applyInArrow(
        meet, f"{schema}, folded binary, proof binary, subroot binary, top binary")


def leaf_hash(*columns: Column) -> Column:
    """SHA-256 of the values, each `-` if null, else its length in bytes, a colon and itself."""
    def field(value):
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def verify_rows(docs: DataFrame, doc_id: str = "doc_id", fanout: int = FANOUT,
                levels: int = LEVELS) -> DataFrame:
    """A manifest of ``docs`` and a check of every row against it.

    (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified). A leaf is the hash of doc_id,
    source, lang, n_chars and text. Leaves of a lang ascend by id (null first; rows of one id by
    their hash), each ``fanout`` consecutive nodes become one, and the langs' roots, ordered by lang
    (null first), become the root likewise. Rows whose decimal id has a CRC-32 that 7 divides are
    tampered with (n_chars is one more; a null stays, as do rows with a null id), and
    ``folded_root`` is what such a leaf leads to with the untampered siblings.

    Texts are read once, for two hashes a row; what is sorted and joined are rows of 100 bytes or so.
    A null, an empty and a very long text are values like any other. Rows repeated whole are leaves
    of their own, with equal hashes. Other columns are not read. An empty table gives no rows.
    """
    def hashed(n_chars):
        return leaf_hash(F.col(doc_id), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    more = F.col("n_chars").cast("decimal(20,0)") + 1
    changed = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 0, F.lit(False))
    leaf = hashed(F.col("n_chars"))
    leaves = materialize(docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("grp"),
        F.col(doc_id).alias("id"), leaf.alias("leaf"),
        F.when(changed & F.col("n_chars").isNotNull(), hashed(more)).alias("other"),
        F.monotonically_increasing_id().alias("tie")), "merkle-leaves")
    rows = numbered(leaves, [F.col("id").asc_nulls_first(), F.col("leaf"), F.col("tie")])
    rows = materialize(rows.drop("tie"), "merkle-rows")
    stages = build(rows.withColumnRenamed("leaf", "digest"), fanout, levels)
    roots = stages[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"),
                              F.col("root").alias("digest"))
    roots = materialize(numbered(roots, [F.col("name")]), "merkle-roots")
    tops = build(roots, fanout, levels)
    top = paths(tops, None, fanout, levels, True).select(F.col("block").alias("pos"), "path", "top")
    top = roots.select(F.col("name").alias("grp"), "pos").join(top, "pos").drop("pos")
    ways = paths(stages, top, fanout, levels)
    out = fold(rows.select("grp", "pos", F.coalesce("other", "leaf").alias("digest"), "id", "leaf"),
               stages[0], ways, fanout, levels)

    def text(name):
        return F.lower(F.hex(name))

    return out.select(
        F.col("id").alias("doc_id"), text("leaf").alias("leaf"), text("subroot").alias("subroot"),
        text("top").alias("root"), text("proof").alias("proof_sha256"),
        text("folded").alias("folded_root"), (F.col("folded") == F.col("top")).alias("verified"))

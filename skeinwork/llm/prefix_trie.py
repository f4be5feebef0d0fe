"""The trie of all conversations' prefixes, with counts and sums over every subtree.

1. ``turn_paths`` names each prefix of a conversation by a digest chained over its turns, one small row a turn. A conversation
   passes through its task as a stream, so its length doesn't matter.
2. Prefixes with more than ``bound`` turns behind them in all conversations are heavy: the root, and some levels below it.
   Every prefix under a heavy one that isn't heavy itself begins a shard of at most ``bound`` nodes. The bound is about the
   square root of the sum of all depths, so there are no more heavy nodes than a shard may have, whatever the input.
3. ``tries`` lays the nodes of each shard out in level order: a LOUDS bit vector (for each node a one for every child, then a
   zero) and arrays of labels and counts in the same order. Parents are ranks in the bit vector.
4. ``subtree_sums`` adds every level to the one above, from the last level up (``np.add.at``). The sums of the shards' roots
   are added by parent in the shuffle, and the heavy nodes above get a trie of their own, which starts with them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import crc_mod, materialise

#: Shards have at most so many nodes in small inputs; several shards share a row of about TOGETHER nodes.
LEAST_BOUND, TOGETHER = 1 << 10, 1 << 14
#: Heavy nodes up to this number are sent to all tasks (16 bytes each), more are joined.
MOST_SENT = 1 << 20
ROOT = 0, 0
_EMPTY_ROWS = 1 << 13

PATHS = "conv_id long, depth long, a long, b long, up_a long, up_b long, bytes long, below long, ends boolean"
_PATH_SCHEMA = pa.schema([(c, pa.int64()) for c in ("conv_id", "depth", "a", "b", "up_a", "up_b", "bytes", "below")] + [("ends", pa.bool_())])


def _next(a: int, b: int, role: bytes, text: bytes) -> tuple[int, int]:
    """The name of a prefix from that of the prefix before it and its last turn: half of a SHA-256 as two longs."""
    d = hashlib.sha256(b"%d %d %d " % (a, b, len(role)) + role + text).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:16], "little", signed=True)


def turn_paths(conversations: DataFrame, borrow: tuple[int, int] | None = None) -> DataFrame:
    """A row for each conversation and each depth from 0: the prefix's name (a, b) and its parent's (up_a, up_b), the UTF-8
    bytes of its last text, the conversation's turns below it, and whether it ends there.

    Turns go by ``turn`` (null first), then role and text; null roles and texts are empty; rows without conv_id belong to no
    conversation. With ``borrow`` = (g, most) each conversation c is rebuilt: its first k turns, k = crc32(c as text) mod
    most, are replaced by those of conversation c - c % g (as many as that has; none where it isn't there).
    """
    group, most = borrow or (1, 1)
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).cast("binary").alias("role"), F.coalesce("text", F.lit("")).cast("binary").alias("text"),
        (F.col("conv_id") - F.col("conv_id") % group).cast("long").alias("base"), crc_mod("conv_id", most).cast("long").alias("k"),
    )
    order = ["base", "late", "conv_id", F.asc_nulls_first("turn"), "role", "text"]
    every = Window.partitionBy("base", "late", "conv_id").orderBy(*order[3:]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = rows.withColumn("late", F.col("conv_id") != F.col("base")).repartition("base").withColumn("own", F.count("*").over(every))
    return dealt.sortWithinPartitions(*order).select("base", "conv_id", "own", "k", "role", "text").mapInArrow(_walker(most), PATHS)


def _walker(most: int):
    """Streams conversations in order, the one that lends its first turns before those that take them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lender, lent, here, out = None, [], None, []
        for b in batches:
            for base, conv, own, k, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if conv != here:
                    if base != lender:
                        lender, lent = base, []
                    start = lent[:k] if conv != base else []
                    here, at, size = conv, 0, len(start) + (max(0, own - k) if conv != base else own)
                    depth, name = 0, ROOT
                    out.append((conv, 0, *ROOT, None, None, 0, size, size == 0))
                    for r, t in start:
                        up, name, depth = name, _next(*name, r, t), depth + 1
                        out.append((conv, depth, *name, *up, len(t), size - depth, depth == size))
                if conv == base and at < most - 1:
                    lent.append((role, text))
                if conv == base or at >= k:
                    up, name, depth = name, _next(*name, role, text), depth + 1
                    out.append((conv, depth, *name, *up, len(text), size - depth, depth == size))
                at += 1
                if len(out) >= _EMPTY_ROWS:
                    yield _path_batch(out)
                    out = []
        if out:
            yield _path_batch(out)

    return run


def _path_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PATH_SCHEMA, strict=True)], schema=_PATH_SCHEMA)


class Louds:
    """A forest under one root in level order. Node i of it (from 0) is number i + 1, the root above all is number 0."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.bits, self.sizes = bits, sizes
        ones = np.flatnonzero(bits)
        self.parent = ones - np.arange(len(ones)) - 1  # zeros before a node's one are its parent's number; -1: in no tree
        self.degree = np.bincount(self.parent + 1, minlength=len(ones) + 1)[1:]

    @staticmethod
    def order(level: np.ndarray, parent: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nodes in level order, bits, nodes a level): children by their parent's place and then by label; parent -1 is a root."""
        by_level = np.argsort(level, kind="stable")
        sizes = np.bincount(level)
        place, out, begin = np.zeros(len(level), np.int64), [], 0
        for n in sizes.tolist():
            nodes = by_level[begin : begin + n]
            above = np.where(parent[nodes] < 0, -1, place[parent[nodes]])
            nodes = nodes[np.lexsort((label[nodes], above))]
            place[nodes] = np.arange(begin, begin + n)
            out.append(nodes)
            begin += n
        nodes = np.concatenate(out) if out else by_level
        above = np.where(parent[nodes] < 0, -1, place[parent[nodes]]) + 1
        degree = np.bincount(above, minlength=len(nodes) + 1)
        bits = np.ones(2 * len(nodes) + 1, bool)
        bits[np.cumsum(degree) + np.arange(len(degree))] = False
        return nodes, bits, sizes

    def roll_up(self, *values: np.ndarray) -> None:
        """Adds to each node what is below it, level by level from the last one."""
        ends = np.cumsum(self.sizes)
        for k in reversed(range(1, len(self.sizes))):
            part = slice(ends[k - 1], ends[k])
            for v in values:
                np.add.at(v, self.parent[part], v[part])


_ARRAYS = ("a", "b", "up_a", "up_b", "depth", "conv_id", "n_convs", "bytes", "more_children", "more_leaves", "more_saved")
TRIES = f"bits binary, sizes array<long>, {', '.join(f'{c} array<long>' for c in _ARRAYS)}"
_TRIE_SCHEMA = pa.schema([("bits", pa.binary()), ("sizes", pa.list_(pa.int64())), *((c, pa.list_(pa.int64())) for c in _ARRAYS)])
_INPUT = ("top_a", "top_b", *_ARRAYS)


def _names(a: np.ndarray, b: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(a), [None, pa.py_buffer(np.ascontiguousarray(np.stack([a, b], 1)))])


def _trie(x: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The succinct trie of whole shards, which lie one after the other."""
    new = np.flatnonzero(np.concatenate([[True], (np.diff(x["top_a"]) != 0) | (np.diff(x["top_b"]) != 0)]))
    top = np.repeat(np.minimum.reduceat(x["depth"], new), np.diff(np.append(new, len(x["a"]))))
    parent = pc.index_in(_names(x["up_a"], x["up_b"]), value_set=_names(x["a"], x["b"])).fill_null(-1).to_numpy().astype(np.int64)
    parent[x["depth"] == top] = -1
    nodes, bits, sizes = Louds.order(x["depth"] - top, parent, x["conv_id"])
    return pa.RecordBatch.from_pylist([{"bits": np.packbits(bits).tobytes(), "sizes": sizes, **{c: x[c][nodes] for c in _ARRAYS}}], _TRIE_SCHEMA)


def tries(nodes: DataFrame, together: int = TOGETHER) -> DataFrame:
    """Succinct tries of ``nodes`` with the shard of each (top_a, top_b): rows of whole shards in level order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            rows = np.stack([c.to_numpy() for c in b.columns])
            held.append(rows)
            if sum(h.shape[1] for h in held) < together:
                continue
            x = np.concatenate(held, axis=1)
            last = (x[0] == x[0, -1]) & (x[1] == x[1, -1])  # a shard that may go on
            if not last.all():
                yield _trie(dict(zip(_INPUT, x[:, ~last], strict=True)))
                x = x[:, last]
            held = [x]
        if held and sum(h.shape[1] for h in held):
            yield _trie(dict(zip(_INPUT, np.concatenate(held, axis=1), strict=True)))

    return nodes.select(*_INPUT).repartition("top_a", "top_b").sortWithinPartitions("top_a", "top_b").mapInArrow(run, TRIES)


SUMS = "a long, b long, up_a long, up_b long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def subtree_sums(forest: DataFrame) -> DataFrame:
    """For each node of the tries the number of children, and of leaves and of saved tokens in its subtree. The roots of shards
    have no parent_conv_id, as their parent is in another trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                x = {c: b.column(c).slice(k, 1).flatten().to_numpy() for c in ("sizes", *_ARRAYS)}
                n = len(x["a"])
                louds = Louds(np.unpackbits(np.frombuffer(b.column("bits")[k].as_py(), np.uint8), count=2 * n + 1), x["sizes"])
                children = louds.degree + x["more_children"]
                leaves = x["more_leaves"] + (children == 0)
                saved = x["more_saved"] + (x["n_convs"] - 1) * x["bytes"]
                louds.roll_up(leaves, saved)
                parent = pa.array(x["conv_id"][louds.parent], pa.int64(), mask=louds.parent < 0)
                out = [x["a"], x["b"], x["up_a"], x["up_b"], x["conv_id"], x["depth"], parent, x["n_convs"], children, leaves, saved]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], names=[f.split()[0] for f in SUMS.split(", ")])

    return forest.mapInArrow(run, SUMS)


def ends_digests(paths: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of the prefixes where conversations end: their decimal ids, ascending, with commas between. Ids are
    hashed as they pass, so a prefix that many conversations end at needs no memory for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, digest = None, None
        for b in batches:
            out = []
            for a, z, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (a, z) != here:
                    if digest:
                        out.append((*here, digest.hexdigest()))
                    here, digest = (a, z), hashlib.sha256(b"%d" % conv)
                else:
                    digest.update(b",%d" % conv)
            if out:
                yield batch(out)
        if digest:
            yield batch([(*here, digest.hexdigest())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["a", "b", "ends_sha256"])

    ends = paths.filter("ends").select("a", "b", "conv_id")
    return ends.repartition("a", "b").sortWithinPartitions("a", "b", "conv_id").mapInArrow(run, "a long, b long, ends_sha256 string")


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_SENT else df


def prefix_trie(conversations: DataFrame, borrow: tuple[int, int] | None = None, least_bound: int = LEAST_BOUND, together: int = TOGETHER) -> DataFrame:
    """A row for each distinct prefix (role and text of each turn) of the conversations, the empty one included: conv_id (the
    least that has it), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    ``saved_tokens`` sums over the subtree the UTF-8 bytes of the last text for all conversations but one; ``ends_sha256`` is
    of the ids that end there (of nothing where none does). See ``turn_paths`` for order, nulls and ``borrow``. Repeated rows
    are turns as any; no conversations, no rows.
    """
    paths = materialise(turn_paths(conversations, borrow), "paths")
    counts = (F.min("depth").alias("depth"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.sum("below").alias("below"))
    nodes = materialise(paths.groupBy("a", "b").agg(*counts), "nodes")
    depths = nodes.agg(F.sum("below")).first()[0] or 0  # each turn once for each prefix above it
    bound = max(least_bound, isqrt(depths))
    most_heavy = depths // bound + 1
    is_heavy = (F.col("below") > bound) | (F.col("depth") == 0)
    heavy, light = nodes.filter(is_heavy), nodes.filter(~is_heavy)

    marked = paths.select("conv_id", "depth", "a", "b").join(_sent(heavy.select("a", "b", F.lit(True).alias("heavy")), most_heavy), ["a", "b"], "left")
    first_light = F.when(F.col("heavy").isNull(), F.col("depth"))
    tops = marked.groupBy("conv_id").agg(F.min_by("a", first_light).alias("top_a"), F.min_by("b", first_light).alias("top_b"))
    none = [F.lit(0).cast("long").alias(c) for c in ("more_children", "more_leaves", "more_saved")]
    below = materialise(subtree_sums(materialise(tries(light.join(tops, "conv_id").select("*", *none), together), "tries")), "sums")

    roots = below.filter("parent_conv_id IS NULL").groupBy("up_a", "up_b").agg(F.count("*").alias("more_children"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
    upper = heavy.drop("below").withColumnsRenamed({"up_a": "above_a", "up_b": "above_b"}).join(roots.withColumnsRenamed({"up_a": "a", "up_b": "b"}), ["a", "b"], "left")
    upper = upper.withColumns({"up_a": F.coalesce("above_a", F.lit(0)), "up_b": F.coalesce("above_b", F.lit(0)), "top_a": F.lit(0).cast("long"), "top_b": F.lit(0).cast("long")}).fillna(0, ["more_children", "more_leaves", "more_saved"])
    above = subtree_sums(tries(upper, together))

    named = heavy.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("named"))
    whole = below.join(_sent(named, most_heavy), ["up_a", "up_b"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "named"))
    columns = ["a", "b", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    nodes = whole.select(*columns).unionByName(above.select(*columns))
    return nodes.join(ends_digests(paths), ["a", "b"], "left").select(*columns[2:], F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))

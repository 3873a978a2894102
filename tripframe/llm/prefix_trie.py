"""Prefix trie of conversations with subtree totals, by time-forward processing.

A node of depth ``d`` is a distinct sequence of the first ``d`` turns (role, text) of
conversations; the root has depth 0. ``trie`` returns every node with its members,
children, leaves and the tokens that sharing saves.

* Turns are told by a digest of role and text; their places come from
  ``operators.positions``, so a conversation of any length is cut over tasks. A
  node's name is the exclusive or of two 64-bit hashes of (place, turn) over
  its turns: a running sum, taken per band of ``BAND`` turns and joined by offsets.
  Texts themselves do not travel.
* Every node belongs to its smallest member, so the nodes of a conversation's
  path that it owns are what it adds to all nodes above them.
* Shards are made of conversations (by hash) and bands of depth, so they are even
  whatever is shared. A shard holds the paths of its conversations through its
  band; what they own below the band enters at its last turn. In a shard nodes are
  sorted by Spark in reverse level order (deepest first; Spark's sort spills). A
  task goes through them once: totals sent to a node wait in a priority queue in the
  same order, the node takes them out, adds its own and sends the sum to its
  parent. The queue keeps at most ``HELD`` entries in memory and writes sorted
  runs to a nameless file in the worker's Spark scratch folder beyond that, which ends
  with the task (as Spark's own sorts do).
* Across shards: a node that several shards hold gets the sum of its totals there.

Order of turns: by ``turn`` (null first), then by digest, so ties have an order; rows
that repeat a turn are turns of their own. Null roles and texts are empty. Rows
without a conversation id take no part. A conversation without turns is a
member of the root only. No conversations: no rows (also no root). Names that agree
by chance in 128 bits would merge two nodes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripframe.llm import common as C
from tripframe.operators.positions import GN, position

#: Turns a band holds, entries a queue holds, bytes of ids a piece holds.
BAND, HELD, PIECE = 1024, 200_000, 1 << 16
NODE = ("depth", "k1", "k2")
PARENT = ("p1", "p2")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
          text: str = "text") -> DataFrame:
    """``conv, pos`` (from 0), ``step`` (digest of role and text), ``chars, n`` (turns
    of the conversation) of every turn, written once."""
    r, t = (F.coalesce(C.column(c).cast("string"), F.lit("")) for c in (role, text))
    step = F.unhex(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256))
    rows = conversations.select(C.column(conv).cast("long").alias("conv"), C.column(turn).cast("long").alias("turn"),
                                step.alias("step"), F.length(t).cast("long").alias("chars")).filter("conv is not null")
    return C.stage(position(rows, ["conv"], ["turn", "step"], "pos", keep_counts=True).select(
        "conv", F.col("pos").cast("long").alias("pos"), "step", "chars", F.col(GN).cast("long").alias("n")), "trie-turns")


def as_given(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation's own turns: ``conv, depth, step, chars, len`` and the
    conversations ``conv, len``."""
    rows = steps.select("conv", (F.col("pos") + 1).alias("depth"), "step", "chars", F.col("n").alias("len"))
    return rows, steps.filter("pos = 0").select("conv", F.col("n").alias("len"))


def rebuilt(steps: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """As ``as_given``, but a conversation ``c`` starts with the first ``h`` turns of
    ``c - c % group`` (all if fewer, none if absent) in place of its own first ``h``,
    where ``h`` is the CRC-32 of its decimal id modulo ``most``."""
    convs = steps.filter("pos = 0").select("conv", "n")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    base = convs.filter(F.col("conv") % group == 0).select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    info = (convs.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % group).alias("base"))
            .join(base, "base", "left")
            .withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
            .withColumn("len", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    info = C.stage(info.select("conv", "base", "h", "taken", "len"), "trie-conversations")
    first = (steps.filter((F.col("pos") < most - 1) & (F.col("conv") % group == 0))
             .select(F.col("conv").alias("base"), "pos", "step", "chars"))
    shared = (first.join(info, "base").filter("pos < taken")
              .select("conv", (F.col("pos") + 1).alias("depth"), "step", "chars", "len"))
    own = (steps.join(info, "conv").filter("pos >= h")
           .select("conv", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("depth"), "step", "chars", "len"))
    return shared.union(own), info.select("conv", "len")


def _paths(rows: DataFrame) -> DataFrame:
    """The node of every turn: ``conv, depth, band, k1, k2, p1, p2, chars, len``."""
    named = rows.select("conv", "depth", F.floor((F.col("depth") - 1) / BAND).cast("long").alias("band"), "chars", "len",
                        *[F.xxhash64(F.lit(i), "depth", "step").alias(f"x{i}") for i in (1, 2)])
    w = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    both = [F.expr(f"bit_xor(x{i})").alias(f"x{i}") for i in (1, 2)]
    start = named.groupBy("conv", "band").agg(*both).select(
        "conv", "band", *[F.coalesce(F.expr(f"bit_xor(x{i})").over(w), F.lit(0)).alias(f"s{i}") for i in (1, 2)])
    inside = Window.partitionBy("conv", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = named.select("*", *[F.expr(f"bit_xor(x{i})").over(inside).alias(f"r{i}") for i in (1, 2)])
    name = {f"k{i}": F.col(f"r{i}").bitwiseXOR(F.col(f"s{i}")) for i in (1, 2)}
    return run.join(start, ["conv", "band"]).withColumns(name).select(
        "conv", "depth", "band", "k1", "k2", *[F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)],
        "chars", "len")


class WaitingTotals:
    """Totals on their way to a node, smallest ``(level, k1, k2)`` first: a heap of at
    most ``held`` entries, and sorted runs in a file beyond that."""

    _ENTRY = struct.Struct("<5q")

    def __init__(self, held: int = HELD):
        self.held, self.heap, self.heads, self.file = held, [], [], None

    def put(self, entry: tuple[int, int, int, int, int]) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) > self.held:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            folders = [f for f in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(f)]
            self.file = tempfile.TemporaryFile(dir=folders[0] if folders else None)
        at = self.file.seek(0, os.SEEK_END)
        for e in sorted(self.heap):
            self.file.write(self._ENTRY.pack(*e))
        end = self.file.tell()
        self.heap = []
        self._next(self._read(at, end))

    def _read(self, at: int, end: int) -> Iterator[tuple]:
        size = 1024 * self._ENTRY.size
        while at < end:
            self.file.seek(at)
            block = self.file.read(min(size, end - at))
            at += len(block)
            yield from self._ENTRY.iter_unpack(block)

    def _next(self, run: Iterator[tuple]) -> None:
        e = next(run, None)
        if e is not None:
            heapq.heappush(self.heads, (e, id(run), run))

    def least(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def take(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            e, _, run = heapq.heappop(self.heads)
            self._next(run)
            return e
        return heapq.heappop(self.heap)

    def take_all(self, node: tuple[int, int, int]) -> tuple[int, int]:
        """Totals sent to a node. What waits for nodes before it can't come any more:
        it went to nodes outside the shard."""
        leaves = saved = 0
        while (e := self.least()) is not None and e[:3] <= node:
            e = self.take()
            if e[:3] == node:
                leaves, saved = leaves + e[3], saved + e[4]
        return leaves, saved


def forward(rows: Iterator[tuple], held: int = HELD) -> Iterator[tuple[int, int, int, int, int]]:
    """Time-forward processing of one shard: ``rows`` are its nodes ``(depth, k1, k2, p1,
    p2, leaves, saved)`` in reverse level order; yields ``(depth, k1, k2)`` with the
    totals of the shard's part of its subtree. A root that nodes send to comes last."""
    waiting = WaitingTotals(held)
    for depth, k1, k2, p1, p2, leaves, saved in rows:
        more = waiting.take_all((-depth, k1, k2))
        leaves, saved = leaves + more[0], saved + more[1]
        yield depth, k1, k2, leaves, saved
        waiting.put((1 - depth, p1, p2, leaves, saved))
    leaves, saved = waiting.take_all((0, 0, 0))
    if leaves or saved:
        yield 0, 0, 0, leaves, saved


def _forwarded(sorted_nodes: DataFrame, held: int) -> DataFrame:
    """``forward`` over every shard of a partition sorted by ``bucket, band``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def nodes() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        def shards() -> Iterator[Iterator[tuple]]:
            nonlocal head
            while head is not None:
                yield shard(head[:2])

        def shard(name: tuple) -> Iterator[tuple]:
            nonlocal head
            while head is not None and head[:2] == name:
                yield head[2:]
                head = next(all_nodes, None)

        all_nodes = nodes()
        head = next(all_nodes, None)
        out: list[tuple] = []
        for s in shards():
            for row in forward(s, held):
                out.append(row)
                if len(out) == 20_000:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    return sorted_nodes.mapInArrow(run, "depth long, k1 long, k2 long, leaves long, saved long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    a = np.array(rows, dtype=np.int64).T
    return pa.RecordBatch.from_arrays([pa.array(c) for c in a], names=["depth", "k1", "k2", "leaves", "saved"])


def _totals(paths: DataFrame, owned: DataFrame, parts: int, held: int) -> DataFrame:
    """``depth, k1, k2, leaves, saved`` of whole subtrees, the node itself included.
    ``owned``: every node at its owner's path, with its own ``leaves`` and ``saved``."""
    cols = ["conv", *NODE, *PARENT, "band"]
    none = [F.lit(0).cast("long").alias(c) for c in ("leaves", "saved")]
    # What a conversation owns below a band enters the band at its last turn.
    last = paths.filter(F.col("depth") % BAND == 0)
    per = (owned.select("conv", "band", "leaves", "saved", F.lit(None).cast("struct<k1:long,k2:long,p1:long,p2:long>").alias("at"))
           .union(last.select("conv", "band", *none, F.struct("k1", "k2", "p1", "p2")))
           .groupBy("conv", "band").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
                                        F.max("at").alias("at")))
    deeper = Window.partitionBy("conv").orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    below = (per.select("conv", "band", "at", *[F.sum(c).over(deeper).alias(c) for c in ("leaves", "saved")])
             .filter("at is not null and leaves is not null")
             .select("conv", ((F.col("band") + 1) * BAND).alias("depth"), "at.k1", "at.k2", "at.p1", "at.p2", "band",
                     "leaves", "saved"))
    rows = (paths.select(*cols, *none).union(owned.select(*cols, "leaves", "saved")).union(below)
            .withColumn("bucket", F.pmod(F.xxhash64("conv"), F.lit(parts))).repartition(parts, "bucket", "band"))
    nodes = (rows.groupBy("bucket", "band", *NODE, *PARENT)
             .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
             .sortWithinPartitions("bucket", "band", F.col("depth").desc(), "k1", "k2"))
    return _forwarded(nodes, held).groupBy(*NODE).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _end_digests(ends: DataFrame, parts: int) -> DataFrame:
    """SHA-256 of every node's comma-joined ids in ascending order. Ids are joined
    to pieces where ranges of them lie; a hash, which only goes from start to end, then
    passes over the pieces."""
    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
        for b in batches:
            if not b.num_rows:
                continue
            node = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
            cut = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]).any(axis=1)])
            more = [b.column(i) for i in range(3, b.num_columns)]
            for lo, hi in zip(cut, [*cut[1:], len(node)]):
                yield tuple(node[lo].tolist()), [c.slice(lo, hi - lo).to_pylist() for c in more]

    def out(rows: list[tuple], names: list[str], last: list) -> pa.RecordBatch:
        cols = list(zip(*rows))
        kinds = [pa.int64()] * 3 + last
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for node, (ids,) in same(batches):
            for lo in range(0, len(ids), 4096):
                text = ",".join(map(str, ids[lo:lo + 4096])).encode()
                rows.append((*node, ids[lo], text))
                size += len(text)
                if size > PIECE:
                    yield out(rows, [*NODE, "first", "ids"], [pa.int64(), pa.binary()])
                    rows, size = [], 0
        if rows:
            yield out(rows, [*NODE, "first", "ids"], [pa.int64(), pa.binary()])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, h, rows = None, None, []
        for node, (_, ids) in same(batches):
            if node != here:
                if h is not None:
                    rows.append((*here, h.hexdigest()))
                here, h = node, hashlib.sha256(ids[0])
                ids = ids[1:]
            for t in ids:
                h.update(b"," + t)
            if len(rows) >= 4096:
                yield out(rows, [*NODE, "ends_sha256"], [pa.string()])
                rows = []
        if h is not None:
            rows.append((*here, h.hexdigest()))
            yield out(rows, [*NODE, "ends_sha256"], [pa.string()])

    pieces = (ends.repartitionByRange(parts, *NODE, "conv").sortWithinPartitions(*NODE, "conv")
              .mapInArrow(join_ids, "depth long, k1 long, k2 long, first long, ids binary"))
    return (pieces.repartition(parts, *NODE).sortWithinPartitions(*NODE, "first")
            .mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string"))


def _at(df: DataFrame, names: dict[str, Column]) -> DataFrame:
    return df.select(*[v.alias(k) for k, v in names.items()])


def trie(rows: DataFrame, convs: DataFrame, held: int = HELD) -> DataFrame:
    """One row per node from turns and conversations as ``as_given`` or ``rebuilt``
    return them: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``."""
    spark = rows.sparkSession
    C.bound_batches(spark)
    parts = C.shuffle_parts(spark)
    paths = C.stage(_paths(rows), "trie-paths")
    nodes = C.stage(paths.groupBy(*NODE).agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.max("chars").alias("chars"),
        F.max("band").alias("band"), F.max("p1").alias("p1"), F.max("p2").alias("p2")), "trie-nodes")
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).filter("n > 0")
    above = {"depth": F.col("depth") - 1, "k1": F.col("p1"), "k2": F.col("p2")}
    kids = nodes.groupBy(*[v.alias(k) for k, v in above.items()]).agg(F.count(F.lit(1)).alias("n_children"))
    # The root's children are told its member at once, others meet their parents.
    parents = _at(nodes, {"pd": F.col("depth") + 1, "q1": F.col("k1"), "q2": F.col("k2"), "parent": F.col("conv")})
    deep = (nodes.filter("depth > 1")
            .join(parents, (F.col("depth") == F.col("pd")) & (F.col("p1") == F.col("q1")) & (F.col("p2") == F.col("q2")))
            .drop("pd", "q1", "q2"))
    top = nodes.filter("depth = 1").withColumn("parent", root.select("conv").scalar())
    zero = F.lit(0).cast("long")
    start = root.select(*[zero.alias(c) for c in NODE], "conv", "n", zero.alias("chars"), zero.alias("band"),
                        *[zero.alias(c) for c in PARENT], F.lit(None).cast("long").alias("parent"))
    full = C.stage(deep.unionByName(top).unionByName(start).join(kids, list(NODE), "left")
                   .withColumn("n_children", F.coalesce("n_children", zero))
                   .withColumn("leaves", (F.col("n_children") == 0).cast("long"))
                   .withColumn("saved", (F.col("n") - 1) * F.col("chars")), "trie-full")
    totals = _totals(paths, full.filter("depth > 0"), parts, held).withColumnsRenamed(
        {"leaves": "all_leaves", "saved": "all_saved"})
    ends = paths.filter("depth = len").select(*NODE, "conv").union(
        convs.filter("len = 0").select(*[zero.alias(c) for c in NODE], "conv"))
    return (full.join(totals, list(NODE), "left").join(_end_digests(ends, parts), list(NODE), "left")
            .select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"),
                    F.col("n").alias("n_convs"), "n_children",
                    F.coalesce("all_leaves", "leaves").alias("n_leaves"),
                    F.coalesce("all_saved", "saved").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))

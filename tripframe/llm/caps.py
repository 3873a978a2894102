"""Embedding near-duplicates by spherical-cap filters.

``link`` finds pairs of vectors with equal labels and cosine at or above
``least``, counts every vector's links and names its component.

* Filters: a vector is turned by a seeded structured rotation (signs and a
  Walsh-Hadamard transform, twice) and cut into ``BLOCKS`` blocks. Every block has a
  codebook of ``CODES`` random directions; a filter direction is one code
  per block, so ``CODES ** BLOCKS`` directions need only ``BLOCKS * CODES``
  inner products. A vector belongs to *all* filters whose direction it exceeds
  by ``CUT`` times its inner product with its best direction (vectors of up to ``SHORT``
  numbers, whose pairs would share several filters by chance, all belong to one); they are
  list-decoded block by block, dropping prefixes that can't reach the cut any
  more. A cut relative to the best direction gives every vector some filters,
  and near vectors mostly the same. ``TABLES`` rotations can be used.
* Join: vectors that share a filter (of one label and length) meet in one
  Spark partition. A filter of more than ``BLOCK`` vectors is dealt out as
  pairs of blocks, so no task gets an unbounded group. A vector is sent once per
  filter, which is many times the table: filters are joined in rounds of about
  ``ROUND`` times the vectors' bytes, whose shuffles are deleted in between, and a
  partition gets about ``PART`` bytes, however large the table is.
* Verify: cosines in double precision. A pair that shares several filters
  counts at the smallest one only. A task returns link counts per vector and
  a forest of links, not pairs; equal vectors were grouped before with their
  number, so copies cost nothing.

The index is complete: all vectors are indexed. Recall is that of the filters
(README has measured figures); no pair below ``least`` is linked.

Vectors that are null, empty, zero or hold null or non-finite components, rows
without a label and rows without an id link with nothing: 0 links, their own
component. Only vectors of equal length are compared. Rows that repeat an id
are separate vectors under one id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripframe.llm import common as C
from tripframe.llm import exchange as X
from tripframe.llm import wordhash as W
from tripframe.llm.components import components

LEAST = 0.93
BLOCKS, CODES, CUT, TABLES = 3, 64, 0.9, 1
BLOCK = 2048
ROUND, ROUND_BYTES = 1.5, 256 << 20      # what a round sends: in bytes of all vectors, and in bytes at least
PART = 12 << 20     # bytes that a partition of a round gets, or a task sends at once
SHORT = 8
SEED = 7
_SLICE = 256


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows (length a power of two)."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def decode(unit: np.ndarray, cut: float = CUT, tables: int = TABLES, seed: int = SEED
           ) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter number) of all filters that unit vectors exceed."""
    d = unit.shape[1]
    wide = max(4, 1 << (d - 1).bit_length())      # a power of two, at least BLOCKS
    padded = np.zeros((len(unit), wide))
    padded[:, :d] = unit
    rows, filters = [], []
    for t in range(tables):
        rng = np.random.default_rng([seed, t, d])
        x = _hadamard(padded * rng.choice([-1.0, 1.0], wide))
        x = _hadamard(x * rng.choice([-1.0, 1.0], wide))
        score = []
        for b in range(BLOCKS):
            c = rng.standard_normal((CODES, len(range(b, wide, BLOCKS))))
            c /= np.linalg.norm(c, axis=1)[:, None]
            score.append(x[:, b::BLOCKS] @ c.T / np.sqrt(BLOCKS))
        for lo in range(0, len(unit), _SLICE):
            s = [v[lo:lo + _SLICE] for v in score]
            best = [v.max(axis=1) for v in s]
            least = cut * sum(best)
            n = len(s[0])
            row, val, code = np.arange(n), np.zeros(n), np.zeros(n, np.int64)
            for b in range(BLOCKS):
                rest = sum(best[b + 1:], np.zeros(n))
                i, k = np.nonzero(val[:, None] + s[b][row] >= (least - rest)[row][:, None] - 1e-12)
                row, val, code = row[i], val[i] + s[b][row[i], k], code[i] * CODES + k
            rows.append(row + lo)
            filters.append(code + t * CODES ** BLOCKS)
    return np.concatenate(rows), np.concatenate(filters)


def usable(v: str, parts: tuple[str, ...] = ()):
    """Condition: a vector with finite components only, not empty or null."""
    odd = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    ok = F.col(v).isNotNull() & (F.size(v) > 0) & ~F.coalesce(odd, F.lit(True))
    for p in parts:
        ok = ok & F.col(p).isNotNull()
    return F.coalesce(ok, F.lit(False))


def _matrix(col, kind=np.float64) -> np.ndarray:
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1).astype(kind)


def _binary(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, offsets of length rows + 1) of a binary column."""
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def _cut(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """Bytes as binary values of the sizes given."""
    off = np.r_[0, np.cumsum(size)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(data.tobytes())])


def _by_length(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    n = pc.list_value_length(b.column(column)).to_numpy(zero_copy_only=False)
    for d in np.unique(n):
        yield int(d), b.take(pa.array(np.flatnonzero(n == d)))


_LISTS = "node long, own long, h1 long, h2 long, m long, label long, d int, n int, vec binary, filters binary"


def _filters(reps: DataFrame, kind: str, cut: float, tables: int) -> DataFrame:
    """Vectors with their ``n`` filters, ascending (both packed: numbers of
    ``kind``, and of four bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for d, b in _by_length(whole, 6):
                given = _matrix(b.column(6), kind)
                v = given.astype(np.float64)
                if d <= SHORT:
                    row, f = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
                else:
                    row, f = decode(v / np.linalg.norm(v, axis=1)[:, None], cut, tables)
                by = np.lexsort((f, row))
                n = np.bincount(row, minlength=b.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:6], pa.array(np.full(len(n), d, np.int32)), pa.array(n.astype(np.int32)),
                     _cut(given, np.full(len(n), given.itemsize * d)), _cut(f[by].astype("<u4"), 4 * n)],
                    names=[x.split()[0] for x in _LISTS.split(", ")])

    return reps.mapInArrow(run, _LISTS)


def _listed(filters, d, n, label) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Filters of a batch's vectors one by one: filter, its hash with label and
    length, row, place in the row's list."""
    n = n.to_numpy().astype(np.int64)
    f = _binary(filters)[0].view("<u4")
    row = np.repeat(np.arange(len(n)), n)
    of = W.mix(label.to_numpy().astype(np.uint64))
    length = d.to_numpy().astype(np.uint64) << np.uint64(32)
    h = W.mix(W.mix(f.astype(np.uint64) + length[row]) ^ of[row])
    return f, h, row, np.arange(len(f)) - np.repeat(np.cumsum(n) - n, n)


def _crowded(lists: DataFrame, block: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(hash, number of blocks) of filters with more than ``block`` vectors, in
    order of the hash, and how many records they add. At most one filter for ``block``
    records reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, c = np.unique(_listed(*b.columns)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["f", "c"])

    got = (lists.select("filters", "d", "n", "label").mapInArrow(run, "f long, c long")
           .groupBy("f").agg(F.sum("c").alias("c")).filter(F.col("c") > block).toPandas())
    f, c = got["f"].to_numpy(np.int64).view(np.uint64), got["c"].to_numpy(np.int64)
    by = np.argsort(f)
    nb = -(-c // block)
    return f[by], nb[by].astype(np.int64), int((c * (nb - 1)).sum())


def _places(h, f, row, at, node, crowded, nb) -> tuple[np.ndarray, ...]:
    """Where the vectors go: (place, filter, row, place in its list, block, whether
    both blocks are one), one place per filter, or one per pair of blocks."""
    many = np.ones(len(h), dtype=np.int64)
    if len(crowded):
        k = np.minimum(np.searchsorted(crowded, h), len(crowded) - 1)
        many = np.where(crowded[k] == h, nb[k], 1)
    o = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    h, f, row, at, many = (np.repeat(x, many) for x in (h, f, row, at, many))
    b = (W.mix(node[row]) % many.astype(np.uint64)).astype(np.int64)
    pair = (np.minimum(b, o) << 32 | np.maximum(b, o)).astype(np.uint64)
    return W.mix(h ^ W.mix(pair)), f, row, at, b, b == o


OUT = "own long, links long, root long"
_HEAD = ("<u4", 4)      # records, vectors, bytes of an index, length of the lists
_RECORD = 41            # bytes of a record with its vector's number, without vector and list


def _pack(key, row, f, at, blk, diag, node, m, vec, flat, start) -> bytes:
    """Records of one partition and the vectors they name, each with its filters
    up to the last one it is sent for: a shared smaller filter is among those."""
    used, idx = np.unique(row, return_inverse=True)
    size = np.zeros(len(used), dtype=np.int64)
    np.maximum.at(size, idx, at + 1)
    take = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[used], size)
    idx = idx.astype("<u2" if len(used) <= 65536 else "<u4")
    head = np.array([len(key), len(used), idx.itemsize, len(take)], dtype="<u4")
    return b"".join([head.tobytes(), X.pack48(key), idx.tobytes(), f.astype("<u4").tobytes(), blk.astype("<u4").tobytes(),
                     diag.astype("u1").tobytes(), node[used].tobytes(), m[used].tobytes(), size.astype("<u4").tobytes(),
                     vec[used].tobytes(), flat[take].tobytes()])


def _unpack(b: bytes, d: int, kind: str) -> tuple[np.ndarray, ...]:
    k, u, w, n = (int(x) for x in np.frombuffer(b, _HEAD[0], _HEAD[1]))
    at, out = 4 * _HEAD[1], []
    for dtype, count in (("u1", 6 * k), (f"<u{w}", k), ("<u4", k), ("<u4", k), ("u1", k), ("<i8", u), ("<i8", u),
                         ("<u4", u), (kind, u * d), ("<u4", n)):
        out.append(np.frombuffer(b, dtype, count, at))
        at += out[-1].nbytes
    out[0] = X.unpack48(out[0].tobytes())
    out[8] = out[8].reshape(u, d)
    return tuple(out)


def _send(lists: DataFrame, kind: str, crowded, turn: int, rounds: int, parts: int) -> DataFrame:
    """Vectors of one round packed by target partition: ``part, d, payload``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, nb = crowded.value
        for whole in batches:
            lengths = whole.column(3).to_numpy()
            for d in np.unique(lengths).tolist():
                b = whole if len(whole) == (lengths == d).sum() else whole.take(pa.array(np.flatnonzero(lengths == d)))
                f, h, row, at = _listed(b.column(6), b.column(3), b.column(4), b.column(2))
                node, m = b.column(0).to_numpy(), b.column(1).to_numpy()
                vec = _binary(b.column(5))[0].view(kind).reshape(len(node), d)
                start = np.searchsorted(row, np.arange(len(node)))
                named = node.astype(np.uint64)
                many = np.ones(len(h), dtype=np.int64)
                if len(hot):
                    k = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    many = np.where(hot[k] == h, nb[k], 1)
                size = np.cumsum(many * (_RECORD + vec.itemsize * d + 4 * at)) // (PART * rounds)
                cuts = np.flatnonzero(np.diff(size, prepend=-1))
                for lo, hi in zip(cuts, [*cuts[1:], len(h)]):
                    place, *rest = _places(h[lo:hi], f[lo:hi], row[lo:hi], at[lo:hi], named, hot, nb)
                    mine = (place & np.uint64(0xFFFFFF)) % np.uint64(rounds) == turn
                    place, rest = place[mine], [x[mine] for x in rest]
                    part = X.part_of(place, parts)
                    by = np.argsort(part, kind="stable")
                    part, key, (g, r, a, blk, diag) = part[by], place[by], [x[by] for x in rest]
                    s, c = X.run_lengths(part)
                    if not len(s):
                        continue
                    out = [_pack(key[i:i + n], r[i:i + n], g[i:i + n], a[i:i + n], blk[i:i + n], diag[i:i + n],
                                 node, m, vec, f, start) for i, n in zip(s, c)]
                    yield pa.RecordBatch.from_arrays([pa.array(part[s], pa.int32()), pa.array([d] * len(out), pa.int32()),
                                                      pa.array(out, pa.binary())], names=["part", "d", "payload"])

    return (lists.select("node", "m", "label", "d", "n", "vec", "filters")
            .mapInArrow(run, "part int, d int, payload binary").repartitionById(parts, F.col("part")))


class _Tally:
    """Links of one partition: counts and a forest."""

    def __init__(self, own, m, unit, size, flat, least):
        self.own, self.m, self.unit, self.least = own, m, unit, least
        self.size, self.start, self.flat = size, np.cumsum(size) - size, flat
        self.rough = unit.astype(np.float32)
        self.links = np.zeros(len(own), dtype=np.int64)
        self.root = np.arange(len(own))
        self.has = np.sort(self._named(flat, np.repeat(np.arange(len(own)), size)))

    @staticmethod
    def _named(f: np.ndarray, row: np.ndarray) -> np.ndarray:
        return W.mix(row.astype(np.uint64) << np.uint64(32) | f.astype(np.uint64))

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which products of two sets of rows (the last but one axis) can reach the
        least cosine: in single precision, less its error."""
        return (self.rough[x] @ np.swapaxes(self.rough[y], -1, -2)
                >= self.least - 1e-5 - 1e-6 * self.unit.shape[1])

    def add(self, x: np.ndarray, y: np.ndarray, f: np.ndarray) -> None:
        """Candidate pairs with the filter they met in."""
        for lo in range(0, len(x), 8192):
            a, b, g = x[lo:lo + 8192], y[lo:lo + 8192], f[lo:lo + 8192]
            near = np.einsum("ij,ij->i", self.unit[a], self.unit[b]) >= self.least
            a, b, g = a[near], b[near], g[near]
            if not len(a):
                continue
            first = self._is_first(a, b, g)
            a, b = a[first], b[first]
            np.add.at(self.links, a, self.m[b])
            np.add.at(self.links, b, self.m[a])
            self._hang(a, b)

    def _is_first(self, a, b, g) -> np.ndarray:
        """Whether ``g`` is the smallest filter that the vectors share: their
        ascending lists are searched only as far as needed."""
        out = np.zeros(len(a), dtype=bool)
        open_ = np.arange(len(a))
        k = 0
        while len(open_):
            open_ = open_[k < self.size[a[open_]]]
            f = self.flat[self.start[a[open_]] + k]
            here = f == g[open_]
            out[open_[here]] = True
            key = self._named(f, b[open_])
            at = np.minimum(np.searchsorted(self.has, key), len(self.has) - 1)
            open_ = open_[~here & (self.has[at] != key)]
            k += 1
        return out

    def _hang(self, a, b) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            off = ra != rb
            if not off.any():
                return
            a, b, ra, rb = a[off], b[off], ra[off], rb[off]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:                              # point at roots again
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _count(sent: DataFrame, kind: str, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots: dict[int, list[bytes]] = {}
        for b in batches:
            for d, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                lots.setdefault(d, []).append(p)
        while lots:
            d, got = lots.popitem()
            cols = list(zip(*(_unpack(p, d, kind) for p in got)))
            base = np.cumsum([0, *(len(x) for x in cols[5])])
            owner = np.concatenate([x.astype(np.int64) + n for x, n in zip(cols[1], base)])
            key, _, f, blk, diag, own, m, size, vec, flat = (np.concatenate(x) for x in cols)
            del got, cols
            unit = vec.astype(np.float64)
            unit /= np.linalg.norm(unit, axis=1)[:, None]
            del vec
            tally = _Tally(own, m, unit, size.astype(np.int64), flat, least)
            by = np.argsort(key, kind="stable")
            key, owner, f, blk, diag = key[by], owner[by], f[by], blk[by], diag[by]
            s, c = X.run_lengths(key)
            for at, k in zip(s[c > 64], c[c > 64]):
                mem = owner[at:at + k]
                for lo in range(0, k, 1024):
                    for hi in range(lo, k, 1024):
                        near = tally.near(mem[lo:lo + 1024], mem[hi:hi + 1024])
                        if lo == hi:
                            near &= np.tri(*near.shape, -1, dtype=bool).T
                        x, y = np.nonzero(near)
                        x, y = x + at + lo, y + at + hi
                        ok = (diag[x] == 1) | (blk[x] != blk[y])
                        tally.add(owner[x[ok]], owner[y[ok]], f[x[ok]])
            for k in np.unique(c[(c > 1) & (c <= 64)]):
                starts = s[c == k]
                later = np.tri(k, k, -1, dtype=bool).T
                step = max(1, (1 << 15) // k)
                for lo in range(0, len(starts), step):
                    at = starts[lo:lo + step, None] + np.arange(k)
                    g, x, y = np.nonzero(tally.near(owner[at], owner[at]) & later)
                    x, y = at[g, x], at[g, y]
                    ok = (diag[x] == 1) | (blk[x] != blk[y])
                    tally.add(owner[x[ok]], owner[y[ok]], f[x[ok]])
            some = np.flatnonzero(tally.links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[some]), pa.array(tally.links[some]), pa.array(own[tally.root[some]])],
                names=["own", "links", "root"])

    return sent.mapInArrow(run, OUT)


def _linked(lists: DataFrame, kind: str, least: float, block: int) -> DataFrame:
    """Links of all partitions, round by round."""
    spark = lists.sparkSession
    size = F.col("d").cast("double") * int(kind[-1])
    n, sent, kept = lists.agg(F.sum("n"), F.sum(F.col("n") * (size + 2 * F.col("n") + _RECORD)),
                              F.sum(size + 4 * F.col("n") + 56)).first()
    if not n:
        return spark.createDataFrame([], OUT)
    hot, nb, more = _crowded(lists, block)
    sent *= (n + more) / n
    rounds = max(1, int(-(-sent // max(ROUND * kept, ROUND_BYTES))))
    parts = max(C.shuffle_parts(spark), int(-(-sent // (rounds * PART))))
    crowded = spark.sparkContext.broadcast((hot, nb))
    out = None
    for turn in range(rounds):
        got = C.stage_freed(_count(_send(lists, kind, crowded, turn, rounds, parts), kind, least), "cap-links")
        out = got if out is None else out.unionByName(got)
    return out


def link(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
         least: float = LEAST, cut: float = CUT, tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``."""
    spark = vectors.sparkSession
    C.bound_batches(spark)
    of = vectors.select(C.column(vector)).schema[0].dataType
    single = isinstance(of, T.ArrayType) and isinstance(of.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"
    rows = vectors.select(C.column(key).cast("long").alias("id"), C.column(label).cast("long").alias("label"),
                          C.column(vector).cast("array<float>" if single else "array<double>").alias("vec"))
    rows = rows.withColumn("ok", usable("vec", ("id", "label"))
                           & F.coalesce(F.exists("vec", lambda e: e != 0), F.lit(False)))
    # Rows meet their vector again by two hashes, so vectors travel only once.
    h1, h2 = F.xxhash64("label", "vec").alias("h1"), F.xxhash64("vec", "label").alias("h2")
    reps = rows.filter("ok").groupBy("label", "vec").agg(F.min("id").alias("own"), F.count(F.lit(1)).alias("m"))
    # Two rows may share an id but not a vector; a number keeps them apart.
    reps = reps.select(F.monotonically_increasing_id().alias("node"), "own", h1, h2, "m", "label", "vec")
    lists = C.stage_freed(_filters(reps, kind, cut, tables), "cap-filters")
    got = _linked(lists, kind, least, block)
    links = got.groupBy("own").agg(F.sum("links").alias("links")).withColumnRenamed("own", "node")
    edges = got.select(F.col("own").alias("a"), F.col("root").alias("b"))
    twins = lists.groupBy("own").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    twins = lists.join(twins, "own").select(F.col("node").alias("a"), "b")
    comp = components(edges.union(twins))
    nodes = lists.select("node", "own", "h1", "h2", "m")
    low = comp.join(nodes.select("node", "own"), "node").groupBy("root").agg(F.min("own").alias("component_id"))
    info = (nodes.join(links, "node", "left").join(comp, "node", "left").join(low, "root", "left")
            .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"),
                    F.coalesce("component_id", "own").alias("component_id")))
    linked = rows.filter("ok").select("id", h1, h2).join(info, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.filter("not ok").select("id", F.lit(0).cast("long").alias("n_links"),
                                         F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))

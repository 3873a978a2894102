"""Approximate nearest neighbours by cross-polytope hashing (Andoni et al. 2015).

``search`` finds every query's ``k`` nearest rows by Euclidean distance.

* Hash: a unit vector is turned by a pseudo-rotation (random signs and a
  Walsh-Hadamard transform, three times) and assigned to its nearest signed axis,
  one of ``2 * w`` cells (``w``: the length, up to a power of two). There are
  ``tables`` independent rotations.
* Multiprobe: a query asks in each table its ``probes`` nearest signed axes, so few
  tables serve many neighbours.
* Join: every row goes to its cell of each table that any query asks, every
  query to the cells it asks. A cell of more than ``BLOCK`` rows or ``QUERIES``
  queries is dealt as pairs of blocks, so a crowded cell is work for many tasks.
  Spark sorts what meets; a task holds one block's queries and one Arrow batch
  of rows, whatever the sizes are.
* Rerank: all that meet are compared. Products of whole blocks leave about ``k``
  rows per query, whose distances are computed from the original vectors in double
  precision; those decide, and only they are passed on.

All rows are indexed, nothing is fitted and no list is cut. Cells hold directions
only: near vectors of unlike length can lie in cells further apart. Queries that
find fewer than ``k`` rows are compared with all rows, block by block, so they get
``k`` (or all rows, if fewer). Recall and the share of rows compared are
in the README; more ``probes`` or ``tables`` raise both.

Ties go to the smaller id. Rows that repeat an id are one candidate, at its nearest
vector, and one query, by the smallest vector; a query never finds its own id.
Vectors that are null, empty, zero or hold null or non-finite components and rows
without an id take no part; only vectors of equal length are compared. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripframe.llm import common as C
from tripframe.llm.caps import _by_length, _hadamard, _matrix, usable

TABLES, PROBES = 10, 12
BLOCK, QUERIES = 4096, 1024
SEED = 11
_SLICE = 4096
_ROOM = 1e-9
HASHED = "id long, d int, vec binary, cells array<int>"
FOUND = "query_id long, vec_id long, score double"


def turned(unit: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """Unit vectors under the pseudo-rotation of a table."""
    d = unit.shape[1]
    wide = max(2, 1 << (d - 1).bit_length())
    x = np.zeros((len(unit), wide))
    x[:, :d] = unit
    rng = np.random.default_rng([seed, table, d])
    for _ in range(3):
        x = _hadamard(x * rng.choice([-1.0, 1.0], wide))
    return x


def cells(unit: np.ndarray, tables: int, probes: int = 1, seed: int = SEED) -> np.ndarray:
    """Per vector, the cells of its ``probes`` nearest signed axes in every table
    (axis ``a`` has the cells ``2 a`` and, if negative, ``2 a + 1``)."""
    out = []
    for t in range(tables):
        x = turned(unit, t, seed)
        w = x.shape[1]
        if probes == 1:
            a = np.abs(x).argmax(axis=1)
            c = (2 * a + (x[np.arange(len(x)), a] < 0))[:, None]
        else:
            s = np.empty((len(x), 2 * w))
            s[:, ::2], s[:, 1::2] = x, -x
            n = min(probes, 2 * w)
            c = np.argpartition(-s, n - 1, axis=1)[:, :n]
        out.append(c + t * 2 * w)
    return np.hstack(out).astype(np.int32)


def _hashed(rows: DataFrame, kind: str, tables: int, probes: int, seed: int) -> DataFrame:
    """``id, d, vec`` (packed) and ``cells`` of every row ``(id, vec)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for d, same in _by_length(whole, 1):
                for lo in range(0, same.num_rows, _SLICE):
                    b = same.slice(lo, _SLICE)
                    v = _matrix(b.column(1))
                    unit = v / np.abs(v).max(axis=1)[:, None]
                    unit /= np.linalg.norm(unit, axis=1)[:, None]
                    c = cells(unit, tables, probes, seed)
                    raw = v.astype(kind)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), pa.array(np.full(len(v), d, np.int32)),
                         pa.array([r.tobytes() for r in raw], pa.binary()),
                         pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * c.shape[1], pa.int32()),
                                                  pa.array(c.ravel()))],
                        names=["id", "d", "vec", "cells"])

    return rows.mapInArrow(run, HASHED)


def nearest(qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray, k: int
            ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query id, row id, distance) of the ``k`` nearest ids of every slice of
    rows per query."""
    for lo in range(0, len(x), _SLICE):
        by = np.argsort(xid[lo:lo + _SLICE], kind="stable")
        ids, y = xid[lo:lo + _SLICE][by], x[lo:lo + _SLICE][by]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        y2 = (y * y).sum(axis=1)
        for at in range(0, len(q), 256):
            p, pid = q[at:at + 256], qid[at:at + 256]
            p2 = (p * p).sum(axis=1)
            far = p2[:, None] + y2[None, :]
            room = _ROOM * far
            far -= 2 * (p @ y.T)
            far[ids[None, :] == pid[:, None]] = np.inf
            low = far if len(first) == len(ids) else np.minimum.reduceat(far, first, axis=1)
            if low.shape[1] > k:                    # the k-th nearest id, with room for rounding
                cut = np.partition(low, k - 1, axis=1)[:, k - 1] + 2 * room.max(axis=1)
                r, c = np.nonzero((far <= cut[:, None]) & np.isfinite(far))
            else:
                r, c = np.nonzero(np.isfinite(far))
            dist = np.sqrt(((p[r] - y[c]) ** 2).sum(axis=1))
            by = np.lexsort((dist, ids[c], r))
            r, c, dist = r[by], c[by], dist[by]
            one = np.r_[True, (r[1:] != r[:-1]) | (ids[c][1:] != ids[c][:-1])][:len(r)]
            r, c, dist = r[one], c[one], dist[one]
            by = np.lexsort((ids[c], dist, r))
            r, c, dist = r[by], c[by], dist[by]
            start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]][:len(r)])
            rank = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
            ok = rank < k
            yield pid[r[ok]], ids[c[ok]], dist[ok]


def _compare(meeting: DataFrame, kind: str, k: int) -> DataFrame:
    """Nearest rows of what is sorted by ``d, cell, b, o, side`` (queries are
    side 0): a block's queries are kept, its rows pass by."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, qid, q = None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            place = np.stack([b.column(i).to_numpy() for i in range(5)], axis=1)
            ids = b.column(5).to_numpy()
            vec = b.column(6)
            off = np.frombuffer(vec.buffers()[1], np.int32)[vec.offset:vec.offset + len(vec) + 1]
            data = vec.buffers()[2]
            cut = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(axis=1)])
            for lo, hi in zip(cut, [*cut[1:], len(place)]):
                d, side = int(place[lo, 0]), place[lo, 4]
                v = np.frombuffer(data, kind, (off[hi] - off[lo]) // np.dtype(kind).itemsize, off[lo])
                v = v.reshape(-1, d).astype(np.float64)
                at = tuple(place[lo, :4])
                if at != here:
                    here, qid, q = at, [], []
                if side == 0:
                    qid.append(ids[lo:hi])
                    q.append(v)
                elif qid:
                    if len(qid) > 1:
                        qid, q = [np.concatenate(qid)], [np.concatenate(q)]
                    for a, r, s in nearest(qid[0], q[0], ids[lo:hi], v, k):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(r), pa.array(s)],
                                                         names=["query_id", "vec_id", "score"])

    return meeting.mapInArrow(run, FOUND)


def _meet(asks: DataFrame, rows: DataFrame, parts: int, kind: str, k: int) -> DataFrame:
    """Compare queries ``d, cell, id, vec`` with rows of the same cell."""
    keys = ["d", "cell"]
    size = (asks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")), keys)
            .select(*keys, F.ceil(F.col("n") / QUERIES).cast("int").alias("nq"),
                    F.ceil(F.col("m") / BLOCK).cast("int").alias("nx")))

    def dealt(df: DataFrame, side: int, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("id", "vec"), F.col(own)).cast("int")
        x = df.join(size, keys).select(*keys, "id", "vec", mine.alias("mine"),
                                       F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("theirs"))
        b, o = ("theirs", "mine") if side == 0 else ("mine", "theirs")
        return x.select(*keys, F.col(b).alias("b"), F.col(o).alias("o"), F.lit(side).alias("side"), "id", "vec")

    both = dealt(asks, 0, "nq", "nx").union(dealt(rows, 1, "nx", "nq"))
    return _compare(both.repartition(parts, "d", "cell", "b", "o")
                    .sortWithinPartitions("d", "cell", "b", "o", "side"), kind, k)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))


def search(vectors: DataFrame, query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding",
           tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """``query_id, rank`` (from 1), ``vec_id, score`` (the distance) for every
    usable row that ``query`` (a condition on ``id``) selects."""
    spark = vectors.sparkSession
    C.bound_batches(spark)
    parts = C.shuffle_parts(spark)
    held = vectors.schema[vector].dataType
    small = isinstance(held, T.ArrayType) and isinstance(held.elementType, T.FloatType)
    kind = "<f4" if small else "<f8"                # as read; compared as doubles
    rows = vectors.select(C.column(key).cast("long").alias("id"),
                          C.column(vector).cast(f"array<{'float' if small else 'double'}>").alias("vec"))
    rows = rows.filter(usable("vec", ("id",)) & F.coalesce(F.exists("vec", lambda e: e != 0), F.lit(False)))
    asked = rows.filter(query).groupBy("id").agg(F.min("vec").alias("vec"))
    x = C.stage(_hashed(rows, kind, tables, 1, seed), "ann-rows")
    q = C.stage(_hashed(asked, kind, tables, probes, seed), "ann-queries")

    def spread(df: DataFrame) -> DataFrame:
        return df.select("d", F.explode("cells").alias("cell"), "id", "vec")

    got = C.stage(_best(_meet(spread(q), spread(x), parts, kind, k), k), "ann-found")
    enough = got.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = C.stage(q.join(enough, "id", "left_anti").select("d", "id", "vec"), "ann-short")
    if short.limit(1).count():
        blocks = x.select("d", F.lit(0).alias("cell"), "id", "vec")
        rest = _best(_meet(short.select("d", F.lit(0).alias("cell"), "id", "vec"), blocks, parts, kind, k), k)
        got = got.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
    return got.select("query_id", "rank", "vec_id", "score")

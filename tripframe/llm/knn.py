"""Exact top-k search by multi-resolution segment statistics.

``search`` gives every query's ``k`` best rows by integer inner product of
``floor(scale * x)``. Vectors are cut into segments; a segment keeps its mean
and its deviation (the norm of what is left after the mean). For two vectors,
``sum(len * mean * mean') + sum(dev * dev')`` over the segments is at least
their inner product, so ``|q|^2 + |x|^2`` less twice that is a lower bound of
their squared distance; more segments make it tighter. A task works from coarse
to fine: a few rows with the best coarse bounds are computed exactly and give a
threshold per query, rows whose coarse bound stays below it leave, then those
whose finer bound does, and the exact products of the survivors decide.

Queries and rows meet block by block: rows are packed into blocks of about
``ROWS`` vectors, queries into blocks of about ``QUERIES``, and every block of
queries travels to every block of rows by an equi-join on the block number. A
task holds one pair of blocks; its result is ``k`` rows per query, which a window with
a partial limit before the shuffle reduces to ``k``.

Ties go to the smaller id. Rows with the query's own id never are its results.
Vectors that are null, empty or hold null or non-finite components and rows
without an id take no part; only vectors of equal length are compared. Rows that
repeat an id are separate candidates (and one query, by the smallest vector).
Fewer than ``k`` candidates give all of them. Scores beyond 64 bits are clamped.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripframe.llm import common as C
from tripframe.llm.caps import usable

ROWS, QUERIES, CHUNK = 8192, 1024, 128
LEVELS = (4, 16)
FIRST = 32
EXACT = float(1 << 53)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per vector, ``sqrt(len) * mean`` and deviation of every segment: the
    product of two such rows bounds the vectors' inner product from above."""
    d = x.shape[1]
    n = min(segments, d)
    cut = np.arange(n + 1) * d // n
    size = np.diff(cut)
    mean = np.add.reduceat(x, cut[:-1], axis=1) / size
    rest = x - np.repeat(mean, size, axis=1)
    dev = np.sqrt(np.add.reduceat(rest * rest, cut[:-1], axis=1))
    return np.hstack([mean * np.sqrt(size), dev])


def _bound(q: np.ndarray, x: np.ndarray, segments: int) -> np.ndarray:
    """Upper bounds of inner products, with room for rounding."""
    b = statistics(q, segments) @ statistics(x, segments).T
    room = 1e-9 * (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])
    return b + room + 1e-9


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products as 64-bit integers."""
    if q.size and x.size and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] >= EXACT:
        big = (1 << 63) - 1
        a = [[int(v) for v in r] for r in q]
        b = [[int(v) for v in r] for r in x]
        return np.array([[max(-big, min(big, sum(u * v for u, v in zip(r, s)))) for s in b] for r in a],
                        dtype=np.int64).reshape(len(q), len(x))
    return (q @ x.T).astype(np.int64)


def best(qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray, k: int
         ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, score) of the ``k`` best rows of a block per query."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low = np.iinfo(np.int64).min
    for lo in range(0, len(q), CHUNK):
        ids, p = qid[lo:lo + CHUNK], q[lo:lo + CHUNK]
        alive = xid[None, :] != ids[:, None]
        threshold = np.full(len(p), -np.inf)
        coarse = np.where(alive, _bound(p, x, LEVELS[0]), -np.inf)
        if len(x) > FIRST:
            head = np.argpartition(-coarse, FIRST - 1, axis=1)[:, :FIRST]
            some = np.unique(head)
            s = np.where(alive[:, some], _exact(p, x[some]), low)
            if len(some) >= k:
                kth = np.partition(s, len(some) - k, axis=1)[:, len(some) - k]
                threshold = np.where(kth > low, kth.astype(np.float64), -np.inf)
        alive &= coarse >= threshold[:, None]
        for level in LEVELS[1:]:
            cols = np.flatnonzero(alive.any(axis=0))
            alive[:, cols] &= _bound(p, x[cols], level) >= threshold[:, None]
        cols = np.flatnonzero(alive.any(axis=0))
        if not len(cols):
            continue
        s = np.where(alive[:, cols], _exact(p, x[cols]), low)
        if len(cols) > k:
            kth = np.partition(s, len(cols) - k, axis=1)[:, len(cols) - k]
            take = alive[:, cols] & (s >= kth[:, None])
        else:
            take = alive[:, cols]
        r, c = np.nonzero(take)
        score, row = s[r, c], xid[cols[c]]
        by = np.lexsort((row, -score.astype(object) if (score == low).any() else -score, r))
        r, score, row = r[by], score[by], row[by]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        rank = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
        ok = rank < k
        out.append((ids[r[ok]], row[ok], score[ok]))
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out))


def _pack(rows: DataFrame, size: int, what: str, scale: float) -> DataFrame:
    """Blocks ``(what, d, ids, vectors)`` of about ``size`` rows."""
    n = max(1, -(-rows.count() // size))

    def run(t: pa.Table) -> pa.Table:
        by = np.argsort(t.column("id").to_numpy(), kind="stable")
        v = t.column("vec").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        v = np.floor(scale * v)[by]
        return pa.table({what: t.column("block").slice(0, 1), "d": t.column("d").slice(0, 1),
                         f"{what}_ids": pa.array([t.column("id").to_numpy()[by].tobytes()], pa.binary()),
                         f"{what}_vec": pa.array([v.astype("<f8").tobytes()], pa.binary())})

    return (rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(n)))
            .withColumn("d", F.size("vec")).groupBy("block", "d")
            .applyInArrow(run, f"{what} long, d int, {what}_ids binary, {what}_vec binary"))


def search(vectors: DataFrame, query: Column, k: int = 5, scale: float = 256.0, key: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """``query_id, rank`` (from 1), ``vec_id, score`` for every usable row that
    ``query`` (a condition on ``id``) selects."""
    spark = vectors.sparkSession
    C.bound_batches(spark)
    rows = vectors.select(C.column(key).cast("long").alias("id"),
                          C.column(vector).cast("array<double>").alias("vec"))
    rows = C.stage(rows.filter(usable("vec", ("id",))), "knn-rows")
    blocks = C.stage(_pack(rows, ROWS, "block", scale), "knn-blocks")
    asked = rows.filter(query).groupBy("id").agg(F.min("vec").alias("vec"))
    queries = _pack(asked, QUERIES, "query", scale)
    # One row per pair of blocks: the stated queries against all rows.
    sent = queries.join(blocks.groupBy("d").agg(F.collect_list("block").alias("to")), "d").select(
        "d", "query_ids", "query_vec", F.explode("to").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, qi, qv, xi, xv in zip(*(c.to_pylist() for c in b.columns)):
                q = np.frombuffer(qv, "<f8").reshape(-1, d)
                x = np.frombuffer(xv, "<f8").reshape(-1, d)
                a, r, s = best(np.frombuffer(qi, "<i8"), q, np.frombuffer(xi, "<i8"), x, k)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(r), pa.array(s)],
                                                 names=["query_id", "vec_id", "score"])

    got = (sent.join(blocks, ["d", "block"]).select("d", "query_ids", "query_vec", "block_ids", "block_vec")
           .mapInArrow(run, "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (got.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

"""N-gram Jaccard join by PartEnum signatures (Arasu, Ganti, Kaushik 2006).

Documents are sets of word shingles (``wordhash``). ``join`` finds all pairs of
different sets with ``100 * |A & B| >= percent * |A | B|`` and their components.

1. Size bands grow by the factor ``100 / percent``, so linked sets are in equal
   or neighbouring bands. A group covers two neighbouring bands, and a set
   signs in both groups of its band.
2. In a group the shingle domain is split into ``n`` parts by hash. Linked sets
   differ in at most ``k = (100 - percent) (|A| + |B|) / (100 + percent)``
   shingles, which touch at most ``k`` parts; in all others the sets agree. A
   signature is the hash of a set's shingles in one part. ``n`` is chosen so
   that a set has more than ``k`` parts that aren't empty; then only those
   need signing. A set with ``k`` or fewer of them (tiny sets) signs its empty
   parts too, which keeps the guarantee.
3. Agreeing signatures of a linked pair number at least (non-empty parts - k).
   So each set leaves out that many less one of its signatures, those shared
   by most sets first, in one order for all sets: the rarest common signature
   of a linked pair stays on both sides. That removes what frequent passages
   have in common without losing a pair.
4. Sets that share a signature: first each is compared with the run's earliest
   set. In a second step, pairs that are still in different components are
   compared; pairs whose exclusive-or bitmaps differ in more than ``k`` bits
   can't be linked and are dropped first, in the task. So copies and near
   copies cost work by their number, not all pairs, and no link between
   components is missed. A run of more than ``BLOCK`` sets is dealt as pairs of
   blocks over the cluster, a component of more than ``BLOCK`` sets in blocks of
   its own, which meet only the blocks of others; so a task holds two blocks.

Equal sets are one set from the start. Signatures travel packed
(``exchange``), are matched by Spark partition, and verified on whole sets.
Coincidences of short signature hashes only make more pairs to verify. Two
coincidences could change a result: sets whose 63-bit hashes agree are taken as equal,
unverified (about ``d * d / 2 ** 64`` such pairs among ``d`` different sets: 5e-6 at
10^7, a few at 10^10), and shingles of one pair of sets whose 48-bit hashes agree count as one.

Null or empty texts have no shingles and link with nothing. Rows that repeat an
id count as one node for components (ids must tell documents apart); each row
gets its result. Null ids are kept, and never are a component's id unless its
members have none. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripframe.llm import common as C
from tripframe.llm import exchange as X
from tripframe.llm import wordhash as W
from tripframe.llm.components import components

PERCENT, WORDS = 75, 5
NO_ID = (1 << 63) - 1
BLOOM_BITS = 1 << 23
BLOCK = 1024
#: Bytes of signatures and bitmaps that a block of a crowded run may hold, and of text
#: that is hashed at once.
BLOCK_BYTES, SLICE_BYTES = 8 << 20, 2 << 20
#: Said once per set and group on the way to a signature: the set's hash, whose lowest
#: bit (never set in the hash) tells which of its two groups. The rest is known where
#: the set's documents are.
TABLE = ("<u8",)
#: Bytes of a signature on its way; with its partition that makes 48 bits and more.
SIG_BYTES = 4
_1, _32 = np.uint64(1), np.uint64(32)
_G1, _G2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
ROWS = "part int, doc_id long, own long, n int, g int, rep long, payload binary"


@dataclass(frozen=True)
class Scheme:
    """Bands, groups and parts for one similarity."""

    percent: int = PERCENT

    @cached_property
    def bounds(self) -> np.ndarray:
        b = [1, 2]
        while b[-1] < 1 << 40:
            b.append(100 * b[-1] // self.percent + 1)
        return np.array(b, dtype=np.int64)

    @cached_property
    def load(self) -> float:
        """Shingles per part in a group's largest set: a tenth below where the
        parts that aren't empty just number more than ``k``."""
        need = 2 * (100 - self.percent) / (100 + self.percent)
        lo, hi = 1e-6, 1e3
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if -math.expm1(-mid) / mid > need else (lo, mid)
        return 0.9 * lo

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, n, side="right") - 1

    def largest(self, g: np.ndarray) -> np.ndarray:
        """Largest size in group ``g`` (bands ``g - 1`` and ``g``)."""
        return self.bounds[g + 1] - 1

    def parts(self, g: np.ndarray) -> np.ndarray:
        return np.maximum(1, np.ceil(self.largest(g) / self.load)).astype(np.int64)

    def differ(self, r: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Most shingles in which linked sets of these sizes differ."""
        return (100 - self.percent) * (r + s) // (100 + self.percent)

    def differ_most(self, n: np.ndarray, g: np.ndarray) -> np.ndarray:
        return self.differ(n, np.minimum(self.largest(g), 100 * n // self.percent))

    def sizes_fit(self, r: np.ndarray, s: np.ndarray) -> np.ndarray:
        return 100 * np.minimum(r, s) >= self.percent * np.maximum(r, s)


def set_hash(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """63-bit hash of every row's set, the lowest bit clear (0 for empty sets)."""
    c = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(W.mix(h ^ _G2), out=c[1:])
    n = np.diff(off).astype(np.uint64)
    return np.where(n > 0, W.mix((c[off[1:]] - c[off[:-1]]) ^ (n * _G1)) & ~_1, 0).astype(np.uint64)


def signatures(h: np.ndarray, off: np.ndarray, rows: np.ndarray, scheme: Scheme
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the sets ``rows``: (signature, row of the table) and the table's
    columns (index into ``rows`` and group, with signatures to leave out)."""
    n = np.diff(off)[rows]
    own = np.repeat(np.arange(len(rows)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(off[rows], n)
    x = h[at]
    sigs, owners, groups, drops = [], [], [], []
    for d in (0, 1):                        # groups of the set's band
        g = scheme.band(n) + d
        parts = scheme.parts(g)
        salt = W.mix((g + 1).astype(np.uint64) * _G1)
        p = (W.mix(x ^ salt[own]) % parts[own].astype(np.uint64)).astype(np.int64)
        key = (own << 40) + p
        order = np.argsort(key, kind="stable")
        s, _ = X.run_lengths(key[order])
        total = np.add.reduceat(W.mix(x[order] ^ _G1), s) if len(s) else np.empty(0, np.uint64)
        o, q = key[order][s] >> 40, key[order][s] & ((1 << 40) - 1)
        full = np.bincount(o, minlength=len(rows))
        most = scheme.differ_most(n, g)
        for i in np.flatnonzero((full <= most) & (n > 0)):
            void = np.setdiff1d(np.arange(parts[i]), q[np.searchsorted(o, i):np.searchsorted(o, i, "right")])
            o, q = np.r_[o, np.full(len(void), i)], np.r_[q, void]
            total = np.r_[total, np.zeros(len(void), np.uint64)]
            by = np.argsort(o, kind="stable")
            o, q, total = o[by], q[by], total[by]
        sigs.append(W.mix(total + W.mix(q.astype(np.uint64) * _G2 + salt[o])))
        owners.append(o + d * len(rows))
        groups.append(g)
        drops.append(np.maximum(0, full - most - 1))
    return (np.concatenate(sigs), np.concatenate(owners), np.concatenate(groups), np.concatenate(drops))


def _rows(**cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    kinds = {"part": pa.int32(), "doc_id": pa.int64(), "own": pa.int64(), "n": pa.int32(), "g": pa.int32(),
             "rep": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[k], t) if k in cols else pa.nulls(n, t) for k, t in kinds.items()], names=list(kinds))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``SLICE_BYTES`` of text, at least one row each."""
    for b in batches:
        if not b.num_rows:
            continue
        _, off = W.text_bytes(b.column(1))
        cut = np.flatnonzero(np.diff(off[:-1] // SLICE_BYTES)) + 1
        for lo, hi in zip([0, *cut], [*cut, b.num_rows]):
            yield b.slice(lo, hi - lo)


def _sign(docs: DataFrame, parts: int, scheme: Scheme, words: int) -> DataFrame:
    """Documents by set (``rep`` holds the signatures the set may leave out in its two
    groups, said by one document of a batch) and packed signatures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            ids = b.column(0)
            h, off = W.shingles(b.column(1), words)
            own, n = set_hash(h, off), np.diff(off)
            _, rows = np.unique(own, return_index=True)   # equal sets of a batch sign once
            rows = rows[n[rows] > 0]
            sig, owner, _, drop = signatures(h, off, rows, scheme)
            del h
            first, second = drop[:len(rows)], drop[len(rows):]
            spare = np.full(len(n), -1, dtype=np.int64)
            spare[rows] = (first << 32) | second
            yield _rows(part=X.part_of(own, parts), doc_id=ids, own=own.view(np.int64), n=n.astype(np.int32),
                        g=np.full(len(n), -1, np.int32), rep=spare)
            got = list(X.scatter(X.part_of(sig, parts), sig, owner, [np.r_[own[rows], own[rows] | _1]], size=SIG_BYTES))
            if got:
                yield _rows(part=[p for p, _ in got], g=[-2] * len(got), payload=[x for _, x in got])

    return docs.mapInArrow(run, ROWS)


def _collect(batches: Iterator[pa.RecordBatch], payloads: list[bytes], found: list | None = None
             ) -> Iterator[pa.RecordBatch]:
    """Pass the documents' rows on and keep the packed records (``found``: with the
    number of their partition)."""
    for b in batches:
        g = b.column(4)
        doc = pc.equal(g, -1)
        mine = b.filter(pc.invert(doc))
        payloads += mine.column(6).to_pylist()
        if found is not None:
            found += mine.column(0).to_pylist()
        rest = b.filter(doc)
        if rest.num_rows:
            yield rest


def _shared(signed: DataFrame, parts: int) -> DataFrame:
    """Signatures of two sets or more, by set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        payloads: list[bytes] = []
        where: list[int] = []
        yield from _collect(batches, payloads, where)
        # A Spark partition may hold several of the numbered ones; a signature is told by both.
        for part in sorted(set(where)):
            key, owner, (own,), _ = X.gather([p for p, w in zip(payloads, where) if w == part], TABLE, size=SIG_BYTES)
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            s, c = X.run_lengths(key)
            several = np.repeat(c > 1, c)
            key, owner = key[several], owner[several]
            by = np.lexsort((own[owner], key))
            key, owner = key[by], owner[by]
            new = np.ones(len(key), dtype=bool)       # equal sets of other batches
            new[1:] = (key[1:] != key[:-1]) | (own[owner[1:]] != own[owner[:-1]])
            key, owner = key[new], owner[new]
            s, c = X.run_lengths(key)
            several = np.repeat(c > 1, c)
            often = np.minimum(255, 4 * np.log2(np.repeat(c, c)))[several].astype(np.uint8)
            key = X.low48(W.mix(key[several] | (np.uint64(part) << _32)))
            owner = owner[several]
            got = list(X.scatter(X.part_of(own[owner], parts), key, owner, [own], [often]))
            if got:
                yield _rows(part=[p for p, _ in got], g=[-2] * len(got), payload=[x for _, x in got])

    return signed.mapInArrow(run, ROWS)


def _set_info(docs: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the documents of a partition, per set: hash, earliest id, size, signatures
    to leave out."""
    own = np.concatenate([b.column(2).to_numpy() for b in docs]).view(np.uint64)
    ids = np.concatenate([b.column(1).fill_null(NO_ID).to_numpy() for b in docs])
    n = np.concatenate([b.column(3).to_numpy() for b in docs]).astype(np.int64)
    spare = np.concatenate([b.column(5).to_numpy() for b in docs])
    by = np.lexsort((ids, own))
    s, _ = X.run_lengths(own[by])
    return own[by][s], ids[by][s], n[by][s], np.maximum.reduceat(spare[by], s)


def _pruned(shared: DataFrame, scheme: Scheme) -> DataFrame:
    """Per set and group, the signatures that stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        payloads: list[bytes] = []
        docs = []
        for b in _collect(batches, payloads):
            docs.append(b)
            yield b
        if not payloads:
            return
        key, owner, (own,), (often,) = X.gather(payloads, TABLE, ["u1"])
        del payloads
        sets, first, size, spare = _set_info(docs)
        by = np.lexsort((key, 255 - often, own[owner]))
        key, mine = key[by], own[owner[by]]
        new = np.ones(len(key), dtype=bool)
        new[1:] = mine[1:] != mine[:-1]
        s = np.flatnonzero(new)
        end = np.r_[s[1:], len(key)]
        at = np.searchsorted(sets, mine[s] & ~_1)
        d = (mine[s] & _1).astype(np.int64)
        g = scheme.band(size[at]) + d
        s2 = s + np.where(d == 0, spare[at] >> 32, spare[at] & 0xFFFFFFFF)
        left = np.flatnonzero(s2 < end)
        for lo in range(0, len(left), 2000):
            i = left[lo:lo + 2000]
            yield _rows(own=sets[at[i]].view(np.int64), n=size[at[i]].astype(np.int32), g=g[i].astype(np.int32),
                        rep=first[at[i]], payload=[key[a:b].tobytes() for a, b in zip(s2[i], end[i])])

    return shared.mapInArrow(run, ROWS)


PAIRS = "a long, b long"


#: Said once per set on its way to a signature: set hash, earliest id, size.
_MEMBER = ("<u8", "<i8", "<u4")
#: Said once per set and run owner: the run's earliest set, the set, their sizes.
_UNDER = ("<u8", "<u8", "<u4", "<u4")


def _by_signature(cand: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = [np.frombuffer(x, "<u8") for x in b.column(4).to_pylist()]
            owner = np.repeat(np.arange(len(sigs)), [len(x) for x in sigs])
            key = np.concatenate(sigs) if sigs else np.empty(0, "<u8")
            table = [b.column(0).to_numpy().view("<u8"), b.column(2).to_numpy(),
                     b.column(1).to_numpy().astype("<u4")]
            got = list(X.scatter(X.part_of(W.mix(key), parts), key, owner, table))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int32()),
                                              pa.array([x for _, x in got], pa.binary())], names=["part", "payload"])

    return cand.mapInArrow(run, "part int, payload binary").repartitionById(parts, F.col("part"))


def _runs(cand: DataFrame, parts: int, scheme: Scheme) -> DataFrame:
    """Sets that share signatures, gathered under the earliest set of each run:
    ``center, own, n, fit`` (may its size be linked with the center's), ``sigs``.
    A set stands under few centers, though it may have many signatures."""
    def earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        payloads = [x for b in batches for x in b.column(1).to_pylist()]
        key, owner, (own, rep, n), _ = X.gather(payloads, _MEMBER)
        by = np.argsort(key, kind="stable")
        key, owner = key[by], owner[by]
        s, c = X.run_lengths(key)
        several = np.repeat(c > 1, c)
        key, owner = key[several], owner[several]
        by = np.lexsort((own[owner], rep[owner], key))
        key, owner = key[by], owner[by]
        s, c = X.run_lengths(key)
        head = owner[np.repeat(s, c)]
        pair = W.mix(own[head] ^ W.mix(own[owner] + _G2))
        _, first, inv = np.unique(pair, return_index=True, return_inverse=True)
        table = [own[head][first], own[owner][first], n[head][first], n[owner][first]]
        got = list(X.scatter(X.part_of(W.mix(own[head]), parts), key, inv, table))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int32()),
                                          pa.array([x for _, x in got], pa.binary())], names=["part", "payload"])

    def under(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        payloads = [x for b in batches for x in b.column(1).to_pylist()]
        key, owner, (center, own, m, n), _ = X.gather(payloads, _UNDER)
        by = np.lexsort((key, own[owner], center[owner]))
        key, owner = key[by], owner[by]
        pair = W.mix(center[owner] ^ W.mix(own[owner] + _G2))
        s, c = X.run_lengths(pair)
        o = owner[s]
        fit = scheme.sizes_fit(m[o].astype(np.int64), n[o].astype(np.int64))
        for lo in range(0, len(s), 4000):
            q = slice(lo, lo + 4000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(center[o[q]].view(np.int64)), pa.array(own[o[q]].view(np.int64)),
                 pa.array(n[o[q]].astype(np.int32)), pa.array(fit[q]),
                 pa.array([key[i:i + k].tobytes() for i, k in zip(s[q], c[q])], pa.binary())],
                names=["center", "own", "n", "fit", "sigs"])

    return (_by_signature(cand, parts).mapInArrow(earliest, "part int, payload binary")
            .repartitionById(parts, F.col("part"))
            .mapInArrow(under, "center long, own long, n int, fit boolean, sigs binary"))


def _fold(bits: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(bits, dtype="<u8")
    while len(x) > size:
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return x


def _together(sigs: list[np.ndarray], cut: int = 0, block: int = 512, wide: int = 16384
              ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in ``sigs`` that share a signature, each once, by
    products of 0/1 matrices: blocks of members by blocks of signatures. With
    ``cut`` only pairs of a place from there on and one before it."""
    flat = np.concatenate(sigs)
    names, col = np.unique(flat, return_inverse=True)
    off = np.r_[0, np.cumsum([len(s) for s in sigs])]

    def dense(i: int, s0: int) -> np.ndarray:
        lo, hi = off[i], off[min(i + block, len(sigs))]
        c = col[lo:hi]
        r = np.repeat(np.arange(min(block, len(sigs) - i)), np.diff(off[i:i + block + 1]))
        ok = (c >= s0) & (c < s0 + wide)
        out = np.zeros((min(block, len(sigs) - i), min(wide, len(names) - s0)), dtype=np.float32)
        out[r[ok], c[ok] - s0] = 1
        return out

    for i in range(cut, len(sigs), block):
        for j in range(0, cut or i + 1, block):
            both = sum(dense(i, s0) @ dense(j, s0).T for s0 in range(0, len(names), wide))
            x, y = np.nonzero(both > 0)
            x, y = x + i, y + j
            ok = y < (cut or x)
            yield x[ok], y[ok]


_MEMBERS = "array<struct<own:bigint,n:int,comp:bigint,sigs:binary,bits:binary>>"


def _dealt(known: DataFrame, bits: DataFrame, block: int) -> DataFrame:
    """Members of runs in different components, as pairs of blocks: ``one, two``
    (lists of members; ``two`` is null where a block meets itself). Components of
    more than ``block`` members have blocks of their own (``c``), the others share
    some (``c`` is null there, said as ``big = 0``)."""
    # A member's part of a block: one of ``block`` members or its bytes of BLOCK_BYTES.
    part = F.greatest(F.lit(1.0 / block), (F.length("sigs") + F.col("n") + 64) / F.lit(float(BLOCK_BYTES)))
    per = known.groupBy("center", "comp").agg(F.sum(part).alias("k"))
    per = per.withColumn("big", (F.col("k") > 1).cast("int"))
    run = (per.groupBy("center").agg(F.sum(F.when(F.col("big") == 0, F.col("k"))).alias("rest"),
                                     F.min("comp").alias("lo"), F.max("comp").alias("hi"))
           .filter("lo < hi").select("center", "rest"))
    per = per.join(run, "center").select(
        "center", "comp", "big", F.when(F.col("big") == 1, F.col("comp")).otherwise(F.lit(0)).alias("c"),
        F.ceil(F.when(F.col("big") == 1, F.col("k")).otherwise(F.col("rest"))).cast("int").alias("pieces"))
    piece = F.pmod(F.xxhash64(F.when(F.col("big") == 1, F.col("own")).otherwise(F.col("comp"))), F.col("pieces"))
    placed = known.join(per, ["center", "comp"]).withColumn("p", piece.cast("int")).join(bits, "own")
    lots = C.stage(placed.groupBy("center", "big", "c", "p").agg(
        F.collect_list(F.struct("own", "n", "comp", "sigs", "bits")).alias("members")), "ngram-blocks")
    same = lots.filter("big = 0").select(F.col("members").alias("one"), F.lit(None).cast(_MEMBERS).alias("two"))
    names = lots.select("center", F.struct("big", "c", "p").alias("at"))
    x, y = names.withColumnRenamed("at", "x"), names.withColumnRenamed("at", "y")
    # The blocks of a run, not its members, meet here.
    meet = x.join(y, "center").filter("x < y and not (x.big = 1 and y.big = 1 and x.c = y.c)")
    keyed = lots.select("center", F.struct("big", "c", "p").alias("at"), "members")
    cross = (meet.join(keyed.toDF("center", "x", "one"), ["center", "x"])
             .join(keyed.toDF("center", "y", "two"), ["center", "y"]).select("one", "two"))
    return same.union(cross)


def _across(runs: DataFrame, comp: DataFrame, sets: DataFrame, scheme: Scheme, block: int = BLOCK) -> DataFrame:
    """Pairs of a run in different components that their bitmaps allow."""
    # A center was compared with all its sets already, so it stays out here.
    known = runs.filter("center <> own").join(comp.withColumnRenamed("node", "own"), "own", "left").select(
        "center", "own", "n", "sigs", F.coalesce("root", "own").alias("comp"))
    dealt = _dealt(known, sets.select("own", "bits"), block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            lists = [i.column(k).flatten() for k in (0, 1)]
            cut = len(lists[0]) if len(lists[1]) else 0
            own, n, comp = (np.concatenate([v.field(k).to_numpy() for v in lists]) for k in range(3))
            n = n.astype(np.int64)
            sigs, bits = (sum([v.field(k).to_pylist() for v in lists], []) for k in (3, 4))
            width = np.array([len(v) // 8 for v in bits])
            for x, y in _together([np.frombuffer(v, "<u8") for v in sigs], cut):
                ok = (comp[x] != comp[y]) & scheme.sizes_fit(n[x], n[y])
                x, y = x[ok], y[ok]
                keep = np.zeros(len(x), dtype=bool)
                limit = scheme.differ(n[x], n[y])
                common = np.minimum(width[x], width[y])
                for w in np.unique(common):
                    at = np.flatnonzero(common == w)
                    used, inv = np.unique(np.r_[x[at], y[at]], return_inverse=True)
                    folded = np.stack([_fold(bits[u], w) for u in used])
                    for at0 in range(0, len(at), 16384):
                        q = np.arange(at0, min(at0 + 16384, len(at)))
                        far = np.bitwise_count(folded[inv[q]] ^ folded[inv[len(at) + q]]).sum(axis=1, dtype=np.int64)
                        keep[at[q]] = far <= limit[at[q]]
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(own[x[keep]]), pa.array(own[y[keep]])],
                                                     names=["a", "b"])

    return (dealt.mapInArrow(run, PAIRS)
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _bloom(ids: DataFrame) -> np.ndarray:
    """Bitmap of ids; its fixed size bounds what reaches the driver and the
    tasks. When it fills up it only lets more documents through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = W.mix(b.column(0).to_numpy().astype(np.uint64)) % np.uint64(BLOOM_BITS)
            words, bits = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
            u, inv = np.unique(words, return_inverse=True)
            out = np.zeros(len(u), dtype=np.uint64)
            np.bitwise_or.at(out, inv, bits)
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(out.view(np.int64))],
                                             names=["word", "bits"])

    rows = ids.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits"))
    got = rows.toPandas()
    out = np.zeros(BLOOM_BITS // 64, dtype=np.uint64)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _sets(docs: DataFrame, cand: DataFrame, words: int) -> DataFrame:
    """Whole sets of the candidates: ``own, n, packed, bits``."""
    wanted = cand.select("own", "rep").distinct()
    bloom = docs.sparkSession.sparkContext.broadcast(_bloom(wanted.select("rep")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = bloom.value
        for b in _slices(batches):
            ids = np.array([NO_ID if i is None else i for i in b.column(0).to_pylist()], dtype=np.int64)
            at = W.mix(ids.astype(np.uint64)) % np.uint64(BLOOM_BITS)
            ok = (filled[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            b = b.filter(pa.array(ok))
            if not b.num_rows:
                continue
            h, off = W.shingles(b.column(1), words)
            own, n = set_hash(h, off), np.diff(off)
            packed, bits = [], []
            for i in range(len(n)):
                x = np.unique(X.low48(h[off[i]:off[i + 1]]))
                packed.append(X.pack48(x))
                width = max(64, 1 << int(4 * n[i] - 1).bit_length()) if n[i] else 64
                at = (W.mix(x) % np.uint64(width)).astype(np.int64)
                odd = np.bincount(at, minlength=width).astype(np.uint8) & 1
                bits.append(np.packbits(odd, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.view(np.int64)), pa.array(ids[ok]), pa.array(n.astype(np.int32)),
                 pa.array(packed, pa.binary()), pa.array(bits, pa.binary())],
                names=["own", "rep", "n", "packed", "bits"])

    found = docs.mapInArrow(run, "own long, rep long, n int, packed binary, bits binary")
    return found.join(wanted, ["own", "rep"], "left_semi").dropDuplicates(["own"])


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sets are similar enough."""
    s = sets.select("own", "n", "packed")
    both = (pairs.join(s.toDF("b", "nb", "sb"), "b").join(s.toDF("a", "na", "sa"), "a")
            .select("a", "b", "sa", "sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for i, (p, q) in enumerate(zip(t.column(2).to_pylist(), t.column(3).to_pylist())):
                x, y = X.unpack48(p), X.unpack48(q)
                both = np.sort(np.concatenate([x, y]))
                same = int((both[1:] == both[:-1]).sum())
                if 100 * same >= percent * (len(x) + len(y) - same):
                    keep.append(i)
            k = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([t.column(0).take(k), t.column(1).take(k)], names=["a", "b"])

    return both.mapInArrow(run, PAIRS)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT,
         words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id`` (the
    smallest id that links reach, the row's own included)."""
    spark = docs.sparkSession
    C.bound_batches(spark)
    scheme, parts = Scheme(percent), C.shuffle_parts(spark)
    texts = C.keyed_text(docs, key, text)
    signed = _sign(texts, parts, scheme, words).repartitionById(parts, F.col("part"))
    shared = _shared(signed, parts).repartitionById(parts, F.col("part"))
    base = C.stage(_pruned(shared, scheme).drop("part"), "ngram-base")
    rows = base.filter("g = -1").select("doc_id", "own", "n")
    cand = base.filter("g >= 0").select("own", "n", "rep", "g", "payload")
    sets = C.stage(_sets(texts, cand, words), "ngram-sets")
    runs = C.stage(_runs(cand, parts, scheme), "ngram-runs")
    stars = runs.filter("fit and center <> own").select(F.col("center").alias("a"), F.col("own").alias("b"))
    links = C.stage(_verify(stars, sets, percent), "ngram-links")
    comp = components(links)
    more = C.stage(_verify(_across(runs, comp, sets, scheme, block), sets, percent), "ngram-links")
    if more.limit(1).count():
        comp = components(comp.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    x = rows.join(comp.withColumnRenamed("node", "own"), "own", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("root", "own")).alias("root"))
    low = (x.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("m"))
           .filter("m > 1"))
    return (x.join(low, "root", "left")
            .select("doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id")))

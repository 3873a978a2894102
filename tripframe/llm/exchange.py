"""Packed columns between Spark partitions.

Many short fixed-width records travel cheaper as a few binary values: a task
sorts its records by target partition and writes one value per target, Spark
shuffles those rows (``repartitionById``) and the receiving task unpacks them
with numpy. Records refer to a small table of owners that is packed with
them, so what is said once per owner is not repeated per record.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

_LOW48 = np.uint64((1 << 48) - 1)
_HALF = np.uint64(32)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Target partition by the upper half of 64-bit hashes."""
    return (((h >> _HALF) * np.uint64(parts)) >> _HALF).astype(np.int32)


def low48(h: np.ndarray) -> np.ndarray:
    return h & _LOW48


def pack48(h: np.ndarray, size: int = 6) -> bytes:
    """The lower 48 bits (``size`` bytes) of each value."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def unpack48(b: bytes, size: int = 6) -> np.ndarray:
    low = np.frombuffer(b, dtype=np.uint8).reshape(-1, size)
    out = np.zeros((len(low), 8), dtype=np.uint8)
    out[:, :size] = low
    return out.view("<u8").reshape(-1)


def pack(key: np.ndarray, owner: np.ndarray, table: Sequence[np.ndarray],
         extra: Sequence[np.ndarray] = (), size: int = 6) -> bytes:
    """Records (key of ``size`` bytes, none for 0, owner as a row of ``table``, extra columns);
    only the table's rows that are used are kept."""
    used, idx = np.unique(owner, return_inverse=True)
    idx = idx.astype("<u2" if len(used) <= 65536 else "<u4")
    head = np.array([len(key), len(used), idx.itemsize], dtype="<u4")
    return b"".join([head.tobytes(), pack48(key, size), idx.tobytes(),
                     *[np.ascontiguousarray(e).tobytes() for e in extra],
                     *[np.ascontiguousarray(t[used]).tobytes() for t in table]])


def unpack(b: bytes, table: Sequence[str], extra: Sequence[str] = (), size: int = 6
           ) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    n, m, w = (int(x) for x in np.frombuffer(b, dtype="<u4", count=3))
    at = 12

    def take(dtype: str, count: int) -> np.ndarray:
        nonlocal at
        a = np.frombuffer(b, dtype=dtype, count=count, offset=at)
        at += a.nbytes
        return a

    key = unpack48(b[at:at + size * n], size) if size else np.empty(0, "<u8")
    at += size * n
    idx = take("<u2" if w == 2 else "<u4", n).astype(np.int64)
    more = [take(e, n) for e in extra]
    return key, idx, [take(t, m) for t in table], more


def scatter(part: np.ndarray, key: np.ndarray, owner: np.ndarray, table: Sequence[np.ndarray],
            extra: Sequence[np.ndarray] = (), size: int = 6) -> Iterator[tuple[int, bytes]]:
    """(target, packed records) for every target partition that gets any."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(part)]):
        o = order[lo:hi]
        yield int(part[lo]), pack(key[o], owner[o], table, [e[o] for e in extra], size)


def gather(payloads: Sequence[bytes], table: Sequence[str], extra: Sequence[str] = (), size: int = 6
           ) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """All records of a partition: keys, owners as rows of the joined table,
    the table's columns, extra columns."""
    keys, owners, tables, extras = [], [], [], []
    base = 0
    for p in payloads:
        k, o, t, e = unpack(p, table, extra, size)
        keys.append(k)
        owners.append(o + base)
        tables.append(t)
        extras.append(e)
        base += len(t[0])
    if not keys:
        return (np.empty(0, "<u8"), np.empty(0, np.int64), [np.empty(0, t) for t in table],
                [np.empty(0, e) for e in extra])
    return (np.concatenate(keys), np.concatenate(owners),
            [np.concatenate(c) for c in zip(*tables)], [np.concatenate(c) for c in zip(*extras)])


def squeeze(b: bytes) -> bytes:
    """A payload of columns that repeat themselves, compressed, behind its size."""
    return len(b).to_bytes(8, "little") + pa.compress(b, codec="zstd", asbytes=True)


def unsqueeze(b: bytes) -> bytes:
    return pa.decompress(memoryview(b)[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)


def run_lengths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of every run of equal values in a sorted array."""
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    s = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return s, np.diff(np.r_[s, len(x)])

"""Vectorised words, word hashes and word shingles of Arrow text batches.

A word is a maximal run of characters other than U+0020 and U+0009-U+000D;
A-Z are folded to a-z. Every word gets a 64-bit hash of its bytes that does
not depend on the batch, so equal words hash alike in every task. All work is
numpy over a batch's bytes, in windows of about a megabyte cut between words,
so memory stays bounded for very long texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WINDOW = 1 << 20
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_BASE = np.uint64(0x9E3779B97F4A7C15)          # odd, so invertible modulo 2^64
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GOLD = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection with full avalanche)."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


def _byte_table() -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
    t[65:91] = t[97:123]
    return t


_TABLE = _byte_table()
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, WINDOW + 4096)
        out = []
        for b in (_BASE, _INV):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POW[:] = out
    return _POW[0], _POW[1]


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of length rows + 1); nulls are empty."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_string())
    buf = arr.buffers()
    off = np.frombuffer(buf[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    if buf[2] is None or not len(off):
        return np.empty(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    data = np.frombuffer(buf[2], dtype=np.uint8)[off[0]:off[-1]]
    return data, off - off[0]


def _windows(data: np.ndarray, off: np.ndarray):
    """Byte ranges of about WINDOW bytes that end between two words."""
    lo, n = 0, len(data)
    while lo < n:
        hi = lo + WINDOW
        if hi >= n:
            hi = n
        else:
            nxt = off[np.searchsorted(off, hi)]     # next document start
            while hi < nxt:
                gap = np.flatnonzero(_SPACE[data[hi:min(hi + 65536, nxt)]])
                if len(gap):
                    hi += int(gap[0])
                    break
                hi = min(hi + 65536, int(nxt))
        yield lo, hi
        lo = hi


def words(col) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, offsets: words of row i are
    ``[offsets[i], offsets[i + 1])``)."""
    data, off = text_bytes(col)
    hashes, firsts = [], []
    for lo, hi in _windows(data, off):
        b = data[lo:hi]
        ink = ~_SPACE[b]
        cut = np.zeros(len(b) + 1, dtype=bool)
        cut[0] = cut[-1] = True
        inside = off[np.searchsorted(off, lo):np.searchsorted(off, hi)] - lo
        cut[inside] = True
        left = ink.copy()
        left[1:] &= ~ink[:-1] | cut[1:-1]
        right = ink.copy()
        right[:-1] &= ~ink[1:] | cut[1:-1]
        s, e = np.flatnonzero(left), np.flatnonzero(right) + 1
        p, q = _powers(len(b) + 1)
        c = np.empty(len(b) + 1, dtype=np.uint64)
        c[0] = 0
        np.cumsum(_TABLE[b] * p[:len(b)], out=c[1:])
        h = (c[e] - c[s]) * q[s]
        hashes.append(mix(h ^ ((e - s).astype(np.uint64) * _GOLD)))
        firsts.append(s + lo)
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(off), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(firsts), off)


def runs(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words that start at each position (positions within
    ``k - 1`` of the end are not meaningful and are left out)."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out *= _BASE
        out += w[j:j + n]
    return mix(out ^ np.uint64(k * 0x632BE5AB))


def shingles(col, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of every row, ascending within the row;
    offsets). A row with 1 to k-1 words has one shingle, its whole sequence;
    a row without words has none."""
    w, off = words(col)
    n = np.diff(off)
    row = np.repeat(np.arange(len(n), dtype=np.int64), n)
    h = runs(w, k)
    place = np.arange(len(h), dtype=np.int64)
    full = place + k <= off[1:][row[:len(h)]]
    rows, hs = [row[:len(h)][full]], [h[full]]
    for m in range(1, k):
        short = np.flatnonzero(n == m)
        if len(short):
            rows.append(short)
            x = np.zeros(len(short), dtype=np.uint64)
            for j in range(m):
                x = x * _BASE + w[off[short] + j]
            hs.append(mix(x ^ np.uint64(m * 0x632BE5AB)))
    r, h = np.concatenate(rows), np.concatenate(hs)
    order = np.argsort(h, kind="stable")
    r, h = r[order], h[order]
    order = np.argsort(r, kind="stable")
    r, h = r[order], h[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    r, h = r[keep], h[keep]
    return h, np.searchsorted(r, np.arange(len(n) + 1))

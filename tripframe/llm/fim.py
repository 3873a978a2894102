"""Fill-in-middle rearrangement of texts by arithmetic on 64-bit words.

A text is cut into units (a run of letters A-Z, a-z, or any other single code
point) and at two random places between them into prefix, middle and suffix, which
are put together again for training: ``<P>``prefix``<S>``suffix``<M>``middle (psm) or
``<S>``suffix``<P>``prefix``<M>``middle (spm).

The UTF-8 bytes of a batch are viewed as 64-bit words, eight bytes at a time:

1. arithmetic on whole words marks the bytes that end a unit: the next byte starts
   a code point, and not both bytes are letters. No byte is looked at alone and no
   text is decoded;
2. marks are counted per word (``bitwise_count``) and added up;
3. the word that holds the wanted unit's end is found in the sums by binary search;
4. in that word the lowest marks are taken off until the wanted one is left.

The draws are four numbers of the SHA-256 of ``1:`` and the decimal id, so a rerun
or a lost executor gives the same result.

``transform`` returns one row per input row: ``doc_id, n`` (units), ``form`` (plain,
psm, spm), ``prefix_chars, middle_chars`` (code points; null if plain), ``output``.
Null texts are empty. Empty texts, texts that hold one of the three signs, and the share
``plain_from`` leaves are plain: returned as they are. A null id counts as an empty
number. Repeated rows give the same result each. Very long texts are worked on in
slices of about a megabyte. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripframe.llm import common as C
from tripframe.llm.wordhash import text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Draws of 0-99: plain from 90 on, spm below 20.
PLAIN_FROM, SPM_BELOW = 90, 20
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_EACH = 0x0101010101010101
_HIGH, _LOW7, _FOLD = (np.uint64(v * _EACH) for v in (0x80, 0x7F, 0x20))
_TO_A, _PAST_Z = np.uint64((0x80 - ord("a")) * _EACH), np.uint64((0x80 - ord("z") - 1) * _EACH)
_1, _3, _7, _8, _56 = (np.uint64(v) for v in (1, 3, 7, 8, 56))
_WINDOW = 1 << 17                                     # words, about a megabyte


def _letters(w: np.ndarray) -> np.ndarray:
    """High bit of every byte that is a letter."""
    low = (w | _FOLD) & _LOW7
    return (low + _TO_A) & ~(low + _PAST_Z) & ~w & _HIGH


def _inner(w: np.ndarray) -> np.ndarray:
    """High bit of every byte that continues a code point (10xxxxxx)."""
    return w & ~(w << _1) & _HIGH


class Marks:
    """Marked bytes of a buffer, with their sums."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.sums = np.zeros(len(marks) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.sums[1:])

    def before(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before each byte position."""
        word = at >> 3
        below = (_1 << ((at & 7).astype(np.uint64) << _3)) - _1
        return self.sums[word] + np.bitwise_count(self.marks[word] & below)

    def find(self, k: np.ndarray) -> np.ndarray:
        """Byte position of the ``k``-th marked byte (from 1)."""
        word = np.searchsorted(self.sums, k, side="left") - 1
        left = k - self.sums[word]
        m = self.marks[word]
        for j in range(1, 8):
            m = np.where(left > j, m & (m - _1), m)
        return 8 * word + (np.bitwise_count((m & (~m + _1)) - _1) >> 3)


def mark(data: np.ndarray, off: np.ndarray) -> tuple[Marks, Marks]:
    """Ends of units and starts of code points in the texts
    ``data[off[i]:off[i + 1]]``."""
    words = np.zeros(len(data) // 8 + 2, dtype="<u8")  # at least one empty word behind the text
    words.view(np.uint8)[:len(data)] = data
    ends, starts = np.zeros_like(words), np.zeros_like(words)
    for lo in range(0, len(words) - 1, _WINDOW):
        hi = min(lo + _WINDOW, len(words) - 1)
        w = words[lo:hi + 1]                           # one word more: its first byte follows
        letter, inner = _letters(w), _inner(w)

        def follows(m: np.ndarray) -> np.ndarray:
            return (m[:-1] >> _8) | (m[1:] << _56)

        ends[lo:hi] = _HIGH & ~follows(inner) & ~(letter[:-1] & follows(letter))
        starts[lo:hi] = _HIGH & ~inner[:-1]
    last = off[1:][np.diff(off) > 0] - 1               # a text's last byte ends a unit
    np.bitwise_or.at(ends, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) << _3))
    return Marks(ends), Marks(starts)


def cut(data: np.ndarray, off: np.ndarray, x: np.ndarray, y: np.ndarray
        ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: units ``n``; byte positions where prefix and middle end, after the
    smaller and larger of ``x % (n + 1)`` and ``y % (n + 1)`` units; the code
    points of both."""
    ends, starts = mark(data, off)
    lo, hi = off[:-1], off[1:]
    first = ends.before(lo)
    n = ends.before(hi) - first
    x, y = x % (n + 1), y % (n + 1)

    def place(u: np.ndarray) -> np.ndarray:
        return np.where(u > 0, ends.find(np.maximum(first + u, 1)) + 1, lo) if len(u) else lo

    a, b = place(np.minimum(x, y)), place(np.maximum(x, y))
    chars = starts.before(a)
    return n, a, b, chars - starts.before(lo), starts.before(b) - chars


def draws(key: str) -> list[Column]:
    """The four numbers of an id."""
    text = F.coalesce(C.column(key).cast("long").cast("string"), F.lit(""))
    h = F.sha2(F.concat(F.lit("1:"), text), 256)
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", plain_from: int = PLAIN_FROM,
              spm_below: int = SPM_BELOW) -> DataFrame:
    """One row per input row, see the module's docstring."""
    C.bound_batches(docs.sparkSession)
    t = F.coalesce(C.column(text).cast("string"), F.lit(""))
    signs = t.contains(PREFIX) | t.contains(SUFFIX) | t.contains(MIDDLE)
    rows = docs.select(C.column(key).cast("long").alias("doc_id"), t.alias("text"), *draws(key),
                       signs.alias("signs"))
    p, s, m = (v.encode() for v in (PREFIX, SUFFIX, MIDDLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_bytes(b.column(1))
            h1, h2, h3, h4 = (b.column(i).to_numpy() for i in range(2, 6))
            n, at, to, pre, mid = cut(data, off, h1, h2)
            plain = (n == 0) | b.column(6).to_numpy(zero_copy_only=False) | (h3 % 100 >= plain_from)
            spm = h4 % 100 < spm_below
            view, parts = memoryview(np.ascontiguousarray(data)), []
            ends = np.diff(off) + np.where(plain, 0, len(p) + len(s) + len(m))
            for i, (lo, u, v, hi) in enumerate(zip(off[:-1].tolist(), at.tolist(), to.tolist(), off[1:].tolist())):
                if plain[i]:
                    parts.append(view[lo:hi])
                elif spm[i]:
                    parts += (s, view[v:hi], p, view[lo:u], m, view[u:v])
                else:
                    parts += (p, view[lo:u], s, view[v:hi], m, view[u:v])
            where = np.zeros(len(ends) + 1, dtype="<i8")
            np.cumsum(ends, out=where[1:])
            out = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(where.tobytes()),
                                                   pa.py_buffer(b"".join(parts)))
            form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n.astype(np.int64)), pa.array(form.tolist(), pa.string()),
                 pa.array(pre.astype(np.int64), mask=plain), pa.array(mid.astype(np.int64), mask=plain),
                 out.cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, OUT)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of. No part holds one of the signs and none
    can arise where parts meet, so each sign's only place splits them."""
    body, index = f"substring(`{output}`, {len(PREFIX) + 1})", "substring_index"
    head = f"{index}({body}, '{MIDDLE}', 1)"
    middle = f"{index}({body}, '{MIDDLE}', -1)"

    def around(sign: str) -> tuple[str, str]:
        return f"{index}({head}, '{sign}', 1)", f"{index}({head}, '{sign}', -1)"

    (pre, suf), (suf2, pre2) = around(SUFFIX), around(PREFIX)
    return F.expr(f"case `{form}` when 'psm' then concat({pre}, {middle}, {suf}) "
                  f"when 'spm' then concat({pre2}, {middle}, {suf2}) else `{output}` end")


def digest(got: DataFrame) -> DataFrame:
    """Outputs and rebuilt texts as SHA-256."""
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(), 256).alias("restored_sha256"))

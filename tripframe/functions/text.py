"""String helpers as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zfill(c: Column, width: int) -> Column:
    """Left-pad with zeros to ``width``; longer values are kept whole.

    ``lpad`` alone truncates longer input, so the pad length is the larger of
    the value's length and the width.
    """
    return F.lpad(c, F.greatest(F.length(c), F.lit(width)), F.lit("0"))


def composite_key(*cols: str, sep: str = "_") -> Column:
    """``route_stop`` style key; a null part makes the key null (``concat``)."""
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(F.col(c).cast("string"))
    return F.concat(*parts)


# Constants of the public 32-bit MurmurHash3 (x86 variant).
_C1, _C2, _STEP, _F1, _F2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35
_MASK = 0xFFFFFFFF


def _let(a: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(a), use)[0]


def _times(a: Column, c: int) -> Column:
    """``a * c`` modulo 2^32 of a 32-bit value, without leaving 64 bits."""
    return _let(a, lambda v: (v.bitwiseAND(F.lit(0xFFFF)) * F.lit(c) + (F.shiftright(v, 16) * F.lit(c))
                              .bitwiseAND(F.lit(0xFFFF)) * F.lit(65536)).bitwiseAND(F.lit(_MASK)))


def _turn(a: Column, n: int) -> Column:
    return _let(a, lambda v: F.shiftleft(v, n).bitwiseOR(F.shiftright(v, 32 - n)).bitwiseAND(F.lit(_MASK)))


def _folded(a: Column, n: int) -> Column:
    return _let(a, lambda v: v.bitwiseXOR(F.shiftright(v, n)))


def _scrambled(k: Column) -> Column:
    return _times(_turn(_times(k, _C1), 15), _C2)


def murmur3(c: Column, seed: int = 0) -> Column:
    """32-bit MurmurHash3 of a string's UTF-8 bytes, as a signed value in a long.
    (Spark's ``hash`` ends words of other lengths than 4 bytes its own way.)"""
    def word(text: Column, at: Column, size: Column | int) -> Column:
        """The bytes from ``at`` as a little-endian number (missing ones are 0)."""
        value = F.lit(0).cast("long")
        for i in range(4):
            byte = F.conv(F.substr(text, (2 * (at + i) + 1).cast("int"), F.lit(2)), 16, 10).cast("long")
            value = value + F.when(F.lit(i) < size, byte).otherwise(F.lit(0)) * F.lit(1 << (8 * i)).cast("long")
        return value

    def mixed(text: Column) -> Column:
        n = F.floor(F.length(text) / 2)
        blocks = F.floor(F.length(text) / 8)
        places = F.when(blocks > 0, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array().cast("array<long>"))
        h = F.aggregate(places, F.lit(seed).cast("long"), lambda acc, i: (
            _turn(acc.bitwiseXOR(_scrambled(word(text, 4 * i, 4))), 13) * 5 + F.lit(_STEP)).bitwiseAND(F.lit(_MASK)))
        return h.bitwiseXOR(_scrambled(word(text, 4 * blocks, n - 4 * blocks))).bitwiseXOR(n)

    h = _let(F.hex(F.encode(c, "UTF-8")), mixed)
    for shift, mult in ((16, _F1), (13, _F2)):
        h = _times(_folded(h, shift), mult)
    h = _folded(h, 16)
    return _let(h, lambda v: F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v))


def hashed_tokens(c: Column, n_features: int) -> Column:
    """lower-cased words of two and more letters, digits or underscores, counted at
    the absolute value of their hash modulo ``n_features`` (no alternating sign), scaled
    to length 1. Texts without such words, and null, give zeros."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    places = F.transform(words, lambda w: F.abs(murmur3(w)) % n_features)
    counts = _let(places, lambda at: F.transform(
        F.sequence(F.lit(0), F.lit(n_features - 1)), lambda i: F.size(F.filter(at, lambda p: p == i)).cast("double")))

    def scaled(v: Column) -> Column:
        return _let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)),
                    lambda norm: F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0))))

    return _let(counts, scaled)

"""Hash expressions: md5 buckets (F12) and seeded shuffle orders.

``int(md5(text).hexdigest(), 16) % n`` is computed without a UDF by folding
the 32 hex digits in four 8-digit chunks: r = (r * (2^32 mod n) + chunk) % n.
Every intermediate stays below 2^63 for n < 2^31.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def id_text(c) -> Column:
    """Text form used before hashing; a missing id hashes as ``nan``."""
    return F.coalesce(_col(c).cast("string"), F.lit("nan"))


def md5_mod(c, n: int) -> Column:
    """Bucket = int(md5 hex, 16) mod n, as a bigint."""
    if not 0 < n < 2 ** 31:
        raise ValueError("bucket count must be in (0, 2^31)")
    h = F.md5(id_text(c))
    step = (2 ** 32) % n
    r = F.lit(0).cast("bigint")
    for i in range(4):
        chunk = F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint")
        r = (r * F.lit(step) + chunk) % F.lit(n)
    return r


def seeded_hash(c, seed: int = 42) -> Column:
    """Deterministic pseudo-random order key: md5 of ``seed|id`` (hex text).

    Unlike ``rand()`` it does not depend on partitioning, so a recomputed
    task (executor loss) reproduces the same order, and SQL engines with
    md5 compute the same value.
    """
    return F.md5(F.concat(F.lit(f"{seed}|"), _col(c).cast("string")))


def hash_prefix_bucket(h: Column, hex_digits: int = 4) -> Column:
    """Leading hex digits of an md5 order key as an int bucket (order-preserving)."""
    return F.conv(F.substring(h, 1, hex_digits), 16, 10).cast("int")

"""The token hash against a plain version and published values."""

import numpy as np
from pyspark.sql import functions as F

from tripframe.functions.text import hashed_tokens, murmur3


def plain(data, h=0):
    m = 0xFFFFFFFF
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i:i + 4], "little") * 0xCC9E2D51 & m
        k = (k << 15 | k >> 17) & m
        h ^= k * 0x1B873593 & m
        if i + 4 <= len(data):
            h = ((h << 13 | h >> 19) & m) * 5 + 0xE6546B64 & m
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >= 1 << 31 else h


def test_murmur3_published_values_and_all_lengths(spark):
    known = {"": 0, "hello": 0x248BFA47, "hello, world": 0x149BBB7F, "The quick brown fox jumps over the lazy dog": 0x2E4FF723}
    texts = [*known, *["abcdefghijk"[:n] for n in range(12)], "é", "버스", "🚌x", "word" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("h", murmur3(F.col("t")))
    for r in df.collect():
        assert r.h == plain(r.t.encode()), r.t
        assert r.t not in known or r.h == known[r.t]


def test_hashed_tokens(spark):
    texts = ["I love machine learning", "Python is a great language", "a b c", "", None, "data Data DATA set", "x_1 ab-cd"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("f", hashed_tokens(F.col("t"), 4))
    import re
    for r in df.collect():
        want = np.zeros(4)
        for w in re.findall(r"\b\w\w+\b", (r.t or "").lower()):
            want[abs(plain(w.encode())) % 4] += 1
        if want.any():
            want /= np.linalg.norm(want)
        np.testing.assert_allclose(r.f, want, atol=1e-15)

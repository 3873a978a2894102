"""Fixtures and brute-force helpers of these tests."""

import itertools

import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                    T.StructField("n_chars", T.LongType()), T.StructField("own", T.StringType()),
                    T.StructField("part", T.StringType()), T.StructField("size", T.StringType())])
VEC = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                    T.StructField("label", T.IntegerType()), T.StructField("d", T.StringType()),
                    T.StructField("id", T.StringType())])


@pytest.fixture(scope="session")
def frame(spark):
    """Documents (id, text[, source]) with extra columns whose names the
    operators use themselves."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, DOC)
    return make


@pytest.fixture(scope="session")
def vectors(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, lab, "x", "y") for i, v, lab in rows], VEC)
    return make


def groups(links, ids):
    """Smallest reachable id of every id, by plain union-find."""
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def pairs(ids):
    return itertools.combinations(ids, 2)

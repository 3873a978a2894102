"""Connected components of a distributed edge list.

Alternating large-star and small-star steps (Kiveris et al. 2014): edges are
re-hung on smaller neighbours until every component is a star around its
smallest node. A step is a grouped minimum (partially aggregated before the
shuffle) and a join back, which Spark may split where a hub is hot. Every round
is written to the shared checkpoint folder, so lost executors cost one round.
The driver sees only a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripframe.llm import common as C


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return (both.join(low, both["a"] == low["u"]).filter("b > u")
            .select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small(e: DataFrame) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    moved = (e.join(low, e["a"] == low["u"]).filter("b > m")
             .select(F.col("b").alias("a"), F.col("m").alias("b")))
    return moved.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``root``) of every node of an edge list of longs; ``root`` is
    the component's smallest node. Loops, repeats and nulls are ignored."""
    x, y = C.column(a).cast("long"), C.column(b).cast("long")
    e = edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"), x.alias("x"), y.alias("y"))
    e = e.filter("x is not null and y is not null and a > b").select("a", "b").distinct()
    e = C.stage(e, "edges")
    seen = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == tuple(state) or not state[0]:
            break
        seen = tuple(state)
        e = C.stage(_small(_large(e).distinct()).distinct(), "edges")
    return (e.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))

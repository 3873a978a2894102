"""Mixing sources to target weights by min-cost flow.

Documents belong to one or more sources (an array of names; null is a source
of its own). ``mix`` proceeds in steps that keep only small tables on the
driver:

1. Documents are aggregated by membership pattern to words per pattern.
2. A flow network routes words from patterns to the quotas of their sources.
   The first pass over a pattern's words costs 0 a word, the second 1, and so
   on up to ``passes`` (convex, so words repeat only where quotas ask for it).
3. Each pattern's documents stand in a seeded order. The pattern's line is its
   documents once per pass; the flow takes the line's beginning and cuts it
   into consecutive stretches for the pattern's sources. A document's pass is
   taken when it lies before the end of the flow; one more document, the one
   whose size comes nearest to the words still open, closes the gap.

Positions in a line come from sums per (pattern, hash range of the order) and
a window inside one range, so a source with a third of all documents is spread
over ``RANGES`` groups. The driver holds one row per pattern; more than
``max_patterns`` of them are an error.

Sizes are words ``[^\\x20\\x09-\\x0D]+`` (null text: 0). Documents of size 0 are
never taken. Rows that repeat an id are separate documents whose ties are
broken by size, so results do not depend on partitioning; an empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripframe.llm import common as C

RANGES = 4096
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
PASSES = 2
SEED = 42


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = WEIGHTS,
            share: float = SHARE, most: float = PASSES, total: int | None = None
            ) -> dict[str | None, float]:
    """Target words of each source. Sources by code point, null last, weigh
    ``weights`` repeating and share ``share`` of all words; none gets more
    than ``most`` times its size, the excess is shared again by weight."""
    order = sorted((s for s, _ in sizes if s is not None)) + [None] * any(s is None for s, _ in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    cap = {s: float(most * n) for s, n in sizes}
    left = share * (sum(n for _, n in sizes) if total is None else total)
    out: dict[str | None, float] = {}
    free = list(order)
    while free:
        unit = left / sum(w[s] for s in free)
        over = [s for s in free if unit * w[s] > cap[s]]
        if not over:
            out |= {s: unit * w[s] for s in free}
            break
        for s in over:
            out[s] = cap[s]
            left -= cap[s]
        free = [s for s in free if s not in out]
    return out


def route(patterns: Sequence[tuple[tuple, int]], quota: dict, passes: int = PASSES
          ) -> list[dict]:
    """Min-cost flow from patterns (members, words) to quotas: for each
    pattern, words per source.

    A word costs the number of passes before its own, so a path's cost is that of the pass
    it starts with, and a shortest path never runs back into the start. All paths of
    one cost are therefore one maximal flow: one run of blocking flows per pass."""
    src, dst = 0, 1
    names = sorted(quota, key=lambda s: (s is None, s or ""))
    at = {s: 2 + len(patterns) + i for i, s in enumerate(names)}
    size = 2 + len(patterns) + len(names)
    to: list[int] = []
    cap: list[int] = []
    out: list[list[int]] = [[] for _ in range(size)]

    def edge(a: int, b: int, c: int) -> int:
        for x, y, k in ((a, b, c), (b, a, 0)):
            out[x].append(len(to))
            to.append(y)
            cap.append(k)
        return len(to) - 2

    start, carry = [], []
    for i, (members, words) in enumerate(patterns):
        start.append(edge(src, 2 + i, 0))
        carry.append({s: edge(2 + i, at[s], passes * words) for s in dict.fromkeys(members)})
    for s in names:
        edge(at[s], dst, round(quota[s]))
    for _ in range(passes):
        for e, (_, words) in zip(start, patterns):
            cap[e] += words
        while _blocking_flow(out, to, cap, src, dst):
            pass
    return [{s: cap[e ^ 1] for s, e in c.items() if cap[e ^ 1] > 0} for c in carry]


def _blocking_flow(out: list[list[int]], to: list[int], cap: list[int], src: int, dst: int) -> bool:
    """Fills every shortest path (by edges) with room; False if there is none."""
    level = [-1] * len(out)
    level[src] = 0
    line = [src]
    for a in line:
        for e in out[a]:
            if cap[e] > 0 and level[to[e]] < 0:
                level[to[e]] = level[a] + 1
                line.append(to[e])
    if level[dst] < 0:
        return False
    tried = [0] * len(out)
    path: list[int] = []
    a = src
    while True:
        if a == dst:
            move = min(cap[e] for e in path)
            for e in path:
                cap[e] -= move
                cap[e ^ 1] += move
            full = next(i for i, e in enumerate(path) if not cap[e])
            a = to[path[full] ^ 1]
            del path[full:]
        while tried[a] < len(out[a]):
            e = out[a][tried[a]]
            if cap[e] > 0 and level[to[e]] == level[a] + 1:
                break
            tried[a] += 1
        if tried[a] < len(out[a]):
            path.append(out[a][tried[a]])
            a = to[path[-1]]
        elif a == src:
            return True
        else:
            a = to[path.pop() ^ 1]
            tried[a] += 1


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
        passes: int = PASSES, seed: int = SEED, max_patterns: int = 100_000,
        key: str = "doc_id", members: str = "members", size: str = "size",
        row: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, members, size, passes_taken`` (how many
    times the mix takes it), ``taken`` (words, repeats counted), ``charged`` (the
    source charged for each pass). ``members`` is an array of source names
    (null or empty: the null source alone). ``row`` names a column (of any type
    that sorts) that is unique per row: it comes back as ``row`` and tells rows of one id, or of none, apart
    (rows without an id are then ordered by it)."""
    spark = docs.sparkSession
    member = F.array_sort(F.array_distinct(C.column(members)))
    none = F.array(F.lit(None).cast("string"))
    rows = C.stage(docs.select(
        C.column(key).cast("long").alias("doc_id"),
        F.when(F.coalesce(F.size(member), F.lit(0)) > 0, member).otherwise(none).alias("members"),
        C.column(size).cast("long").alias("size"),
        *([C.column(row).alias("row")] if row else [])), "mix-sizes")
    own = ["row"] if row else []
    got = (rows.groupBy("members").agg(F.sum("size").alias("words"))
           .limit(max_patterns + 1).collect())
    if len(got) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = sorted(((tuple(r[0]), int(r[1] or 0)) for r in got), key=repr)
    each: dict[str | None, int] = {}
    for m, n in patterns:
        for s in m:
            each[s] = each.get(s, 0) + n
    quota = targets(list(each.items()), weights, share, passes, sum(n for _, n in patterns))
    flow = route(patterns, quota, passes)
    plan, spans = [], []
    for (m, n), f in zip(patterns, flow):
        at = 0
        cuts = []
        for s in sorted(f, key=lambda s: (s is None, s or "")):
            at += f[s]
            cuts.append((at, s))
        plan.append((list(m), n, at, cuts))
    sizes = spark.createDataFrame(
        plan, "members array<string>, words long, flow long, cuts array<struct<upto long, source string>>")
    order = F.xxhash64("doc_id", F.lit(seed))
    if row:
        order = F.when(F.col("doc_id").isNull(), F.xxhash64("row", F.lit(seed))).otherwise(order)
    rows = rows.withColumns({"_h": order, "_r": F.shiftrightunsigned(order, 64 - RANGES.bit_length() + 1)})
    ranges = rows.groupBy("members", "_r").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("members").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("members", "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # At most max_patterns rows of plan and RANGES rows a pattern; Spark checks
    # their size before it broadcasts either.
    inside = (Window.partitionBy("members", "_r").orderBy("_h", "doc_id", "size", *own)
              .rowsBetween(Window.unboundedPreceding, -1))
    x = (rows.join(ranges.join(sizes, "members"), ["members", "_r"])
         .withColumn("_at", F.col("_off") + F.coalesce(F.sum("size").over(inside), F.lit(0))))
    start = F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), lambda p: p * F.col("words") + F.col("_at"))
    x = C.stage(x.select("doc_id", *own, "members", "size", "_h", "_at", "flow", "cuts", start.alias("_starts")),
                "mix-lines").filter("true")
    size_, flow_ = F.col("size"), F.col("flow")
    inside = F.filter("_starts", lambda a: (size_ > 0) & (a + size_ <= flow_))
    # What the line's beginning leaves open, and the one more document whose
    # size comes nearest to it (one row per pattern each).
    open_ = (x.select("members", "flow", F.explode("_starts").alias("a"), "size")
             .filter("a < flow and a + size > flow")
             .groupBy("members").agg(F.max(F.col("flow") - F.col("a")).alias("rest")))
    spare = x.filter((size_ > 0) & (F.size(inside) < passes)).join(open_, "members")
    spare = spare.withColumn("_gap", F.abs(size_ - F.col("rest"))).filter("_gap < rest")
    last = spare.groupBy("members").agg(F.min(F.struct("_gap", "_h", "_at")).alias("_best")).select(
        "members", F.col("_best._at").alias("_last"))
    x = x.join(last, "members", "left")
    extra = F.coalesce((F.col("_at") == F.col("_last")) & (size_ > 0), F.lit(False))
    took = F.when(extra, F.concat(inside, F.array(flow_ - 1))).otherwise(inside)
    charged = F.transform(took, lambda a: F.filter("cuts", lambda c: a < c["upto"])[0]["source"])
    return x.select("doc_id", *own, "members", "size", F.size(took).alias("passes_taken"),
                    (F.size(took) * size_).cast("long").alias("taken"), charged.alias("charged"))


def of_source(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
              row: str | None = None) -> DataFrame:
    """Input of ``mix`` for documents that name one source each (``row`` comes as ``row``)."""
    return docs.select(C.column(key).cast("long").alias("doc_id"),
                       *([C.column(row).alias("row")] if row else []),
                       F.array(C.column(source).cast("string")).alias("members"),
                       word_count(C.column(text)).alias("size"))


def report(mixed: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
           passes: int = PASSES) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of a mix whose documents
    name one source each."""
    x = mixed.withColumn("source", F.col("members")[0])
    totals = x.groupBy("source").agg(F.sum("size").alias("source_size"))
    want = targets([(r[0], int(r[1])) for r in totals.collect()], weights, share, passes)
    spark = mixed.sparkSession
    goal = totals.join(spark.createDataFrame([(s, t) for s, t in want.items()] or [(None, 0.0)],
                                             "name string, target double"),
                       F.col("source").eqNullSafe(F.col("name")))
    goal = goal.select(F.col("source").alias("_s"), "source_size", "target")
    return (x.join(goal, F.col("source").eqNullSafe(F.col("_s")))
            .select("doc_id", "size", "source_size", "target", "taken"))

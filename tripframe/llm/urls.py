"""URL filter: a blocked Bloom filter in front of an exact hash join.

``judge(pages, listed)`` compares canonical URLs of pages with a list. The
list's URLs set bits in a split-block Bloom filter: a URL's hash names one
block of ``WORDS`` words of 32 bits and one bit in each word. The filter is a
table (block, words) built by one ``bit_or`` aggregate; its number of blocks
follows the list's size, so about ``bits_per_url`` bits stand for a URL at
any size. Pages join their block (Spark broadcasts the blocks only while they
measure below its broadcast threshold and shuffles by block otherwise); a
page whose bits are not all set is certainly not listed and leaves. The
others meet the list in an exact join on the canonical URL, which removes
the false positives. Everything is DataFrame expressions.

Canonical form: scheme and fragment are dropped, the host is lower-cased
without a port, a trailing dot or a leading ``www.``, tracking parameters
(``utm_*``, ``ref``, ``fbclid``, ``gclid``) are dropped and the others sorted, and a trailing
``/`` and ``index.html`` of the path are dropped. Null, empty and URLs
without ``://`` have no canonical form: they are never listed.

``host_path`` and ``ruled`` give host, path and the longest fitting rule of a
small fixed rule list. Repeated pages and repeated list entries are allowed;
every page row comes back once. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripframe.llm import common as C

WORDS = 8
BITS_PER_URL = 16
SPREAD = 4096
#: (host, path, allow): fixed values of the stated rules.
RULES = (
    ("org", "/", True),
    ("example.org", "/es/", False),
    ("example.org", "/en/1", False),
    ("com", "/fr/", True),
    ("com", "/de/", False),
)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased, up to ``/``, ``?``, ``#`` or the end after the
    first ``://``) and path (then up to ``?``, ``#`` or the end)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, bool]] = RULES
            ) -> tuple[Column, Column]:
    """(text of the longest rule that fits, whether it allows); nulls when
    none fits. The longest is the one with most characters of host and path."""
    text, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for h, p, ok in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)).otherwise(text)
        allow = F.when(fits, F.lit(ok)).otherwise(allow)
    return text, allow


def canonical(url: Column) -> Column:
    """Canonical form of a URL, null if it has none."""
    host, path = host_path(url)
    host = F.regexp_replace(F.regexp_replace(host, r":\d*$", ""), r"\.$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(path, r"index\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(url, r"^[^#?]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(
        r"^(utm_[a-z]*|ref|fbclid|gclid)(=|$)")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, tail))


def _place(url: Column, blocks: Column) -> tuple[Column, list[Column]]:
    """Block number and one 32-bit mask per word (as longs)."""
    h = F.xxhash64(url)
    low = h.bitwiseAND(F.lit(0xFFFFFFFF))
    block = F.pmod(F.shiftrightunsigned(h, 32), blocks)
    bit = [F.pmod(F.shiftrightunsigned(F.xxhash64(low, F.lit(i)), 27), F.lit(32)) for i in range(WORDS)]
    return block, [F.pow(F.lit(2.0), b).cast("long") for b in bit]


def bloom(listed: DataFrame, bits_per_url: int = BITS_PER_URL) -> DataFrame:
    """Blocked Bloom filter of ``canon`` as a table: ``block``, ``w0``.. and
    ``blocks`` (how many blocks there are)."""
    n = listed.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * bits_per_url / (32 * WORDS)))
                   .cast("long").alias("n")).scalar()
    block, masks = _place(F.col("canon"), n)
    return (listed.select(block.alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)])
            .groupBy("block").agg(*[F.expr(f"bit_or(w{i})").alias(f"w{i}") for i in range(WORDS)]))


def possible(pages: DataFrame, listed: DataFrame, bits_per_url: int = BITS_PER_URL) -> DataFrame:
    """Distinct ``canon`` of pages that pass the Bloom filter of ``listed``: a
    superset of the canonical URLs in both."""
    n = listed.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * bits_per_url / (32 * WORDS)))
                   .cast("long").alias("n")).scalar()
    block, masks = _place(F.col("canon"), n)
    probe = pages.filter(F.col("canon").isNotNull()).select("canon", block.alias("block"))
    hit = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(masks)])
    # Only what passes is made distinct: the filter thins out the pages first.
    return probe.join(bloom(listed, bits_per_url), "block").filter(hit).select("canon").distinct()


def judge(pages: DataFrame, listed: DataFrame, key: str = "page_id", url: str = "url",
          listed_url: str = "url", bits_per_url: int = BITS_PER_URL) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``canon``, ``listed`` (whether
    the canonical URL is in the list, exactly)."""
    rows = pages.select(C.column(key).alias("page_id"), C.column(url).cast("string").alias("url"))
    rows = rows.withColumn("canon", canonical(F.col("url")))
    names = (listed.select(canonical(C.column(listed_url).cast("string")).alias("canon"))
             .filter(F.col("canon").isNotNull()).distinct())
    exact = (possible(rows, names, bits_per_url).join(names, "canon", "left_semi")
             .select(F.col("canon").alias("_canon"), F.lit(0).alias("_spread"), F.lit(True).alias("_hit")))
    # Pages without a canonical URL meet nothing; spread, so that they don't share one key.
    spread = F.when(F.col("canon").isNull(), 1 + F.pmod(F.xxhash64("page_id", "url"), F.lit(SPREAD))).otherwise(0).cast("int")
    near = (F.coalesce(F.col("canon"), F.lit("")) == F.col("_canon")) & (spread == F.col("_spread"))
    return (rows.join(exact, near, "left")
            .select("page_id", "url", "canon", F.coalesce("_hit", F.lit(False)).alias("listed")))


def verdicts(judged: DataFrame, rules: Sequence[tuple[str, str, bool]] = RULES) -> DataFrame:
    """Rules first, else the list: ``page_id, host, path, rule, verdict``."""
    host, path = host_path(F.col("url"))
    x = judged.withColumns({"host": host, "path": path})
    rule, allow = rule_of(F.col("host"), F.col("path"), rules)
    ok = F.coalesce(allow, ~F.col("listed"))
    return x.select("page_id", "host", "path", rule.alias("rule"),
                    F.when(ok, "allow").otherwise("block").alias("verdict"), "canon", "listed")


#: Words whose hosts make up the stand-in list that the query derives.
LISTED_HOSTS = r"(^|[.-])(casino|pills|win|cheap)([.-]|$)"


def stand_in_list(pages: DataFrame, url: str = "url") -> DataFrame:
    """A list in the schema the filter expects (``url``): the pages' own URLs
    on hosts whose name carries a listed word."""
    host, _ = host_path(F.col(url))
    return pages.filter(host.rlike(LISTED_HOSTS)).select(F.col(url).alias("url"))

"""Registered queries of this subpackage and their SQL.

``QUERIES``: name -> function of (spark, folder of tables). Every query reads
whole tables through its operator with production parameters. ``ORACLE``: name
-> DuckDB SQL where SQL can express the query.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripframe.llm import (bpe, caps, crosspoly, fim, knn, mixing, partenum, passages, prefix_trie, secret_scan, tokens,
                           toxicity, urls)
from tripframe.llm import common as C

OVER = 512


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best embeddings of every query row."""
    return knn.search(C.table(spark, sf_dir, "embeddings"), F.pmod(F.col("id"), F.lit(50)) == 0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the byte-level vocabulary file."""
    got = tokens.count(C.table(spark, sf_dir, "documents"),
                       public_tokenizers.path("byte_bpe_50k.json"))
    return got.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > OVER).alias("over_limit"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to target weights of their sources."""
    mixed = mixing.mix(mixing.of_source(C.table(spark, sf_dir, "documents")))
    return mixing.report(mixed)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings with equal labels."""
    return caps.link(C.table(spark, sf_dir, "embeddings"))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of documents that repeat earlier documents."""
    return passages.find(C.table(spark, sf_dir, "documents"))


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the rank file and decoded again."""
    return bpe.digest(bpe.encode(
        C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN, decoded=True))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by a lexicon learned from the labels whose
    crc fold is not 0."""
    docs = C.table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, C.table(spark, sf_dir, "labels"))
    got = toxicity.score(docs, model)
    return got.select("doc_id", F.coalesce(toxicity.crc_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
                      "score", "predicted")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.digest(secret_scan.scan(C.table(spark, sf_dir, "documents")))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with similar word shingle sets."""
    return partenum.join(C.table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the rules and the list of canonical URLs."""
    pages = C.table(spark, sf_dir, "pages")
    return urls.verdicts(urls.judge(pages, urls.stand_in_list(pages))).select(
        "page_id", "host", "path", "rule", "verdict")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest embeddings of every query row."""
    return crosspoly.search(C.table(spark, sf_dir, "embeddings"), F.pmod(F.col("id"), F.lit(100)) == 0)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for filling in the middle, and rebuilt from that."""
    return fim.digest(fim.transform(C.table(spark, sf_dir, "documents")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    steps = prefix_trie.turns(C.table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.rebuilt(steps))


QUERIES = {f.__name__: f for f in (
    op1_topk_search, op2_token_counts, op3_mix_sources, op4_embedding_dedup, op5_passages, op6_bpe_roundtrip,
    op7_toxicity, op8_secrets,
    op9_ngram_join, op10_url_filter, op11_nearest_neighbours, op12_fill_in_middle, op13_prefix_trie)}

_URL_SQL = r"""
WITH rest AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
  FROM pages),
parts AS (
  SELECT page_id, url,
         translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
canon AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(host, ':\d*$', ''), '\.$', ''), '^www\.', '') AS h,
         regexp_replace(regexp_replace(path, 'index\.html?$', ''), '/+$', '') AS p,
         list_sort(list_filter(string_split(regexp_extract(url, '^[^#?]*\?([^#]*)', 1), '&'),
           lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]*|ref|fbclid|gclid)(=|$)'))) AS q
  FROM parts),
named AS (
  SELECT *, CASE WHEN h <> '' THEN h || p || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS c
  FROM canon),
listed AS (SELECT DISTINCT c FROM named WHERE regexp_matches(host, '(^|[.-])(casino|pills|win|cheap)([.-]|$)') AND c IS NOT NULL),
fit AS (
  SELECT n.page_id, n.host, n.path, n.c,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM named n)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN l.c IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM fit LEFT JOIN listed l USING (c)
"""

_TOPK_SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_FIM_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
cut AS (
  SELECT *, CASE WHEN text = '' THEN [] ELSE regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') END AS units,
         CAST('0x' || hex[1:8] AS BIGINT) AS h1, CAST('0x' || hex[9:16] AS BIGINT) AS h2,
         CAST('0x' || hex[17:24] AS BIGINT) AS h3, CAST('0x' || hex[25:32] AS BIGINT) AS h4 FROM t),
drawn AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
         greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
              THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS p, coalesce(array_to_string(units[a + 1:b], ''), '') AS m,
         coalesce(array_to_string(units[b + 1:], ''), '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

_TRIE_SQL = r"""
WITH given AS (
  SELECT conv_id AS c, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS step,
         length(coalesce(text, '')) AS chars, turn
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, step, chars, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, step) AS pos FROM given),
-- CRC-32 of the decimal id, bit by bit.
h AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda v, x: list_reduce(list_prepend(xor(v, x), CAST(range(8) AS BIGINT[])),
        lambda w, i: CASE WHEN w % 2 = 1 THEN xor(w >> 1, 3988292384) ELSE w >> 1 END)), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM own)),
shared AS (
  SELECT h.c, b.step, b.chars, b.pos FROM h JOIN own b ON b.c = h.c - h.c % 100 AND b.pos <= h.h),
taken AS (SELECT c, count(*) AS n FROM shared GROUP BY c),
rows_ AS (
  SELECT c, step, chars, pos AS depth FROM shared
  UNION ALL SELECT own.c, step, chars, pos - h.h + coalesce(taken.n, 0) FROM own JOIN h USING (c) LEFT JOIN taken USING (c)
  WHERE pos > h.h),
paths AS (
  SELECT c, depth, chars, sha256(array_to_string(list(step) OVER w, ',')) AS k,
         CASE WHEN depth > 1 THEN sha256(array_to_string((list(step) OVER w)[:-2], ',')) ELSE '' END AS parent,
         depth = max(depth) OVER (PARTITION BY c) AS ends
  FROM rows_ WINDOW w AS (PARTITION BY c ORDER BY depth ROWS UNBOUNDED PRECEDING)),
everyone AS (
  SELECT * FROM paths
  UNION ALL SELECT c, 0, 0, '', NULL, c NOT IN (SELECT c FROM rows_) FROM h),
nodes AS (
  SELECT k, depth, any_value(parent) AS parent, min(c) AS c, count(*) AS n, max(chars) AS chars,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM everyone GROUP BY k, depth),
kids AS (SELECT parent AS k, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
own_totals AS (
  SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (k)),
-- A node's ancestors are the nodes on the path of any member, here the smallest.
totals AS (
  SELECT a.k, sum(CASE WHEN o.n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum((o.n - 1) * o.chars) AS saved
  FROM own_totals o JOIN everyone a ON a.c = o.c AND a.depth <= o.depth GROUP BY a.k)
SELECT o.c AS conv_id, CAST(o.depth AS BIGINT) AS depth, p.c AS parent_conv_id, o.n AS n_convs, o.n_children,
       CAST(t.leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, o.ends_sha256
FROM own_totals o LEFT JOIN nodes p ON p.k = o.parent JOIN totals t ON t.k = o.k
"""

ORACLE = {"op1_topk_search": _TOPK_SQL, "op10_url_filter": _URL_SQL, "op12_fill_in_middle": _FIM_SQL,
          "op13_prefix_trie": _TRIE_SQL}

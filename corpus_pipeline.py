"""Corpus pipeline: toxicity, n-gram Jaccard join, secret scans, mixing, BPE.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``documents``.
An empty table stays empty. Null and empty texts and null ids pass through the first
three stages; the mix takes no document of size 0, so null, empty and blank texts end
there. Rows that repeat an id count as one document in the join; rows without an id are
kept by it. The mix takes each row by itself, whatever its id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripframe.llm import bpe, mixing, partenum, secret_scan, toxicity
from tripframe.llm import common as C

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.5 (lexicon learned from
    the labelled documents among them)."""
    model = toxicity.fit(docs, C.table(spark, sf_dir, "labels"))
    kept = toxicity.scored(docs.select(*COLUMNS), model, name="_score").filter("_score < 0.5")
    return kept.select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every component of similar
    documents. Rows that repeat an id are one document; rows without an id
    stay."""
    found = partenum.join(docs)
    kept = C.stage(found.filter("doc_id = component_id").select("doc_id").distinct(), "pipeline-kept")
    docs = docs.select(*COLUMNS)
    return docs.join(kept, "doc_id", "left_semi").select(*COLUMNS).unionByName(
        docs.filter("doc_id is null"))


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their secrets masked and ``n_chars`` brought in line."""
    return (secret_scan.masked(docs.select(*COLUMNS))
            .withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast("long"))
            .select(*COLUMNS))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a unique ``_row`` that rereading repeats, as ids may be absent or
    repeat: the file and the place in it. Rows that don't come straight from files
    are written to the shared folder with a number."""
    try:
        return docs.select(*COLUMNS, F.struct(
            F.xxhash64("_metadata.file_path").alias("file"),
            F.col("_metadata.row_index").alias("place")).alias("_row"))
    except AnalysisException:
        return C.stage(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")),
                       "pipeline-rows")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the documents to target weights of their sources: each as
    often as the mix takes it (never, once or twice)."""
    docs = numbered(docs)
    taken = mixing.mix(mixing.of_source(docs, row="_row"), row="row").filter("passes_taken > 0")
    times = taken.select(F.col("row").alias("_row"), F.col("passes_taken").alias("_times"))
    # Dealt by row at every size, so texts of small and large inputs travel alike.
    return (docs.join(times.hint("merge"), "_row")
            .withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids and whether they decode to its very bytes."""
    got = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                     public_tokenizers.PATTERN, decoded=True)
    return got.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxic), ("ngram_join", near_copies), ("secrets", secret),
          ("mixing", mixed), ("bpe", encoded)]

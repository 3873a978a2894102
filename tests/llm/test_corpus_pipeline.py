"""The pipeline's stages take effect and keep the columns of documents."""

import corpus_pipeline as P
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F
from tripframe.llm import secret_scan

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    extra = [(10 ** 6, None, "en", None, 0), (10 ** 6 + 1, "", None, "src0", None),
             (10 ** 6 + 2, "token = abcdefghijklmnop", "en", "src0", 24)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    seen = {}
    for i, (name, f) in enumerate(P.STAGES):
        out = f(spark, docs, SF_SMALL)
        if i < len(P.STAGES) - 1:
            assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert ids["ngram_join"] <= ids["toxicity"] and ids["secrets"] == ids["ngram_join"]
    assert {10 ** 6, 10 ** 6 + 1, 10 ** 6 + 2} <= ids["ngram_join"]
    for r in seen["secrets"].collect():
        assert r.text is None or (secret_scan.find(r.text) == [] and r.n_chars == len(r.text))
    assert ids["mixing"] <= ids["secrets"]
    times = seen["mixing"].groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert times == 2
    rows = seen["bpe"].count()
    assert rows == seen["mixing"].count()
    bad = (seen["bpe"].join(seen["mixing"].select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
                                                  .alias("own")).distinct(), "doc_id")
           .filter("own <> decoded_sha256").count())
    assert bad == 0


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for name, f in P.STAGES:
        f(spark, docs, SF_SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_run_is_registered(spark):
    import __spark_entry__ as E
    assert E.queries()["pipeline"](spark, SF_SMALL).count() > 0


@pytest.mark.parametrize("stored", [True, False])
def test_mix_takes_rows_of_one_id_or_none_apart(spark, tmp_path, stored):
    docs = spark.createDataFrame(
        [(None, f"word {i} " * (3 + i % 5), "en", "src0" if i % 2 else "src1", 1) for i in range(40)]
        + [(7, f"other {i} " * (3 + i % 4), "en", "src0", 1) for i in range(41)]
        + [(100 + i, f"plain {i} text", "en", "src1", 1) for i in range(30)],
        "doc_id long, text string, lang string, source string, n_chars long")
    if stored:
        docs.write.parquet(str(tmp_path / "d"))
        docs = spark.read.parquet(str(tmp_path / "d"))
    got = P.mixed(spark, docs, SF_SMALL)
    assert got.columns == COLUMNS
    size = F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1))
    words = {r.source: r.w for r in docs.groupBy("source").agg(F.sum(size).alias("w")).collect()}
    from tripframe.llm import mixing
    want = mixing.targets(sorted(words.items()), mixing.WEIGHTS, mixing.SHARE, mixing.PASSES)
    took = {r.source: r.w for r in got.groupBy("source").agg(F.sum(size).alias("w")).collect()}
    assert all(abs(took[s] - want[s]) <= 12 for s in words)
    # Texts are distinct here: no row is taken more than twice.
    assert got.groupBy("text").count().agg(F.max("count")).first()[0] <= mixing.PASSES

"""Toy golden tables (FIXTURES.md section 2): literal inputs, hand-worked outputs."""

import hashlib
import math
import os
import tempfile

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripframe.functions import features
from tripframe.functions.hashing import md5_mod
from tripframe.operators import clean, encode, sequence, splits
from tripframe.sources import files


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_zero_filter(spark):
    df = spark.createDataFrame(
        list(zip([1, 0, 2, 3, 0, 4], [100, 200, 0, 300, 400, 500], [50, 0, 30, 0, 10, 45])),
        "DAY_TYPE int, LEN int, TIME_GAP int")
    assert rows(clean.zero_filter(df), "DAY_TYPE", "LEN", "TIME_GAP") == [(1, 100, 50), (4, 500, 45)]


def test_zero_filter_2(spark):
    df = spark.createDataFrame(
        list(zip([1, 0, 3, 4, 5, 0], [10, 20, 0, 40, 50, 60], [100, 200, 300, 0, 500, 600])),
        "A int, B int, C int")
    assert rows(clean.zero_filter(df), "A", "B", "C") == [(1, 10, 100), (5, 50, 500)]


def test_zero_filter_nulls_and_strings_pass(spark):
    df = spark.createDataFrame([(1, None, "0"), (2, 0, "x"), (3, 3, "0")], "k int, A int, S string")
    kept = sorted(r.k for r in clean.zero_filter(df, ["A"]).collect())
    assert kept == [1, 3]


def test_dropna_all(spark):
    df = spark.createDataFrame([(1, 1, None, None), (2, 2, None, 3), (3, None, None, None),
                                (4, 4, 5, None)], "obs_id long, A int, B int, C int")
    assert [r.obs_id for r in clean.drop_all_null(df).orderBy("obs_id").collect()] == [1, 2, 4]


def test_csv_blank_line_and_missing(spark):
    d = tempfile.mkdtemp(prefix="tf-csv-")
    with open(os.path.join(d, "a.csv"), "w") as fh:
        fh.write("DAY_TYPE,BUSINFOUNIT_ID,LEN,DEP_TIME,TIME_GAP\n"
                 "3, 000010002,388,00:00,40\n\n"
                 "3,000010003,120,00:01,41\n"
                 "3,000010004,,00:00,43\n")
    schema = T.StructType([T.StructField("DAY_TYPE", T.ByteType()),
                           T.StructField("BUSINFOUNIT_ID", T.StringType()),
                           T.StructField("LEN", T.IntegerType()),
                           T.StructField("DEP_TIME", T.StringType()),
                           T.StructField("TIME_GAP", T.IntegerType())])
    got = files.read_typed_csv(spark, d, schema).orderBy("BUSINFOUNIT_ID").collect()
    assert len(got) == 3
    assert got[0].BUSINFOUNIT_ID == "000010002"
    assert got[2].LEN is None and got[2].TIME_GAP == 43


def test_onehot_fixed_days(spark):
    df = spark.createDataFrame([(3,), (3,)], "DAY_TYPE int")
    cols = features.onehot("DAY_TYPE", features.DAY_TYPES)
    out = df.select(*[c.alias(f"d{d}") for c, d in zip(cols, features.DAY_TYPES)]).first()
    assert list(out) == [0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0]


def test_onehot_type(spark):
    df = spark.createDataFrame([(t,) for t in ["PATRN", "EVENT", "PATRN", "EVENT", "PATRN"]], "t string")
    cols = features.onehot("t", features.DATA_TYPES)
    out = df.select(*[c.alias(n) for c, n in zip(cols, features.DATA_TYPES)])
    assert out.columns == ["EVENT", "PATRN"]
    assert [tuple(r) for r in out.collect()] == [(0.0, 1.0), (1.0, 0.0), (0.0, 1.0), (1.0, 0.0), (0.0, 1.0)]


def test_label_encode(spark):
    ids = [10002120, 10003130, 10001110, 10002120, 10003130]
    df = spark.createDataFrame([(i, str(v)) for i, v in enumerate(ids)], "k int, id string")
    vocab = encode.label_vocabulary(df, "id")
    coded = encode.encode_known(df, vocab, "id").orderBy("k")
    assert [r.code for r in coded.collect()] == [1, 2, 0, 1, 2]


def test_label_extend(spark):
    vocab = encode.label_vocabulary(
        spark.createDataFrame([("1001",), ("1002",), ("1003",)], "id string"), "id")
    new = spark.createDataFrame([("1004",), ("1002",)], "id string")
    ext = {r.value: r.code for r in encode.extend_vocabulary(vocab, new, "id").collect()}
    assert ext == {"1001": 0, "1002": 1, "1003": 2, "1004": 3}


def test_known_filter(spark):
    vocab = encode.label_vocabulary(spark.createDataFrame([("3",), ("4",), ("6",)], "id string"), "id")
    df = spark.createDataFrame([(str(i),) for i in range(1, 6)], "id string")
    assert rows(encode.encode_known(df, vocab, "id"), "id") == [("3",), ("4",)]
    assert rows(encode.unknown_labels(df, vocab, "id"), "value") == [("1",), ("2",), ("5",)]


def test_standard_scale(spark):
    fit_df = spark.createDataFrame([(float(v),) for v in range(1, 6)], "x double")
    fit = encode.fit_standard(fit_df, ["x"])
    f = fit.first()
    assert f.mean_x == 3.0 and math.isclose(f.scale_x, math.sqrt(2))
    app = spark.createDataFrame([(6.0,), (7.0,), (8.0,)], "x double")
    got = [r.x_scaled for r in encode.apply_standard(app, fit, ["x"]).orderBy("x").collect()]
    for g, want in zip(got, [3 / math.sqrt(2), 4 / math.sqrt(2), 5 / math.sqrt(2)]):
        assert math.isclose(g, want)


def test_standard_scale_zero_std(spark):
    fit = encode.fit_standard(spark.createDataFrame([(5.0,), (5.0,)], "x double"), ["x"])
    assert fit.first().scale_x == 1.0


def test_md5_bucket(spark):
    ids = [1001, 1002, 1003, 1001]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], "k int, id int")
    got = [r.b for r in df.select("k", md5_mod("id", 100).alias("b")).orderBy("k").collect()]
    want = [int(hashlib.md5(str(v).encode()).hexdigest(), 16) % 100 for v in ids]
    assert got == want and got[0] == got[3]


def test_md5_bucket_large_n_and_null(spark):
    df = spark.createDataFrame([("000010002",), (None,)], "id string")
    got = [r.b for r in df.select(md5_mod("id", 30011).alias("b")).collect()]
    want = [int(hashlib.md5(s.encode()).hexdigest(), 16) % 30011 for s in ["000010002", "nan"]]
    assert got == want


def test_backfill(spark):
    rows_df = spark.createDataFrame([(i,) for i in range(8)], "obs_id long")
    scored = spark.createDataFrame([(5, 71), (6, 75), (7, 68)], "obs_id long, TIME_GAP_ESTIMATE int")
    got = [r.TIME_GAP_ESTIMATE for r in sequence.backfill(rows_df, scored).orderBy("obs_id").collect()]
    assert got == [-1] * 5 + [71, 75, 68]


def test_pad_short_group(spark):
    df = spark.createDataFrame([(1, "g", "07:00", 450), (2, "g", "07:01", 500), (3, "g", "07:02", 550)],
                               "obs_id long, seg string, DEP_TIME string, TIME_GAP int")
    got = sequence.padded_short_groups(df, ["seg"], ["DEP_TIME"], "TIME_GAP", 5).first()
    assert list(got.seq) == [450, 500, 550, 0, 0]


def test_short_group_gives_no_sequence(spark):
    df = spark.createDataFrame([(i, "g", f"07:0{i}", 10 * i) for i in range(3)],
                               "obs_id long, seg string, DEP_TIME string, TIME_GAP int")
    assert sequence.sliding_sequences(df, ["seg"], ["DEP_TIME"], ["TIME_GAP"], 5).count() == 0


def test_stratified_split(spark):
    df = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(10)], "obs_id long, s string")
    out = splits.stratified_split(df, ["s"])
    counts = {(r.s, r.dataset): r["count"] for r in out.groupBy("s", "dataset").count().collect()}
    for s in "ab":
        assert counts.get((s, "train"), 0) == 3
        assert counts.get((s, "validation"), 0) == 0
        assert counts.get((s, "test"), 0) == 2


def test_composite_filter(spark):
    df = spark.createDataFrame([(1, 4), (2, 5), (3, 6)], "A int, B int")
    assert rows(df.filter((F.col("A") > 2) & (F.col("B") <= 6)), "A", "B") == [(3, 6)]


def test_zfill_never_truncates(spark):
    from tripframe.functions.text import zfill
    df = spark.createDataFrame([("12",), ("1234567890",)], "s string")
    assert rows(df.select(zfill(F.col("s"), 9).alias("z")), "z") == [("000000012",), ("1234567890",)]


def test_composite_key_null(spark):
    from tripframe.functions.text import composite_key
    df = spark.createDataFrame([Row(r="1", s=None), Row(r="1", s="2")], "r string, s string")
    assert sorted(map(str, [x.k for x in df.select(composite_key("r", "s").alias("k")).collect()])) \
        == ["1_2", "None"]

"""Train / validation / test splits and sampling.

"Shuffle with seed 42" is a seeded md5 order of the row key: deterministic
under recomputation and repartitioning (a lost executor recomputes the
same split), and reproducible in SQL. Positions in that order come from
``positions``: one range-partitioned plan for strata of every size, so neither
a global split nor a hot stratum is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripframe.functions import clock
from tripframe.functions.hashing import seeded_hash
from tripframe.operators import positions
from tripframe.operators.positions import nullsafe_join
from tripframe.sources.files import stage_table

TRAIN, VAL, TEST = "train", "validation", "test"
DATASET = "dataset"

# D4 hour bins (left-closed) and their labels as in the source.
TIME_GROUP_EDGES = (0, 7, 12, 18, 24)
TIME_GROUP_LABELS = ("00-07", "06-12", "12-18", "18-24")


def _hashed(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.withColumn("_h", seeded_hash(key, seed))


def _ratio_cuts(train: float, val: float):
    def cuts(n: Column) -> list[Column]:
        a = F.floor(F.lit(float(train)) * n)
        return [a, a + F.floor(F.lit(float(val)) * n)]
    return cuts


def _assign(df: DataFrame, groups: Sequence[str], key: str, seed: int, cuts_of_n,
            labels: Sequence, name: str = DATASET) -> DataFrame:
    h = _hashed(df, key, seed)
    return positions.assign_by_cuts(h, groups, ["_h", key], cuts_of_n, labels, name).drop("_h")


def random_split(df: DataFrame, key: str = "obs_id", seed: int = 42,
                 train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Seeded order; [0, a) train, [a, b) validation, [b, n) test with
    a = floor(train*n), b = a + floor(val*n)."""
    return _assign(df, [], key, seed, _ratio_cuts(train, val), [TRAIN, VAL, TEST])


def two_step_split(df: DataFrame, key: str = "obs_id", seed: int = 42,
                   test: float = 0.3, half: float = 0.5) -> DataFrame:
    """Hold out ceil(test*n) rows, then split the hold-out into
    validation and ceil(half*t) test rows (train_test_split's rounding),
    all in one seeded order: train [0, a), validation [a, a + t - ceil(half*t)),
    test after, with a = n - ceil(test*n) and t = n - a."""
    def cuts(n: Column) -> list[Column]:
        a = n - F.ceil(F.lit(float(test)) * n)
        t = n - a
        return [a, a + t - F.ceil(F.lit(float(half)) * t)]
    return _assign(df, [], key, seed, cuts, [TRAIN, VAL, TEST])


def stratified_split(df: DataFrame, keys: Sequence[str], key: str = "obs_id",
                     seed: int = 42, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Per key combination floor(.7n) train, floor(.15n) validation, the
    rest test. Rows with a null key match no group and keep ``''``."""
    keys = list(keys)
    has_null = F.lit(False)
    for k in keys:
        has_null = has_null | F.col(k).isNull()
    nulls = df.filter(has_null).withColumn(DATASET, F.lit(""))
    rest = _assign(df.filter(~has_null), keys, key, seed, _ratio_cuts(train, val),
                   [TRAIN, VAL, TEST])
    return rest.unionByName(nulls)


def _move_fraction(df: DataFrame, frac: float, target: str, key: str, seed: int) -> DataFrame:
    """Move round-half-even(frac * n_train) seeded-first train rows to ``target``."""
    train = df.filter(F.col(DATASET) == TRAIN)
    other = df.filter(F.col(DATASET) != TRAIN)

    def cuts(n: Column) -> list[Column]:
        return [F.bround(F.lit(float(frac)) * n, 0)]

    moved = _assign(train.drop(DATASET), [], key, seed, cuts, [target, TRAIN])
    return moved.unionByName(other.select(*moved.columns))


def _empty_sets(df: DataFrame, keys: Sequence[str], train: float, val: float) -> tuple[bool, bool]:
    """Whether a stratified split leaves validation and test empty, from the sizes
    of the strata alone: nothing is ordered or written for it."""
    whole = df
    for k in keys:
        whole = whole.filter(F.col(k).isNotNull())
    sizes = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    start, end = _ratio_cuts(train, val)(F.col("_n"))
    got = sizes.agg(F.max(end - start), F.max(F.col("_n") - end)).first()
    return not got[0], not got[1]


def stratified_split_fallback(df: DataFrame, keys: Sequence[str], key: str = "obs_id",
                              seed: int = 42, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """D2 + D3: if validation or test ended empty, unassigned rows go to test,
    then val/(1-val) of train moves to validation (if it was empty) and
    (1-train-val)/(1-train) of the remaining train to test (if it was empty).

    Which sets stay empty follows from the sizes of the strata, so a split that
    needs no move is the plain one, and only the moves that are needed order the
    train rows once more. The rows are written once beforehand, as the sizes, the
    ranges and the split each read them."""
    df = stage_table(df, "strata")
    val_empty, test_empty = _empty_sets(df, keys, train, val)
    x = stratified_split(df, keys, key, seed, train, val)
    if val_empty or test_empty:
        x = x.withColumn(DATASET, F.when(F.col(DATASET) == "", F.lit(TEST)).otherwise(F.col(DATASET)))
    if val_empty:
        x = _move_fraction(x, val / (1 - val), VAL, key, seed + 1)
    if test_empty:
        x = _move_fraction(x, (1 - train - val) / (1 - train), TEST, key, seed + 2)
    return x


def time_group(hour: Column) -> Column:
    """Hour bins 0-7, 7-12, 12-18, 18-24 (left-closed)."""
    e, lab = TIME_GROUP_EDGES, TIME_GROUP_LABELS
    expr = F.lit(None).cast("string")
    for i in reversed(range(len(lab))):
        expr = F.when((hour >= e[i]) & (hour < e[i + 1]), F.lit(lab[i])).otherwise(expr)
    return expr


def timegroup_split(df: DataFrame, keys: Sequence[str], time_col: str = "DEP_TIME",
                    key: str = "obs_id", seed: int = 42, fallback: bool = False) -> DataFrame:
    """D2 with the departure time group as an extra key (intent of the
    source, whose ``%H:%M`` parse of ``HH:MM:SS`` would fail); with ``fallback``
    the source's D3 step follows where a set stayed empty."""
    # the hour is a column of its own, so it is parsed once and not once per bin edge;
    # the split reads its rows several times, so they are written with their group first
    x = (df.withColumn("_hour", clock.hour_of(time_col)).withColumn("time_group", time_group(F.col("_hour")))
           .drop("_hour"))
    keys = list(keys) + ["time_group"]
    if fallback:
        return stratified_split_fallback(x, keys, key, seed)
    return stratified_split(stage_table(x, "time_groups"), keys, key, seed)


def _count_by(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return nullsafe_join(df, counts, keys)


def _largest_remainder(counts: DataFrame, keys: Sequence[str], test: float, seed: int) -> DataFrame:
    """Per key (``counts``: keys + ``_c`` rows), the train-side count of a
    stratified split that holds out ceil(test * N) rows in total:
    floor(c / N * n_train) plus one for the keys with the largest
    remainders (ties in seeded key order; the source draws them at random).
    The class table is ranked with ``positions``, by remainder and then by a
    hash of the key, never in one task."""
    keys = list(keys)
    counts = positions.attach_scalars(counts, counts.agg(F.sum("_c").alias("_N")))
    n_train = F.col("_N") - F.ceil(F.lit(float(test)) * F.col("_N"))
    cont = F.col("_c") / F.col("_N") * n_train
    counts = (counts.withColumn("_fl", F.floor(cont)).withColumn("_rem", cont - F.floor(cont))
                    .withColumn("_ntr", n_train))
    need = counts.agg((F.max("_ntr") - F.sum("_fl")).alias("_need"))
    kh = seeded_hash(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), seed)
    ranked = positions.position(
        counts.withColumn("_kh", kh).withColumn("_ord", F.lit(1.0) - F.col("_rem")), [],
        ["_ord", "_kh", *keys], name="_rank")
    ranked = positions.attach_scalars(ranked, need)
    return ranked.select(*keys, (F.col("_fl") + F.when(F.col("_rank") < F.col("_need"), 1)
                                 .otherwise(0)).cast("long").alias("_ni"))


def _stratified_pass(rows: DataFrame, keys: Sequence[str], test: float, key: str, seed: int,
                     labels: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of keys seen once, the other rows labelled by a largest-remainder
    stratified split). Class sizes are counted once and the allocation runs
    on that small class table."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    x = nullsafe_join(rows, counts, keys)
    once = x.filter(F.col("_c") == 1).drop("_c")
    # one row per key: materialized once (shared checkpoint folder) so the
    # split's several consumers read it instead of re-ranking the classes
    alloc = _largest_remainder(counts.filter(F.col("_c") > 1), keys, test, seed).checkpoint()
    many = nullsafe_join(x.filter(F.col("_c") > 1).drop("_c"), alloc, keys)
    split = _assign(many, keys, key, seed, lambda n: [F.col("_ni")], list(labels)).drop("_ni")
    return once, split


def singleton_split(df: DataFrame, keys: Sequence[str], key: str = "obs_id",
                    seed: int = 42, temp: float = 0.3) -> DataFrame:
    """Keys seen once -> train; a stratified split holds out ceil(temp*N)
    rows of the rest (largest-remainder allocation per key, as the source's
    stratified train_test_split does); keys seen once in the held-out part
    -> train; the rest halves into validation / test the same way. Rows
    inside a key are taken in seeded order. The first pass is checkpointed
    to the shared checkpoint folder."""
    keys = list(keys)
    once, first = _stratified_pass(df, keys, temp, key, seed, [TRAIN, "_temp"])
    # the first pass feeds two consumers: checkpoint it (shared folder,
    # reliable) so the second pass does not re-run it
    first = first.checkpoint()
    held = first.filter(F.col(DATASET) == "_temp").drop(DATASET)
    tmp_once, second = _stratified_pass(held, keys, 0.5, key, seed + 1, [VAL, TEST])
    return (first.filter(F.col(DATASET) == TRAIN).unionByName(second)
                 .unionByName(tmp_once.withColumn(DATASET, F.lit(TRAIN)))
                 .unionByName(once.withColumn(DATASET, F.lit(TRAIN))))


def date_split(df: DataFrame, date_col: str = "COLLECT_DATE", train: float = 0.7,
               val: float = 0.15) -> DataFrame:
    """Distinct dates in order; first int(.7k) dates train, next int(.15k)
    validation, the rest test. The column is cut to its first ten characters, so
    all times of a day land in one set; only the distinct cut texts are parsed, and
    rows meet their set by the text. Rows without a date land in none. Spark
    broadcasts the table of texts only if it is small."""
    cut = F.substring(F.col(date_col).cast("string"), 1, 10)
    texts = df.select(cut.alias("_t")).filter("_t is not null").distinct()
    days = stage_table(texts.withColumn("_d", clock.date_text("_t")).filter("_d is not null"), "split_days")
    labelled = positions.assign_by_cuts(
        days.select("_d").distinct(), [], ["_d"], _ratio_cuts(train, val),
        [TRAIN, VAL, TEST], DATASET)
    sets = days.join(labelled, "_d").select("_t", DATASET)
    return df.withColumn("_cut", cut).join(sets, F.col("_cut") == F.col("_t"), "inner").drop("_cut", "_t")


def split_report(df: DataFrame, col: str = DATASET) -> DataFrame:
    """Rows and share per set."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    tot = counts.agg(F.sum("n").alias("_t"))
    return (positions.attach_scalars(counts, tot)
                  .select(col, "n", (F.col("n") / F.col("_t")).alias("ratio")))


def halve_groups(df: DataFrame, keys: Sequence[str], key: str = "obs_id",
                 seed: int = 42) -> DataFrame:
    """Per group floor(n/2) validation, the rest test."""
    return _assign(df, keys, key, seed, lambda n: [F.floor(F.lit(0.5) * n)], [VAL, TEST])


def banded_sample(df: DataFrame, band: Column, per_band: int = 20, key: str = "obs_id",
                  seed: int = 42) -> DataFrame:
    """Up to ``per_band`` rows per band, without replacement, in seeded order.
    Spark keeps each task's first ``per_band`` rows of a band before the shuffle
    (``WindowGroupLimit``), so at most ``per_band`` rows a task and band travel."""
    x = _hashed(df.withColumn("band", band), key, seed)
    order = Window.partitionBy("band").orderBy("_h", key)
    return (x.withColumn("_pick", F.row_number().over(order)).filter(F.col("_pick") <= per_band)
            .drop("_pick", "_h"))


def kfold(df: DataFrame, keys: Sequence[str], k: int = 5, key: str = "obs_id",
          seed: int = 42) -> DataFrame:
    """Stratified fold = position in the seeded order within the stratum mod k."""
    h = _hashed(df, key, seed)
    pos = positions.position(h, keys, ["_h", key])
    return pos.withColumn("fold", (F.col("_pos") % k).cast("int")).drop("_pos", "_h")

"""Serving bundle (I5): one folder that holds all that scoring needs.

``manifest`` (one JSON line: version, feature set, model inputs, target, input schema and
which parts exist), ``model`` (a fitted pipeline), ``input_scaler``, ``target_scaler`` and
``vocabulary`` (fit tables as Parquet). ``score`` reads nothing else: it refuses rows whose
schema differs, builds the inputs by the code that training used, scores, inverts the
target's scale and rounds. The manifest is written last, so a folder whose writing broke
off has none and can't be loaded.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripframe.functions.featuresets import FEATURE_SETS
from tripframe.operators import assembly, encode
from tripframe.operators.evaluate import np_round
from tripframe.operators.model import load_model, save_model
from tripframe.sources import files

VERSION = 1


class SchemaMismatch(ValueError):
    """Rows that lack a column the bundle reads, or have it in another type."""


@dataclass(frozen=True)
class Bundle:
    feature_set: str
    target: str
    schema: T.StructType
    model: PipelineModel
    input_scaler: DataFrame | None = None
    target_scaler: DataFrame | None = None
    vocabulary: DataFrame | None = None
    vocabulary_column: str | None = None

    def check(self, df: DataFrame) -> None:
        have = {f.name: f.dataType for f in df.schema.fields}
        wrong = [f"{f.name}: {f.dataType.simpleString()} wanted, "
                 f"{have[f.name].simpleString() if f.name in have else 'absent'}"
                 for f in self.schema.fields if have.get(f.name) != f.dataType]
        if wrong:
            raise SchemaMismatch("; ".join(wrong))

    def score(self, df: DataFrame, out: str = "TIME_GAP_ESTIMATE", keep: Sequence[str] = ("obs_id",)) -> DataFrame:
        """``keep``, ``prediction`` (on the target's own scale) and ``out`` (rounded half to
        even, int) per row. With a vocabulary, rows whose id it lacks are left out.
        Actuals are neither needed nor read."""
        self.check(df)
        x = df.select(*dict.fromkeys([*keep, *self.schema.fieldNames()]))
        if self.vocabulary is not None:
            x = encode.encode_known(x, self.vocabulary, self.vocabulary_column, "id_code")
        x = assembly.flat(x, FEATURE_SETS[self.feature_set], self.input_scaler)
        x = self.model.transform(x)
        if self.target_scaler is not None:
            x = encode.invert_standard(x.withColumnRenamed("prediction", "_scaled"), self.target_scaler, "_scaled",
                                       self.target, "prediction")
        return x.select(*keep, "prediction", np_round(F.col("prediction")).cast("int").alias(out))


def save(bundle: Bundle, path: str) -> None:
    """Writes every part, then the manifest. An older bundle at ``path`` is replaced."""
    spark = SparkSession.getActiveSession()
    save_model(bundle.model, f"{path}/model")
    tables = {n: getattr(bundle, n) for n in ("input_scaler", "target_scaler", "vocabulary")}
    for name, table in tables.items():
        if table is not None:
            files.save_fit_table(table, f"{path}/{name}")
    text = {"version": str(VERSION), "feature_set": bundle.feature_set, "target": bundle.target,
            "vocabulary_column": bundle.vocabulary_column or "", "input_schema": bundle.schema.json(),
            "inputs": json.dumps(FEATURE_SETS[bundle.feature_set].columns),
            "parts": json.dumps([n for n, t in tables.items() if t is not None])}
    files.write_json(spark.createDataFrame([text], ", ".join(f"{k} string" for k in text)), f"{path}/manifest")


def load(spark: SparkSession, path: str) -> Bundle:
    """The bundle at ``path``; a version or a feature set other than this library's is refused."""
    m = files.read_json(spark, f"{path}/manifest").first().asDict()
    if int(m["version"]) != VERSION:
        raise ValueError(f"bundle of version {m['version']}, {VERSION} wanted")
    if tuple(json.loads(m["inputs"])) != FEATURE_SETS[m["feature_set"]].columns:
        raise ValueError(f"inputs of feature set {m['feature_set']} have changed since the bundle was written")
    parts = {n: files.load_fit_table(spark, f"{path}/{n}") for n in json.loads(m["parts"])}
    return Bundle(m["feature_set"], m["target"], T.StructType.fromJson(json.loads(m["input_schema"])),
                  load_model(f"{path}/model"), vocabulary_column=m["vocabulary_column"] or None, **parts)

"""Models: ML pipelines for floods, scans and names, anomaly by reconstruction, scoring of given ONNX files."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from . import alerts as alert_ops


@dataclass
class Detector:
    """A rule with a name, a version and parameters, run over a table; its alerts carry the digest of its parameters."""

    name: str
    version: str
    params: dict = field(default_factory=dict)

    def decide(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def detect(self, df: DataFrame) -> DataFrame:
        return self.decide(df).withColumn("params_digest", alert_ops.params_digest(self.name, self.version, self.params))

    @property
    def parameters(self) -> str:
        return json.dumps(self.params, sort_keys=True)


class ThresholdDetector(Detector):
    """Rows whose column is at or over a threshold."""

    def decide(self, df: DataFrame) -> DataFrame:
        return df.where(F.col(self.params["column"]) >= self.params["threshold"])


def train_flood(rows: DataFrame, features: list[str], *, label: str = "label", trees: int = 20, seed: int = 7):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    assemble = VectorAssembler(inputCols=features, outputCol="x", handleInvalid="skip")
    return Pipeline(stages=[assemble, RandomForestClassifier(featuresCol="x", labelCol=label, numTrees=trees, maxDepth=6, seed=seed)]).fit(rows)


def positive(column: str = "probability") -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(column)[1]


def gate_flood(rows: DataFrame, *, p: float = 0.98, pps: float = 100.0, bps: float = 50_000.0, n: int = 20) -> DataFrame:
    """Scored flows that may alert: sure, fast, in a window with enough flows, and not like a scan."""
    c = F.col
    return rows.where((c("p") > p) & ((c("pps") > pps) | (c("bps") > bps)) & (c("n") >= n) & ~c("looks_like_scan"))


def train_scan_tree(rows: DataFrame, features: list[str], *, label: str = "label", depth: int = 4, seed: int = 7):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    assemble = VectorAssembler(inputCols=features, outputCol="x", handleInvalid="skip")
    return Pipeline(stages=[assemble, DecisionTreeClassifier(featuresCol="x", labelCol=label, maxDepth=depth, seed=seed)]).fit(rows)


def name_grams(name: Column) -> Column:
    return F.concat(*[text.pieces(F.lower(name), n) for n in (1, 2, 3)])


def train_domain_model(rows: DataFrame, *, name: str = "name", label: str = "label", bins: int = 1 << 16):
    """Character 1- to 3-grams, TF-IDF, logistic regression; input has a column grams made by name_grams()."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF

    stages = [HashingTF(inputCol="grams", outputCol="tf", numFeatures=bins), IDF(inputCol="tf", outputCol="x"), LogisticRegression(featuresCol="x", labelCol=label, regParam=0.01, maxIter=20)]
    return Pipeline(stages=stages).fit(rows.withColumn("grams", name_grams(F.col(name))))


def train_reconstruction(rows: DataFrame, features: list[str], *, k: int = 4):
    """Scaler and principal components of a table of features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    stages = [
        VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="z", withMean=True, withStd=True),
        PCA(k=k, inputCol="z", outputCol="pc"),
    ]
    return Pipeline(stages=stages).fit(rows)


def reconstruction_error(rows: DataFrame, model) -> DataFrame:
    """mse: the mean square of what the components leave over. As they are orthonormal, that is the square of the scaled
    vector less that of its projection."""
    from pyspark.ml.functions import vector_to_array

    square = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, x: a + x * x)
    return model.transform(rows).withColumn("mse", F.greatest(F.lit(0.0), square("z") - square("pc")) / F.size(vector_to_array("z")))


def lexical_decision(rows: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """confidence and strong, from the error and the entropy and length of the name."""
    from ..functions import stats

    heuristic = (F.col("entropy") > 4) & (F.col("len") > 30)
    conf = stats.anomaly_confidence(F.col("mse"), threshold)
    strong = (F.col("mse") > 2 * threshold) | ((F.col("entropy") > 4) & (F.col("len") > 20)) | (F.col("entropy") > 5)
    return rows.withColumns({"confidence": F.when(heuristic, F.greatest(F.lit(0.75), conf)).otherwise(conf), "strong": strong})


def _field(number: int, value: int | bytes) -> bytes:
    """A field of a protocol buffer: a number, or bytes with their length."""

    def varint(n: int) -> bytes:
        out = b""
        while n >= 0x80:
            out += bytes([n & 0x7F | 0x80])
            n >>= 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def linear_onnx(weights: list[list[float]], bias: list[float]) -> bytes:
    """An ONNX model of softmax(x W + b), for linear models fitted elsewhere; weights have a row a feature and a column
    a class."""
    import struct

    rows, classes = len(weights), len(bias)

    def tensor(name: str, dims: list[int], values: list[float]) -> bytes:
        return b"".join(_field(1, d) for d in dims) + _field(2, 1) + _field(8, name.encode()) + _field(9, struct.pack(f"<{len(values)}f", *values))

    def value(name: str, width: int) -> bytes:
        shape = _field(1, _field(2, b"n")) + _field(1, _field(1, width))
        return _field(1, name.encode()) + _field(2, _field(1, _field(1, 1) + _field(2, shape)))

    def node(op: str, inputs: list[str], output: str) -> bytes:
        return b"".join(_field(1, i.encode()) for i in inputs) + _field(2, output.encode()) + _field(4, op.encode())

    graph = b"".join(_field(1, n) for n in (node("MatMul", ["x", "w"], "xw"), node("Add", ["xw", "b"], "z"), node("Softmax", ["z"], "p"))) + _field(2, b"linear")
    graph += _field(5, tensor("w", [rows, classes], [v for row in weights for v in row])) + _field(5, tensor("b", [classes], bias)) + _field(11, value("x", rows)) + _field(12, value("p", classes))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, b"") + _field(2, 13))


def score_onnx(rows: DataFrame, model: bytes, features: list[str], *, keep: list[str]) -> DataFrame:
    """Probabilities of an ONNX model (its bytes) for the features in order; missing ones are 0, and rows that are all 0
    get no probability but the first class. One session a task."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = rows.select(*keep).schema.add("p", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import onnxruntime

        session = onnxruntime.InferenceSession(shared.value, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        for pdf in batches:
            x = pdf[[f"__x{i}" for i in range(len(features))]].fillna(0.0).to_numpy(np.float32)
            p = np.asarray(session.run(None, {name: x})[-1], float)
            p[~x.any(axis=1)] = [1.0] + [0.0] * (p.shape[1] - 1)
            yield pdf[keep].assign(p=list(p))

    cols = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"__x{i}") if f in rows.columns else F.lit(0.0).alias(f"__x{i}") for i, f in enumerate(features)]
    return rows.select(*keep, *cols).mapInPandas(run, schema)

"""Classifiers by name, selection on validation, fold grids and the device probe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sigmoid_clip
from .metrics import binary_metrics
from .splits import PROTOCOL_DEVICES

PREDICTION = (
    "representation string, classifier string, protocol string, fold int, sample_id bigint, subject_id bigint, device string, label int, probability double"
)
WEIGHTED = ("random_forest", "gradient_boosted_trees", "logistic_regression", "linear_svm")


def make_classifier(name: str, params: dict | None = None, width: int | None = None, seed: int = 42):
    """Pipeline of a scaler fitted with the model and the named classifier."""
    params = dict(params or {})
    common = {"featuresCol": "_x", "labelCol": "label"}
    weighted = {**common, "weightCol": "weight"}
    if name == "random_forest":
        model = RandomForestClassifier(seed=seed, **weighted, **{"numTrees": 100, **params})
    elif name == "gradient_boosted_trees":
        model = GBTClassifier(seed=seed, **weighted, **{"maxIter": 50, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.9, **params})
    elif name == "logistic_regression":
        model = LogisticRegression(**weighted, **{"maxIter": 200, "regParam": 0.01, **params})
    elif name == "linear_svm":
        model = LinearSVC(**weighted, **{"maxIter": 100, "regParam": 0.01, **params})
    elif name == "mlp":
        hidden = list(params.pop("hidden", [16]))
        if width is None:
            raise ValueError("the perceptron needs the input width")
        model = MultilayerPerceptronClassifier(seed=seed, layers=[width, *hidden, 2], **common, **{"maxIter": 100, **params})
    else:
        raise ValueError(f"unknown classifier {name}")
    return Pipeline(stages=[StandardScaler(inputCol="_v", outputCol="_x", withMean=True, withStd=True), model])


def is_packed(df: DataFrame, vector: str = "vector") -> bool:
    return isinstance(df.schema[vector].dataType, VectorUDT)


def packed(df: DataFrame, vector: str = "vector") -> DataFrame:
    """The vector as MLlib takes it; who fits many models on the same rows turns the arrays into it once."""
    return df if is_packed(df, vector) else df.withColumn(vector, array_to_vector(F.transform(vector, lambda x: x.cast("double"))))


def as_input(df: DataFrame, vector: str = "vector") -> DataFrame:
    return packed(df, vector).withColumn("_v", F.col(vector)).withColumn("label", F.col("label").cast("double"))


def label_weights(counts: dict[int, int], name: str) -> dict[int, float]:
    """Weight per label from its rows: balanced, or the negative/positive ratio on positives for boosted trees."""
    total, positive = sum(counts.values()), counts.get(1, 0)
    if name == "gradient_boosted_trees":
        return {1: max(1.0, (total - positive) / positive)} if positive else {}
    return {label: total / (len(counts) * n) for label, n in counts.items() if n}


def with_weights(train: DataFrame, name: str, counts: dict[int, int] | None = None) -> DataFrame:
    """``weight`` per row; the rows per label are counted unless they are known."""
    if counts is None:
        counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    weight = F.lit(1.0)
    for label, value in label_weights(counts, name).items():
        weight = F.when(F.col("label") == label, F.lit(value)).otherwise(weight)
    return train.withColumn("weight", weight)


def fit(train: DataFrame, name: str, params: dict | None = None, seed: int = 42, counts: dict[int, int] | None = None, width: int | None = None):
    """Fitted pipeline on (vector, label) rows; ``counts`` (rows per label) and ``width`` spare passes where they are known.

    A fit passes over its rows several times, so they are held while it runs; packed rows are held by the caller.
    """
    if name == "mlp" and width is None:
        width = len(train.select("vector").first()[0])
    rows = as_input(with_weights(train, name, counts)).select("_v", "label", "weight")
    if is_packed(train):
        return make_classifier(name, params, width, seed).fit(rows)
    rows = rows.persist()
    try:
        return make_classifier(name, params, width, seed).fit(rows)
    finally:
        rows.unpersist()


def score(model, df: DataFrame) -> DataFrame:
    """Add ``probability`` of the positive class; margins pass through the clipped sigmoid."""
    out = model.transform(as_input(df))
    if "probability" in out.columns:
        p = vector_to_array("probability")[1]
    else:
        p = sigmoid_clip(vector_to_array("rawPrediction")[1])
    return out.withColumn("_p", p).select(*[c for c in df.columns if c != "label"], F.col("label").cast("int").alias("label"), F.col("_p").alias("probability"))


def balanced_accuracy(scored: DataFrame) -> float:
    return binary_metrics(scored, []).first()["balanced_accuracy"]


def select_and_fit(train: DataFrame, validation: DataFrame, name: str, candidates: Sequence[dict], seed: int = 42):
    """(model refitted on train and validation, chosen parameters, tuning records).

    The highest validation balanced accuracy wins; the earliest candidate on a tie.
    """
    records = []
    for index, params in enumerate(candidates):
        value = balanced_accuracy(score(fit(train, name, params, seed + index), validation))
        records.append({"candidate": index, "hyperparameters": params, "validation_balanced_accuracy": value})
    best = max(records, key=lambda r: (r["validation_balanced_accuracy"] or 0.0, -r["candidate"]))
    return fit(train.unionByName(validation), name, best["hyperparameters"], seed), best["hyperparameters"], records


def fit_plan(grid: DataFrame) -> DataFrame:
    """Fit key of every cell: cells that differ only in the test devices share one fit."""
    rows = [(p, "".join(train)) for p, train, _ in PROTOCOL_DEVICES]
    trains = grid.sparkSession.createDataFrame(rows, "protocol string, train_devices string")
    return grid.join(F.broadcast(trains), "protocol").withColumn(
        "fit_key", F.concat_ws("|", "representation", "classifier", F.col("fold").cast("string"), "train_devices")
    )


def roles(rows: DataFrame, fold: int, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    validation = (fold + 1) % n
    return (
        rows.filter((F.col("fold") != fold) & (F.col("fold") != validation)),
        rows.filter(F.col("fold") == validation),
        rows.filter(F.col("fold") == fold),
    )


def device_probe(rows: DataFrame, fold: int, name: str = "logistic_regression", params: dict | None = None, seed: int = 42) -> DataFrame:
    """Predict the device from the vector: test predictions with label 1 for the phone."""
    probe = rows.withColumn("label", (F.col("device") == "S").cast("int"))
    model = fit(probe.filter(F.col("fold") != fold), name, params, seed)
    return score(model, probe.filter(F.col("fold") == fold))


"""Feature blocks as vectors: assembly, scaling, projection, alignment, separation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import text_hash
from .joins import attach_required
from .scan import numbered
from .splits import stratified


def assemble(features: DataFrame, representation: DataFrame, key: str = "sample_id") -> DataFrame:
    """Concatenate the blocks (feature, ordinal) of a representation per sample; a missing block fails.

    One aggregation per sample; a group holds as many rows as the representation has blocks.
    """
    wanted = representation.agg(F.count("*").alias("_blocks"))
    rows = features.join(representation, "feature")
    packed = rows.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "vector"))).alias("_p"), F.countDistinct("ordinal").alias("_n")
    )
    joined = packed.crossJoin(F.broadcast(wanted))
    vector = F.flatten(F.transform("_p", lambda p: p["vector"]))
    bad = (F.col("_n") != F.col("_blocks")) | (F.size("_p") != F.col("_blocks"))
    text = F.concat(F.lit("incomplete feature blocks for "), F.col(key).cast("string"))
    return joined.select(key, F.when(bad, F.raise_error(text).cast("array<float>")).otherwise(vector).alias("vector"))


def attach_features(manifest: DataFrame, features: DataFrame, key: str = "sample_id") -> DataFrame:
    """Vectors by key, never by position; a row without one fails."""
    return attach_required(manifest, features.select(key, "vector"), [key], "feature vector")


def attach_subject_features(df: DataFrame, subjects: DataFrame, key: str = "subject_id") -> DataFrame:
    """Subject-level values on every window of the subject; an unknown subject fails."""
    return attach_required(df, subjects, [key], "subject features")


def fit_scaler(train: DataFrame, vector: str = "vector") -> DataFrame:
    """One row: mean and population deviation per dimension of the training rows."""
    stats = train.select(array_to_vector(vector).alias("_v")).agg(
        Summarizer.mean(F.col("_v")).alias("_m"), Summarizer.variance(F.col("_v")).alias("_s"), F.count("*").alias("_n")
    )
    shrink = (F.col("_n") - 1) / F.col("_n")
    return stats.select(
        vector_to_array("_m").alias("mean"),
        F.transform(vector_to_array("_s"), lambda v: F.sqrt(v * shrink)).alias("std"),
    )


def scale(df: DataFrame, scaler: DataFrame, vector: str = "vector") -> DataFrame:
    """Standard scores; a constant dimension keeps divisor one."""
    params = F.broadcast(scaler.select(F.col("mean").alias("_mean"), F.col("std").alias("_std")))
    divisor = F.transform("_std", lambda s: F.when(s > 0, s).otherwise(F.lit(1.0)))
    centred = F.zip_with(vector, "_mean", lambda x, m: x.cast("double") - m)
    return (
        df.crossJoin(params)
        .withColumn(vector, F.zip_with(centred, divisor, lambda x, s: x / s))
        .drop("_mean", "_std")
    )


def fit_pca(df: DataFrame, k: int, vector: str = "vector"):
    """(principal axes of the rows, coordinates of their mean); take the first d coordinates for any smaller dimension."""
    rows = df.select(array_to_vector(vector).alias("_v"))
    model = PCA(k=k, inputCol="_v", outputCol="_z").fit(rows)
    mean = rows.agg(Summarizer.mean(F.col("_v"))).first()[0].toArray()
    return model, [float(x) for x in mean @ model.pc.toArray()]


def project(df: DataFrame, model, vector: str = "vector", dimensions: int | None = None) -> DataFrame:
    """Coordinates on the axes, centred on the rows of the fit; optionally only the first ``dimensions``."""
    axes, center = model
    out = axes.transform(df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double")))))
    z = F.zip_with(vector_to_array("_z"), F.array(*[F.lit(c) for c in center]), lambda x, c: x - c)
    return out.withColumn(vector, F.slice(z, 1, dimensions) if dimensions else z).drop("_v", "_z")


def pca_fold(
    train: DataFrame, validation: DataFrame, test: DataFrame, target_validation: DataFrame | None, k: int, dimensions: Sequence[int]
) -> dict[int, tuple[DataFrame, DataFrame, DataFrame, DataFrame]]:
    """Per dimension: (tuning train, tuning validation, refit train, test).

    Tuning sees training rows only. The refit also sees validation rows and, on
    cross-device protocols, the unlabelled validation rows of the target device; never test rows.
    """
    tuning = fit_pca(train, k)
    fit_rows = train.unionByName(validation)
    basis = fit_rows.select("vector")
    if target_validation is not None:
        basis = basis.unionByName(target_validation.select("vector"))
    refit = fit_pca(basis, k)
    return {
        d: (project(train, tuning, "vector", d), project(validation, tuning, "vector", d), project(fit_rows, refit, "vector", d), project(test, refit, "vector", d))
        for d in dimensions
    }


def covariance(df: DataFrame, vector: str = "vector") -> tuple[np.ndarray, np.ndarray]:
    """(mean, sample covariance): two tree-aggregated passes; only d and d*d numbers reach the driver."""
    rows = df.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("_v"))
    mean, variance = rows.agg(Summarizer.mean(F.col("_v")), Summarizer.variance(F.col("_v"))).first()
    corr = np.nan_to_num(Correlation.corr(rows, "_v").first()[0].toArray(), nan=0.0)
    np.fill_diagonal(corr, 1.0)
    std = np.sqrt(variance.toArray())
    return mean.toArray(), corr * np.outer(std, std)


def coral_fit(source: DataFrame, target: DataFrame, ridge: float = 1e-5, target_moments: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source mean, target mean, matrix) that gives source rows the covariance of the target rows; known moments of the target spare its passes."""
    ms, cs = covariance(source)
    mt, ct = target_moments or covariance(target)
    size = len(ms)
    unit = ridge * max(np.trace(cs) / size, np.trace(ct) / size, 1e-12)

    def power(c: np.ndarray, exponent: float) -> np.ndarray:
        values, axes = np.linalg.eigh(c + np.eye(size) * unit)
        return (axes * np.maximum(values, 1e-12) ** exponent) @ axes.T

    return ms, mt, power(cs, -0.5) @ power(ct, 0.5)


def coral_apply(df: DataFrame, fitted: tuple[np.ndarray, np.ndarray, np.ndarray], vector: str = "vector") -> DataFrame:
    """Aligned rows: one matrix product per Arrow batch, the d*d matrix sent once."""
    sent = df.sparkSession.sparkContext.broadcast(fitted)

    @F.pandas_udf("array<double>")
    def align(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ms, mt, matrix = sent.value
        for rows in batches:
            x = np.stack([np.asarray(v, dtype=float) for v in rows])
            yield pd.Series(list((x - ms) @ matrix + mt))

    return df.withColumn(vector, align(F.transform(vector, lambda x: x.cast("double"))))


def silhouette(sample: DataFrame, group: str, key: str = "sample_id", vector: str = "vector") -> DataFrame:
    """Mean Euclidean silhouette of a bounded sample, grouped by one label column.

    The sample (at most cells * k rows by construction) is sent to every task;
    each task measures its own rows against it, so no pairs of rows are built.
    """
    spark = sample.sparkSession
    rows = sample.select(key, F.col(group).cast("string").alias("_g"), vector).orderBy(key).collect()
    points = np.array([r[2] for r in rows], dtype=float)
    names = sorted({r[1] for r in rows})
    codes = np.array([names.index(r[1]) for r in rows])
    sent = spark.sparkContext.broadcast((points, codes, len(names)))

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points, codes, k = sent.value
        sizes = np.bincount(codes, minlength=k)
        for pdf in frames:
            out = []
            for position in pdf["position"].to_numpy():
                distance = np.sqrt(((points - points[position]) ** 2).sum(axis=1))
                sums = np.bincount(codes, weights=distance, minlength=k)
                own = codes[position]
                if sizes[own] == 1:
                    out.append(0.0)
                    continue
                a = sums[own] / (sizes[own] - 1)
                b = min(sums[c] / sizes[c] for c in range(k) if c != own)
                out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
            yield pd.DataFrame({"s": out})

    each = spark.range(len(rows)).withColumnRenamed("id", "position").mapInPandas(batches, "s double")
    return each.agg(F.count("*").alias("n"), F.avg("s").alias("silhouette")).withColumn("grouping", F.lit(group))


def separation(df: DataFrame, per_cell: int = 600, k: int = 10, seed: int = 42) -> DataFrame:
    """Silhouette by device and by class in the leading principal coordinates of a stratified sample."""
    sample = stratified(df, ["device", "label"], per_cell, "sample_id", seed)
    model = fit_pca(sample, k)
    low = project(sample, model)
    share = float(model[0].explainedVariance.toArray().sum())
    both = silhouette(low, "device").unionByName(silhouette(low, "label"))
    return both.withColumn("explained_variance", F.lit(share))


def pair_contrast(pairs: DataFrame, key: str, temperature: float = 0.1, batch: int = 64, seed: int = 42) -> DataFrame:
    """Contrastive loss of (r, s) vector pairs within batches of fixed size.

    Pairs are dealt into batches by digest order. A batch has at most ``batch``
    pairs, so its similarity matrix is a bounded product inside one task.
    """
    dealt = numbered(pairs.withColumn("_h", text_hash(seed, key)), [], "_h", "_rank", tie=(key,)).withColumn(
        "batch", F.floor((F.col("_rank") - 1) / batch).cast("long")
    )

    def loss(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.concatenate([np.stack(pdf[c].map(lambda v: np.asarray(v, dtype=float))) for c in ("r", "s")])
        z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        n = len(pdf)
        sim = z @ z.T / temperature
        np.fill_diagonal(sim, -np.inf)
        top = sim.max(axis=1, keepdims=True)
        log_sum = np.log(np.exp(sim - top).sum(axis=1)) + top[:, 0]
        mate = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
        value = float((log_sum - sim[np.arange(2 * n), mate]).mean())
        return pd.DataFrame({"batch": [pdf["batch"].iloc[0]], "pairs": [n], "loss": [value]})

    return dealt.select("batch", "r", "s").groupBy("batch").applyInPandas(loss, "batch long, pairs long, loss double")


def cross_covariance(df: DataFrame, left: str, right: str, epsilon: float = 1e-6) -> DataFrame:
    """Mean squared normalised covariance between the dimensions of two blocks; only d*d numbers reach the driver."""
    spark: SparkSession = df.sparkSession
    both = df.select(F.concat(left, right).alias("vector"), F.size(left).alias("_w"))
    width = both.select("_w").first()[0]
    _, cov = covariance(both)
    std = np.sqrt(np.diag(cov))
    normal = cov / np.outer(std + epsilon, std + epsilon)
    block = normal[:width, width:]
    return spark.createDataFrame([(int(block.size), float((block**2).mean()))], "pairs long, penalty double")

"""Binary metrics, rank metrics and curves of (label, probability) rows, for any number of groups at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import predict
from .ranks import cumulative

COUNTS = ("tn", "fp", "fn", "tp")
SCORES = (
    "accuracy", "balanced_accuracy", "precision", "sensitivity", "specificity", "f1", "macro_f1", "mcc", "cohen_kappa",
)


def confusion(label: str = "label", probability: str = "probability", threshold: float = 0.5) -> list[Column]:
    truth, guess = F.col(label), predict(probability, threshold)
    return [
        F.count_if((truth == 0) & (guess == 0)).alias("tn"),
        F.count_if((truth == 0) & (guess == 1)).alias("fp"),
        F.count_if((truth == 1) & (guess == 0)).alias("fn"),
        F.count_if((truth == 1) & (guess == 1)).alias("tp"),
    ]


def scores_from_counts(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Closed forms of the metrics; undefined values are NULL, ratios with an empty prediction are 0."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in COUNTS)
    n = tn + fp + fn + tp

    def ratio(a: Column, b: Column, empty: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(empty)

    null, zero = F.lit(None).cast("double"), F.lit(0.0)
    sens, spec = ratio(tp, tp + fn, null), ratio(tn, tn + fp, null)
    f1_pos, f1_neg = ratio(2 * tp, 2 * tp + fp + fn, zero), ratio(2 * tn, 2 * tn + fp + fn, zero)
    has_pos, has_neg = (tp + fp + fn) > 0, (tn + fp + fn) > 0
    macro = (
        F.when(has_pos & has_neg, (f1_pos + f1_neg) / 2.0).when(has_pos, f1_pos).otherwise(f1_neg)
    )
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    return df.select(
        *keep,
        *COUNTS,
        n.cast("long").alias("n"),
        (tn + fp).cast("long").alias("support_negative"),
        (tp + fn).cast("long").alias("support_positive"),
        ((tp + tn) / n).alias("accuracy"),
        F.when(sens.isNull(), spec).when(spec.isNull(), sens).otherwise((sens + spec) / 2.0).alias("balanced_accuracy"),
        ratio(tp, tp + fp, zero).alias("precision"),
        sens.alias("sensitivity"),
        spec.alias("specificity"),
        f1_pos.alias("f1"),
        macro.alias("macro_f1"),
        F.when(spread > 0, (tp * tn - fp * fn) / spread).otherwise(zero).alias("mcc"),
        F.when(chance < 1, ((tp + tn) / n - chance) / (1.0 - chance)).alias("cohen_kappa"),
    )


def binary_metrics(df: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Four conditional counts per group, then closed forms; partial sums happen before the shuffle."""
    counted = df.groupBy(*by).agg(*confusion(threshold=threshold))
    return scores_from_counts(counted, list(by))


def scoped_metrics(df: DataFrame, by: Sequence[str], device: str = "device") -> DataFrame:
    """Overall rows and one row per device in one pass: ``scope`` and ``device_scope``."""
    by = list(by)
    keys = [F.col(c) for c in [*by, device]]
    counted = df.groupingSets([keys, keys[:-1]], *keys).agg(F.grouping(device).alias("_g"), *confusion())
    scoped = counted.withColumn("scope", F.when(F.col("_g") == 1, "overall").otherwise("per_device")).withColumn(
        "device_scope", F.when(F.col("_g") == 1, "all").otherwise(F.col(device))
    )
    return scores_from_counts(scoped, [*by, "scope", "device_scope"])


def _steps(df: DataFrame, by: Sequence[str], descending: bool) -> DataFrame:
    one = F.lit(1).cast("long")
    return cumulative(
        df.select(*by, "label", "probability"),
        by,
        "probability",
        {"n": one, "pos": (F.col("label") == 1).cast("long")},
        descending=descending,
    )


def roc_auc(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Area under the ROC curve by mid-ranks; NULL for a group with one class."""
    steps = _steps(df, by, descending=False)
    mid = F.col("n_cum") - (F.col("n") - 1) / 2.0
    p, total = F.max("pos_all").cast("double"), F.max("n_all").cast("double")
    out = steps.groupBy(*by).agg(F.sum(F.col("pos") * mid).alias("_r"), p.alias("_p"), total.alias("_n"))
    neg = F.col("_n") - F.col("_p")
    auc = (F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2.0) / (F.col("_p") * neg)
    return out.select(*by, F.when((F.col("_p") > 0) & (neg > 0), auc).alias("roc_auc"))


def average_precision(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum of recall steps times precision over the distinct thresholds; NULL for one class."""
    steps = _steps(df, by, descending=True)
    gain = F.col("pos").cast("double") * F.col("pos_cum") / F.col("n_cum")
    out = steps.groupBy(*by).agg(F.sum(gain).alias("_g"), F.max("pos_all").alias("_p"), F.max("n_all").alias("_n"))
    ok = (F.col("_p") > 0) & (F.col("_p") < F.col("_n"))
    return out.select(*by, F.when(ok, F.col("_g") / F.col("_p")).alias("average_precision"))


def roc_points(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """One point per distinct threshold: false and true positive rate."""
    steps = _steps(df, by, descending=True).filter((F.col("pos_all") > 0) & (F.col("pos_all") < F.col("n_all")))
    return steps.select(
        *by,
        F.col("probability").alias("threshold"),
        ((F.col("n_cum") - F.col("pos_cum")) / (F.col("n_all") - F.col("pos_all"))).alias("fpr"),
        (F.col("pos_cum") / F.col("pos_all")).alias("tpr"),
    )


def pr_points(df: DataFrame, by: Sequence[str]) -> DataFrame:
    steps = _steps(df, by, descending=True).filter(F.col("pos_all") > 0)
    return steps.select(
        *by,
        F.col("probability").alias("threshold"),
        (F.col("pos_cum") / F.col("n_cum")).alias("precision"),
        (F.col("pos_cum") / F.col("pos_all")).alias("recall"),
    )


def calibration(df: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """Mean predicted probability against observed rate in equal-width bins; empty bins are absent."""
    cell = F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).cast("int")
    return df.withColumn("bin", cell).groupBy(*by, "bin").agg(
        F.count("*").alias("n"),
        F.avg("probability").alias("mean_predicted"),
        F.avg(F.col("label").cast("double")).alias("observed"),
    )

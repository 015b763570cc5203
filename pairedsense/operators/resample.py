"""Bootstrap over subjects, percentile intervals and verdicts, for many comparisons in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import text_hash, with_mixed
from ..session import stage
from .metrics import binary_metrics
from .scan import numbered

SEED_STEP = 1000003
SENT_ROWS = 100_000


def draws(scores: DataFrame, by: Sequence[str], unit: str, metrics: Sequence[str], iterations: int = 2000, seed: int = 42) -> DataFrame:
    """Mean of every metric over units drawn with replacement: one row per (group, iteration).

    Each of the n units of a group fills one slot of each iteration; a slot
    draws a unit number from an integer mixer. The draws are joined to the
    scores on (group, number), so nothing is held per iteration. Scores of up to
    ``SENT_ROWS`` rows are sent to the draws, which then sum up before their only
    shuffle; longer tables meet them in a shuffled join. The answer is the same.
    """
    by = list(by)
    base = stage(
        numbered(scores.select(*by, unit, *metrics, text_hash(seed, unit).alias("_h")), by, "_h", "_slot", tie=(unit,)).drop("_h"), "scores"
    )
    size = base.groupBy(*by).agg(F.count("*").alias("_n")) if by else base.agg(F.count("*").alias("_n"))
    slots = base.select(*by, "_slot")
    slots = slots.join(size, by) if by else slots.crossJoin(F.broadcast(size))
    # A small score table would sit in one task; its slots are spread before they are multiplied.
    tasks = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = slots.repartition(tasks, *[F.col(k) for k in by], F.col("_slot"))
    each = spread.withColumn("iteration", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(iterations - 1).cast("long"))))
    table = base.drop(unit)
    table = F.broadcast(table) if base.limit(SENT_ROWS + 1).count() <= SENT_ROWS else table
    mixed = with_mixed(with_mixed(each, "_a", F.col("iteration") + seed * SEED_STEP), "_b", F.col("_a") + F.col("_slot"))
    # Never NULL: a NULL test pushed below the mixing steps would write them out into each other.
    picks = mixed.select(*by, "iteration", F.coalesce(F.col("_b") % F.col("_n") + 1, F.lit(0)).alias("_slot"))
    return picks.join(table, [*by, "_slot"]).groupBy(*by, "iteration").agg(*[F.avg(m).alias(m) for m in metrics])


def bootstrap_diff(
    a: DataFrame, b: DataFrame, unit: str, metrics: Sequence[str], iterations: int = 2000, seed: int = 42
) -> DataFrame:
    """Bootstrap of the mean difference of two score tables over their common units."""
    left = a.select(unit, *[F.col(m).alias(f"_a_{m}") for m in metrics])
    right = b.select(unit, *[F.col(m).alias(f"_b_{m}") for m in metrics])
    difference = left.join(right, unit).select(unit, *[(F.col(f"_a_{m}") - F.col(f"_b_{m}")).alias(m) for m in metrics])
    return draws(difference, [], unit, metrics, iterations, seed)


def long_draws(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.select(
        *by, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]))
    )


def interval(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean, sample deviation and the 2.5 % and 97.5 % points of the draws.

    ``percentile`` holds the draws of one group: their number is the iteration count.
    """
    return df.groupBy(*by).agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.percentile("value", F.lit(0.025)).alias("ci95_low"),
        F.percentile("value", F.lit(0.975)).alias("ci95_high"),
        F.count("*").alias("iterations"),
    )


def verdict(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Two-sided p of a difference and whether its interval excludes zero."""
    low, high = F.percentile("value", F.lit(0.025)), F.percentile("value", F.lit(0.975))
    below = F.avg((F.col("value") <= 0).cast("double"))
    above = F.avg((F.col("value") >= 0).cast("double"))
    out = df.groupBy(*by).agg(
        F.avg("value").alias("mean_difference"),
        low.alias("ci95_low"),
        high.alias("ci95_high"),
        F.least(F.lit(1.0), F.lit(2.0) * F.least(below, above)).alias("p_value"),
    )
    return out.withColumn(
        "interpretation",
        F.when((F.col("ci95_low") > 0) | (F.col("ci95_high") < 0), "CI excludes zero").otherwise("CI includes zero"),
    )


def skipped(predictions: DataFrame, specs: DataFrame, n_folds: int, keys: Sequence[str]) -> DataFrame:
    """Comparisons that cannot be made, with the reason: an arm lacks folds, or the sample sets differ.

    Folds and rows per arm settle most; only comparisons of two complete arms with equally many rows are
    matched row by row. ``predictions`` is read twice: stage what is dear to make.
    """
    cells = predictions.groupBy("arm", "fold").agg(F.count("*").alias("_rows"))
    arms = cells.groupBy("arm").agg(F.count("fold").alias("_f"), F.sum("_rows").alias("_n"))
    left, right = (arms.select(F.col("arm").alias(side), F.col("_f").alias(f"_f_{side}"), F.col("_n").alias(f"_n_{side}")) for side in ("left", "right"))
    folds = F.least(F.coalesce("_f_left", F.lit(0)), F.coalesce("_f_right", F.lit(0)))
    known = F.when(folds < n_folds, "incomplete folds").when(~F.col("_n_left").eqNullSafe(F.col("_n_right")), "prediction sets do not align")
    judged = stage(specs.join(left, "left", "left").join(right, "right", "left").select("comparison", "left", "right", known.alias("reason")), "judged")
    first = F.struct(F.lit("l").alias("side"), F.col("left").alias("arm"))
    second = F.struct(F.lit("r").alias("side"), F.col("right").alias("arm"))
    sides = judged.filter("reason is null").select("comparison", F.inline(F.array(first, second)))
    uneven = (
        predictions.join(F.broadcast(sides), "arm")
        .groupBy("comparison", *keys)
        .agg(F.count_if(F.col("side") == "l").alias("_l"), F.count_if(F.col("side") == "r").alias("_r"))
        .filter(F.col("_l") != F.col("_r"))
        .select("comparison")
        .distinct()
        .withColumn("reason", F.lit("prediction sets do not align"))
    )
    return judged.filter("reason is not null").select("comparison", "reason").unionByName(uneven)


def compare_all(
    predictions: DataFrame,
    specs: DataFrame,
    metrics: Sequence[str],
    n_folds: int,
    keys: Sequence[str] = ("subject_id", "sample_id", "label"),
    iterations: int = 2000,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """(results, skipped) of every comparison (comparison, left, right) over subject scores; the predictions are made once."""
    predictions = stage(predictions.select("arm", "fold", "probability", *dict.fromkeys(["subject_id", "label", *keys])), "predictions")
    out = stage(skipped(predictions, specs, n_folds, keys), "skipped")
    usable = specs.join(out, "comparison", "left_anti")
    scores = stage(binary_metrics(predictions, ["arm", "subject_id"]).select("arm", "subject_id", *metrics), "arm_scores")

    def side(name: str, prefix: str) -> DataFrame:
        return scores.select(F.col("arm").alias(name), "subject_id", *[F.col(m).alias(f"{prefix}{m}") for m in metrics])

    paired = usable.join(side("left", "_a_"), "left").join(side("right", "_b_"), ["right", "subject_id"])
    difference = paired.select(
        "comparison", "subject_id", *[(F.col(f"_a_{m}") - F.col(f"_b_{m}")).alias(m) for m in metrics]
    )
    drawn = draws(difference, ["comparison"], "subject_id", metrics, iterations, seed)
    judged = verdict(long_draws(drawn, ["comparison"], metrics), ["comparison", "metric"])
    point = long_draws(difference, ["comparison"], metrics).groupBy("comparison", "metric").agg(F.avg("value").alias("point_difference"))
    return judged.join(point, ["comparison", "metric"]), out

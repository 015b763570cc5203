"""Paired and two-sample tests for any number of groups at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import signed_rank_p_value, t_critical, t_p_value, z_p_value
from ..session import stage
from .ranks import mid_ranks, quantiles
from .slopes import median_slopes

# Points of a key that meet as many others in one cell.


def moments(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )


def t_interval(df: DataFrame, by: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """Mean with its t confidence interval; fewer than two values give NULL limits."""
    base = moments(df, by, value)
    half = t_critical(0.5 + level / 2.0, F.col("n") - 1) * F.col("std") / F.sqrt("n")
    return base.withColumn("_h", half).select(
        *by, "n", "mean", "std", (F.col("mean") - F.col("_h")).alias("ci95_low"), (F.col("mean") + F.col("_h")).alias("ci95_high")
    )


def paired_t_statistic(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return moments(df, by, value).withColumn("t", F.try_divide("mean", F.col("std") / F.sqrt("n")))


def paired_t(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """t test of paired differences against zero."""
    return paired_t_statistic(df, by, value).withColumn("p_value", t_p_value(F.col("t"), F.col("n") - 1))


def wilcoxon_statistic(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rank sums of the non-zero differences (mid-ranks), the tie term and the normal score."""
    by = list(by)
    nonzero = df.filter(F.col(value) != 0).select(*by, F.abs(value).alias("_a"), (F.col(value) > 0).cast("long").alias("_up"))
    ranked = mid_ranks(nonzero, by, "_a", {"up": F.col("_up")})
    sums = ranked.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("up") * F.col("mid_rank")).alias("w_plus"),
        F.sum((F.col("n") - F.col("up")) * F.col("mid_rank")).alias("w_minus"),
        F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("ties"),
    )
    n = F.col("n").cast("double")
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2.0) / 24.0)
    return sums.withColumn("statistic", F.least("w_plus", "w_minus")).withColumn(
        "z", F.try_divide(F.col("statistic") - n * (n + 1) / 4.0, spread)
    )


def wilcoxon(df: DataFrame, by: Sequence[str], value: str, method: str = "exact") -> DataFrame:
    """Two-sided signed-rank test; the exact distribution costs n**3 per group, so large groups want ``normal``."""
    out = wilcoxon_statistic(df, by, value)
    return out.withColumn("p_value", signed_rank_p_value(F.col("statistic"), F.col("n"), F.col("z"), F.col("ties"), method))


def mann_whitney_statistic(df: DataFrame, by: Sequence[str], group: str, first: str, value: str) -> DataFrame:
    """U of the first group, Cliff's delta, and the normal score with tie and continuity correction."""
    by = list(by)
    mine = (F.col(group) == first).cast("long")
    ranked = mid_ranks(df.select(*by, value, mine.alias("_m")), by, value, {"mine": F.col("_m")})
    sums = ranked.groupBy(*by).agg(
        F.sum("mine").alias("n1"),
        F.sum(F.col("n") - F.col("mine")).alias("n2"),
        F.sum(F.col("mine") * F.col("mid_rank")).alias("_r"),
        F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("_ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    total = n1 + n2
    u = F.col("_r") - n1 * (n1 + 1) / 2.0
    both = (n1 > 0) & (n2 > 0)
    spread = F.sqrt(n1 * n2 / 12.0 * ((total + 1) - F.try_divide(F.col("_ties"), total * (total - 1))))
    top = F.greatest(F.col("u"), n1 * n2 - F.col("u"))
    return (
        sums.withColumn("u", F.when(both, u))
        .withColumn("cliffs_delta", F.when(both, 2.0 * F.col("u") / (n1 * n2) - 1.0))
        .withColumn("z", F.when(both & (spread > 0), F.greatest((top - n1 * n2 / 2.0 - 0.5) / spread, F.lit(0.0))))
        .drop("_r", "_ties")
    )


def mann_whitney(df: DataFrame, by: Sequence[str], group: str, first: str, value: str) -> DataFrame:
    """Two-sided p by the normal approximation."""
    return mann_whitney_statistic(df, by, group, first, value).withColumn("p_value", z_p_value(F.col("z")))


def theil_sen(anchors: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Median-of-slopes line per key over its anchors, one point per anchor.

    The median is found by slope selection (``slopes.median_slopes``): rows in
    proportion to the anchors and the bits of their number, none per pair. Adds the intercept median(y) - slope *
    median(x), the largest residual and the drift per hour; a key with fewer than
    two different x has none.
    """
    by = list(by)
    # The numbers are written once, so that every branch and every retried task sees the same blocks.
    points = stage(
        anchors.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.monotonically_increasing_id().alias("_i")),
        "points",
    )
    sizes = points.groupBy(*by).agg(F.count("*").alias("points"))
    slope = median_slopes(points, by)
    middle = quantiles(points, by, {"_mx": ("_x", 0.5), "_my": ("_y", 0.5)})
    line = sizes.join(slope, by).join(middle, by)
    line = stage(line.select(*by, "points", "slope", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept")), "lines")
    off = F.abs(F.col("_y") - F.col("intercept") - F.col("slope") * F.col("_x"))
    worst = points.join(line, by).groupBy(*by).agg(F.max(off).alias("max_residual"))
    return line.join(worst, by).select(*by, "points", "slope", "intercept", "max_residual", (F.col("slope") * 3600.0).alias("drift_per_hour"))


def alignment_models(
    anchors: DataFrame,
    by: Sequence[str],
    t: str = "t",
    lag: str = "lag",
    correlation: str = "correlation",
    reliable_at: float = 0.45,
    min_reliable: int = 3,
    max_residual: float = 2.0,
) -> DataFrame:
    """Clock model per key: a line through its reliable anchors, or through all if these are too few.

    ``low_confidence`` marks keys with too few reliable anchors, a median
    correlation below the limit, or a residual over the used anchors above it.
    """
    by = list(by)
    ranked = stage(anchors.select(*by, F.col(t).alias("x"), F.col(lag).alias("y"), F.col(correlation).alias("_c")), "anchors")
    counts = ranked.groupBy(*by).agg(F.count("*").alias("anchors"), F.count_if(F.col("_c") >= reliable_at).alias("reliable_anchors"))
    known = stage(counts.join(quantiles(ranked, by, {"median_correlation": ("_c", 0.5)}), by, "left"), "known")
    used = ranked.join(known.select(*by, "reliable_anchors"), by).filter(
        (F.col("_c") >= reliable_at) | (F.col("reliable_anchors") < min_reliable)
    )
    out = known.join(theil_sen(used, by, "x", "y"), by)
    weak = (F.col("reliable_anchors") < min_reliable) | (F.col("median_correlation") < reliable_at) | (F.col("max_residual") > max_residual)
    return out.withColumn("low_confidence", weak)

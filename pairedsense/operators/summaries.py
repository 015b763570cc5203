"""Summary tables over events, windows, runs and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corroboration_summary(flags: DataFrame) -> DataFrame:
    """Share of corroborated events by type and over all; one pass by grouping sets."""
    flags = flags.select("event_type", "corroborated")
    return flags.rollup("event_type").agg(
        F.grouping("event_type").alias("_g"), F.count("*").alias("events"), F.count_if("corroborated").alias("corroborated")
    ).select(
        F.when(F.col("_g") == 1, "all").otherwise(F.col("event_type")).alias("event_type"),
        "events",
        "corroborated",
        F.try_divide("corroborated", "events").alias("rate"),
    )


def subject_summary(events: DataFrame, windows: DataFrame, common: DataFrame, by: str = "subject_id") -> DataFrame:
    """Per recording: raw, eligible and excluded events, windows by label, fallbacks.

    ``events`` carries ``eligible``; ``windows`` is one row per logical window.
    """
    seen = events.groupBy(by).agg(
        F.count("*").alias("raw_events"),
        F.count_if("eligible").alias("eligible_events"),
        F.count_if(~F.col("eligible")).alias("excluded_outside_common_coverage"),
    )
    made = windows.groupBy(by).agg(
        F.count_if(F.col("label") == 1).alias("positive_logical_windows"),
        F.count_if(F.col("label") == 0).alias("negative_logical_windows"),
        F.count_if("negative_overlap_fallback").alias("negative_overlap_fallbacks"),
    )
    zero = ("raw_events", "eligible_events", "excluded_outside_common_coverage", "positive_logical_windows",
            "negative_logical_windows", "negative_overlap_fallbacks")
    return (
        common.select(by, "common_sec")
        .join(seen, by, "left")
        .join(made, by, "left")
        .select(by, "common_sec", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zero])
    )


def dataset_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("device", "label").agg(
        F.count("*").alias("samples"), F.countDistinct("subject_id").alias("patients")
    )


def timing_summary(df: DataFrame) -> DataFrame:
    """Delay and amplitude distribution per event type, with exact quantiles."""
    from .ranks import quantiles

    means = df.groupBy("event_type").agg(
        F.count("*").alias("n"),
        F.avg("delay_sec").alias("delay_mean"),
        F.avg("amplitude").alias("amplitude_mean"),
        F.avg((F.col("amplitude") >= 3.0).cast("double")).alias("share_ge_3"),
        F.avg(F.col("at_boundary").cast("double")).alias("share_at_boundary"),
    )
    spread = quantiles(
        df,
        ["event_type"],
        {
            "delay_median": ("delay_sec", 0.5),
            "delay_p10": ("delay_sec", 0.1),
            "delay_p90": ("delay_sec", 0.9),
            "delay_p95": ("delay_sec", 0.95),
            "amplitude_median": ("amplitude", 0.5),
            "amplitude_p90": ("amplitude", 0.9),
        },
    )
    return means.join(spread, "event_type")


def protocol_summary(scores: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Fold count, mean and sample deviation of every metric."""
    stats = [F.count("*").alias("folds")]
    for m in metrics:
        stats += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return scores.groupBy(*keys).agg(*stats)


PROTOCOLS = ("R_R", "S_S", "R_S", "S_R")


def device_gap(summary: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Matched against cross-device protocols of one metric; an incomplete set of protocols is dropped."""
    wide = summary.groupBy(*keys).pivot("protocol", list(PROTOCOLS)).agg(F.first(metric))
    complete = wide.na.drop(subset=list(PROTOCOLS))
    rr, ss, rs, sr = (F.col(p) for p in PROTOCOLS)
    matched, cross = (rr + ss) / 2.0, (rs + sr) / 2.0
    return complete.select(
        *keys,
        *[F.col(p).alias(f"{metric}_{p}") for p in PROTOCOLS],
        (rr - rs).alias("gap_r_to_s"),
        (ss - sr).alias("gap_s_to_r"),
        matched.alias("mean_matched"),
        cross.alias("mean_cross_device"),
        (matched - cross).alias("mean_device_gap"),
    )


def confusion_totals(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])


def contribution(scores: DataFrame, full: str, keys: Sequence[str], metric: str) -> DataFrame:
    """Full configuration minus each other one, paired by subject."""
    whole = scores.filter(F.col("representation") == full).select(*keys, F.col(metric).alias("_full"))
    rest = scores.filter(F.col("representation") != full)
    return rest.join(whole, list(keys)).select(
        *keys, F.col("representation").alias("removed"), (F.col("_full") - F.col(metric)).alias("difference")
    )


def contribution_table(scores: DataFrame, full: str, key: str, metrics: Sequence[str]) -> DataFrame:
    """Per removed block and metric: mean loss over the subjects of both, its t interval, and their number."""
    from .stats import t_interval

    long = scores.select(key, "representation", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in metrics])))
    losses = contribution(long, full, [key, "metric"], "score")
    return t_interval(losses, ["removed", "metric"], "difference").select(
        "removed", "metric", F.col("n").alias("subjects"), F.col("mean").alias("difference"), "std", "ci95_low", "ci95_high"
    )


def select_by_validation(runs: DataFrame, key: str, score: str) -> DataFrame:
    """Mean, deviation and count of the validation score, best first."""
    out = runs.groupBy(key).agg(
        F.avg(score).alias("score_mean"), F.stddev_samp(score).alias("score_std"), F.count(score).alias("runs")
    )
    return out.orderBy(F.desc("score_mean"), F.asc("score_std"), F.asc(key))


def cost_table(blocks: DataFrame, latency: DataFrame, quality: DataFrame, key: str) -> DataFrame:
    """Storage of the feature blocks, mean latency and quality of each representation."""
    size = blocks.groupBy(key).agg(F.sum("bytes").alias("cached_bytes"), F.count("*").alias("branches"))
    speed = latency.groupBy(key).agg(F.avg("seconds").alias("latency_mean"))
    return size.join(speed, key).join(quality, key)


def split_counts(manifest: DataFrame, roles: DataFrame, keys: Sequence[str] = ("fold", "protocol", "role")) -> DataFrame:
    """Rows, subjects and class counts of every (fold, protocol, role).

    The manifest is reduced to one row per (subject, device) first, so the
    product with folds and protocols does not grow with the windows.
    """
    small = manifest.groupBy("subject_id", "device").agg(
        F.count("*").alias("_rows"),
        F.count_if(F.col("label") == 1).alias("_pos"),
        F.count_if(F.col("label") == 0).alias("_neg"),
    )
    return small.join(roles, ["subject_id", "device"]).groupBy(*keys).agg(
        F.sum("_rows").alias("rows"),
        F.countDistinct("subject_id").alias("subjects"),
        F.sum("_pos").alias("positives"),
        F.sum("_neg").alias("negatives"),
    )


def split_subjects(manifest: DataFrame, roles: DataFrame, keys: Sequence[str] = ("fold", "protocol", "role")) -> DataFrame:
    """The subjects of every (fold, protocol, role), one row each."""
    small = manifest.select("subject_id", "device").distinct()
    return small.join(roles, ["subject_id", "device"]).select(*keys, "subject_id").distinct()


def fold_counts(manifest: DataFrame, folds: DataFrame) -> DataFrame:
    return manifest.join(folds.select("subject_id", "fold"), "subject_id").groupBy("fold").agg(
        F.countDistinct("subject_id").alias("subjects"),
        F.count("*").alias("rows"),
        F.count_if(F.col("label") == 1).alias("positives"),
    )


def progress(grid: DataFrame, runs: DataFrame, key: str, cell: Sequence[str]) -> DataFrame:
    """Finished against expected cells per experiment."""
    done = runs.select(*cell).distinct().withColumn("_done", F.lit(True))
    return grid.join(done, list(cell), "left").groupBy(key).agg(
        F.count("*").alias("expected"), F.count_if(F.col("_done").isNotNull()).alias("completed")
    )


def mean_vectors(df: DataFrame, by: Sequence[str], outer: str, vector: str) -> DataFrame:
    """Element means per group, then their mean over the groups of ``outer``."""
    inner = df.select(*by, F.posexplode(vector).alias("position", "x")).groupBy(*by, "position").agg(
        F.avg(F.col("x").cast("double")).alias("_m")
    )
    return inner.groupBy(outer, "position").agg(F.avg("_m").alias("mean"), F.count("*").alias("groups"))


def subject_means(df: DataFrame, value: str, by: Sequence[str] = ("subject_id", "device")) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("subject_mean"))


def mean_and_sem(means: DataFrame, by: Sequence[str], value: str = "subject_mean") -> DataFrame:
    return means.groupBy(*by).agg(
        F.count(value).alias("subjects"),
        F.avg(value).alias("mean"),
        F.try_divide(F.stddev_samp(value), F.sqrt(F.count(value))).alias("sem"),
    )


def correlate(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(x, y).alias("pearson"), F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"))


def alignment_summary(df: DataFrame, by: Sequence[str], lag: str = "lag") -> DataFrame:
    """Median and largest lag and the shares within one and five seconds."""
    from .ranks import quantiles

    keys = list(by)
    base = df.groupBy(*keys).agg(
        F.count("*").alias("anchors"),
        F.max(F.abs(lag)).alias("max_abs"),
        F.avg((F.abs(lag) <= 1.0).cast("double")).alias("share_1s"),
        F.avg((F.abs(lag) <= 5.0).cast("double")).alias("share_5s"),
    )
    return base.join(quantiles(df, keys, {"median": (lag, 0.5)}), keys)


def transfer_matrix(summary: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Train device by test device mean score; a missing cell is NULL."""
    parts = F.split("protocol", "_")
    return (
        summary.withColumn("train_device", parts[0])
        .withColumn("_test", parts[1])
        .groupBy(*keys, "train_device")
        .pivot("_test", ["R", "S"])
        .agg(F.avg(metric))
        .withColumnRenamed("R", "test_r")
        .withColumnRenamed("S", "test_s")
    )


def regime(protocol: str | Column) -> Column:
    """matched when train and test device are the same, else cross."""
    parts = F.split(protocol, "_")
    return F.when(parts[0] == parts[1], "matched").otherwise("cross")


def regime_gap(summary: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    same = regime("protocol") == "matched"
    out = summary.groupBy(*keys).agg(
        F.avg(F.when(same, F.col(metric))).alias("matched"), F.avg(F.when(~same, F.col(metric))).alias("cross_device")
    )
    return out.withColumn("gap", F.col("matched") - F.col("cross_device"))


def significance_tally(comparisons: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many comparisons of a regime have an interval that excludes zero, and on which side."""
    above, below = F.col("ci95_low") > 0, F.col("ci95_high") < 0
    return comparisons.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("mean_difference").alias("mean_difference"),
        F.count_if(above | below).alias("excludes_zero"),
        F.count_if(above).alias("positive"),
        F.count_if(below).alias("negative"),
    )


def best_pivot(scores: DataFrame, columns: Sequence[str], k: int = 12) -> DataFrame:
    """Representations in the top k by mean score, against the best score of each experiment."""
    top = scores.groupBy("representation").agg(F.avg("score").alias("_m")).orderBy(F.desc("_m"), "representation").limit(k)
    return (
        scores.join(top.select("representation"), "representation", "left_semi")
        .groupBy("representation")
        .pivot("experiment", list(columns))
        .agg(F.max("score"))
    )


def breakdown_of_best(scores: DataFrame, detail: DataFrame, order: Sequence[Column], keys: Sequence[str]) -> DataFrame:
    """Detail rows of the single best configuration."""
    best = scores.orderBy(*order).limit(1).select(*keys)
    return detail.join(best, list(keys), "left_semi")


def representation_catalog(dimension: DataFrame, sizes: DataFrame) -> DataFrame:
    """Blocks of each representation in order, their number and total length."""
    return (
        dimension.join(sizes, "feature")
        .groupBy("representation")
        .agg(
            F.array_sort(F.collect_list(F.struct("ordinal", "feature"))).alias("_b"),
            F.sum("length").alias("dimension"),
            F.count("*").alias("blocks"),
        )
        .select(
            "representation",
            F.concat_ws("+", F.transform("_b", lambda x: x["feature"])).alias("features"),
            "dimension",
            "blocks",
        )
    )


def base_features(dimension: DataFrame) -> DataFrame:
    """Every feature block that any representation uses, with the number of these."""
    return dimension.groupBy("feature").agg(F.countDistinct("representation").alias("representations"))


def duration_summary(df: DataFrame, value: str = "duration_sec") -> DataFrame:
    from .ranks import quantiles

    ends = df.agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))
    return ends.crossJoin(quantiles(df, [], {"median": (value, 0.5)}))


def flatten_runs(df: DataFrame, structs: Sequence[str] = ("metrics", "runtime", "row_counts")) -> DataFrame:
    """Nested run records as columns, with the best validation score over the tuning candidates."""
    plain = [c for c in df.columns if c not in structs and c != "tuning"]
    present = [f"{s}.*" for s in structs if s in df.columns]
    best = F.array_max(F.transform("tuning", lambda x: x["validation_balanced_accuracy"]))
    return df.select(*plain, *present, best.alias("best_validation_balanced_accuracy"))


def pick_latest(runs: DataFrame, keys: Sequence[str], ts: str, path: str) -> DataFrame:
    """Newest record per key; the first path wins a tie. An aggregate, so partial results meet before the shuffle."""
    newest = F.min_by(
        F.struct(*runs.columns), F.struct((-F.unix_micros(F.col(ts).cast("timestamp"))).alias("age"), F.col(path).alias("path"))
    )
    return runs.groupBy(*keys).agg(newest.alias("_r")).select("_r.*")


def add_ranks(df: DataFrame, by: str, metrics: Sequence[str]) -> DataFrame:
    """Min-rank of each metric inside an experiment, best first, for overall rows only.

    Ranked through one row per (experiment, value): equal values share a rank.
    """
    from .ranks import cumulative

    overall = F.col("scope") == "overall"
    out = df
    for m in metrics:
        order = cumulative(
            df.filter(overall & F.col(m).isNotNull()).select(by, m), [by], m, {"n": F.lit(1).cast("long")}, descending=True
        )
        rank = order.select(by, m, (F.col("n_cum") - F.col("n") + 1).alias("_rank"))
        out = out.join(rank, [by, m], "left").withColumn(f"rank_{m}", F.when(overall, F.col("_rank"))).drop("_rank")
    return out


def best_per_group(df: DataFrame, by: Sequence[str], chain: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Row with the largest metric chain per group; names break ties in rising order."""
    keys = F.struct(*[(-F.coalesce(F.col(m), F.lit(float("-inf")))).alias(f"m{i}") for i, m in enumerate(chain)], *tie)
    return df.groupBy(*by).agg(F.min_by(F.struct(*df.columns), keys).alias("_r")).select("_r.*")


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*")


def nearest_k(df: DataFrame, strata: Sequence[str], value: str, target: float, k: int, tie: str) -> DataFrame:
    """The k rows of each stratum nearest to a target value."""
    from pyspark.sql import Window

    order = Window.partitionBy(*strata).orderBy(F.abs(F.col(value) - target), tie)
    # row_number <= k is limited per task before the shuffle (window group limit).
    return df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k).drop("_rn")


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def errors_first(df: DataFrame, tie: Sequence[str]) -> DataFrame:
    """Predictions with the wrong ones on top."""
    from ..functions.scalars import predict

    return df.withColumn("is_correct", predict("probability") == F.col("label")).orderBy("is_correct", *tie)

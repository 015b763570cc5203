"""Trailing baselines, drops below them, epochs and indices of a sensor series (key, t, v)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import severity_bin
from ..session import stage
from .intervals import DAY, bins_of, mask_points
from .scan import Running, running, time_chunk

MIN_SAMPLES = 10
BLOCK = 1024


def trailing_max(series: DataFrame, by: Sequence[str], seconds: float, pieces: int = 8) -> DataFrame:
    """Add ``baseline``: the largest value in ``[t - seconds, t]``, peers at t included.

    Time is cut into buckets of seconds/pieces. The window of a sample is a
    tail of one bucket, some whole buckets, and a head of its own: the tail and
    head are running maxima inside one bucket (each sample is sent to its own
    bucket and to the one ``pieces`` later), the whole buckets a short frame
    over one row per bucket, in blocks of ``BLOCK`` buckets. Linear in the
    samples, and no task needs more than two buckets of samples or one block of
    bucket rows of a key.
    """
    by = list(by)
    width = float(seconds) / pieces
    own = series.withColumn("_k", time_chunk("t", width))
    row = F.struct(*series.columns)
    near = own.select(*by, "_k", F.col("t").alias("_pos"), F.lit(0).alias("_halo"), F.col("v").alias("_v"), row.alias("_row"))
    far = own.select(
        *by,
        (F.col("_k") + pieces).alias("_k"),
        (F.col("t") + float(seconds)).alias("_pos"),
        F.lit(1).alias("_halo"),
        F.col("v").alias("_v"),
        F.lit(None).cast(series.select(row).schema[0].dataType).alias("_row"),
    )
    cell = Window.partitionBy(*by, "_k")
    head = cell.orderBy("_pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tail = cell.orderBy(F.col("_pos").desc(), F.col("_halo").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = near.unionByName(far).select(
        *by,
        "_k",
        "_halo",
        "_row",
        F.max(F.when(F.col("_halo") == 0, F.col("_v"))).over(head).alias("_head"),
        F.max(F.when(F.col("_halo") == 1, F.col("_v"))).over(tail).alias("_tail"),
    )
    whole = own.groupBy(*by, "_k").agg(F.max("v").alias("_m"))
    # Bucket rows in blocks; the last ones of a block are sent to the next block too, where its first ones look back at them.
    block = lambda k: F.floor(k / F.lit(BLOCK)).cast("long")
    sent = whole.withColumn("_block", F.explode(F.sequence(block(F.col("_k")), block(F.col("_k") + pieces - 1))))
    back = Window.partitionBy(*by, "_block").orderBy("_k").rangeBetween(-(pieces - 1), -1)
    middle = sent.withColumn("_middle", F.max("_m").over(back)).filter(F.col("_block") == block(F.col("_k"))).select(*by, "_k", "_middle")
    return (
        local.filter(F.col("_halo") == 0)
        .join(middle, [*by, "_k"])
        .select("_row.*", F.greatest("_head", "_tail", "_middle").alias("baseline"))
    )


def detect_runs(
    series: DataFrame,
    by: Sequence[str],
    drop: float = 3.0,
    min_duration: float = 8.0,
    window: float = 100.0,
    pieces: int = 8,
    chunk_seconds: float | None = None,
) -> DataFrame:
    """Maximal runs of consecutive unmasked samples at least ``drop`` below the trailing baseline.

    ``series`` carries ``masked``. One row per run that lasts at least
    ``min_duration`` seconds, with its largest drop and trapezoid area; keys
    with fewer than ten samples give none.
    """
    by = list(by)
    chunk_seconds = chunk_seconds or window
    # The masked series feeds four branches: written once, read back with the columns each needs.
    series = stage(series.select(*by, "t", "v", "masked"), "masked")
    based = trailing_max(series, by, window, pieces)
    deficit = F.col("baseline") - F.col("v")
    staged = based.select(
        *by,
        "t",
        deficit.alias("_d"),
        ((deficit >= drop) & ~F.col("masked")).alias("_hit"),
        time_chunk("t", chunk_seconds).alias("_chunk"),
    )
    # All hits between two misses see the same number of misses: that number names the run.
    scanned = running(
        staged,
        by,
        "_chunk",
        {
            "_run": Running("sum", F.when(F.col("_hit"), 0).otherwise(1).cast("long"), ("t",)),
            "_before": Running("last", F.struct("t", "_d", "_hit"), ("t",), inclusive=False),
        },
    )
    piece = F.when(
        F.col("_before._hit"), (F.col("_d") + F.col("_before._d")) / 2.0 * (F.col("t") - F.col("_before.t"))
    ).otherwise(0.0)
    runs = (
        scanned.filter("_hit")
        .groupBy(*by, "_run")
        .agg(
            F.min("t").alias("start"),
            F.max("t").alias("end"),
            F.max("_d").alias("max_drop"),
            F.sum(piece).alias("area"),
        )
        .filter(F.col("end") - F.col("start") >= min_duration)
    )
    enough = series.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") >= MIN_SAMPLES)
    found = runs.join(enough, by, "left_semi").select(
        *by, "start", "end", (F.col("end") - F.col("start")).alias("duration"), "max_drop", "area"
    )
    return stage(found, "runs")


def event_burden(runs: DataFrame, masked: DataFrame, by: Sequence[str]) -> DataFrame:
    """Runs and area minutes per unmasked hour; keys without unmasked time or with few samples are dropped."""
    by = list(by)
    counted = runs.groupBy(*by).agg(F.count("*").alias("runs"), F.sum("area").alias("area"))
    hours = (F.col("hi") - F.col("lo")) / 3600.0 - F.col("masked_sec") / 3600.0
    return (
        masked.filter(F.col("samples") >= MIN_SAMPLES)
        .select(*by, hours.alias("unmasked_hours"))
        .filter(F.col("unmasked_hours") > 0)
        .join(counted, by, "left")
        .select(
            *by,
            (F.coalesce("runs", F.lit(0)) / F.col("unmasked_hours")).alias("event_index"),
            (F.coalesce("area", F.lit(0.0)) / 60.0 / F.col("unmasked_hours")).alias("burden"),
            "unmasked_hours",
        )
    )


def epoch_targets(
    series: DataFrame, runs: DataFrame, by: Sequence[str], epoch_sec: float = 300.0, max_masked: float = 0.5
) -> DataFrame:
    """Tumbling epochs from 0 to the last sample: run count, area, masked share, hourly rates, severity."""
    by = list(by)
    span = (
        series.groupBy(*by)
        .agg(F.max("t").alias("_end"), F.count("*").alias("_n"))
        .filter((F.col("_n") >= MIN_SAMPLES) & (F.col("_end") > 0))
        .select(*by, "_end", F.ceil(F.col("_end") / epoch_sec).cast("long").alias("_epochs"))
    )
    grid = span.select(*by, "_end", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_epochs") - 1)).alias("epoch"))

    def to_epoch(df: DataFrame, t: str) -> DataFrame:
        # Samples before the origin have no epoch; what starts at the very end belongs to the last one.
        return df.filter(F.col(t) >= 0).join(span.select(*by, "_epochs"), by).withColumn(
            "epoch", F.least(F.floor(F.col(t) / epoch_sec).cast("long"), F.col("_epochs") - 1)
        )

    hits = to_epoch(runs, "start").groupBy(*by, "epoch").agg(F.count("*").alias("_c"), F.sum("area").alias("_a"))
    share = to_epoch(series, "t").groupBy(*by, "epoch").agg(F.avg(F.col("masked").cast("double")).alias("_m"))
    begin = F.col("epoch") * epoch_sec
    finish = F.least((F.col("epoch") + 1) * epoch_sec, F.col("_end"))
    scale = F.lit(3600.0) / (F.col("epoch_end_sec") - F.col("epoch_start_sec"))
    return (
        grid.join(hits, [*by, "epoch"], "left")
        .join(share, [*by, "epoch"], "left")
        .select(
            *by,
            begin.alias("epoch_start_sec"),
            finish.alias("epoch_end_sec"),
            F.coalesce("_c", F.lit(0)).alias("run_count"),
            F.coalesce("_a", F.lit(0.0)).alias("_area"),
            F.coalesce("_m", F.lit(1.0)).alias("masked_fraction"),
        )
        .filter(F.col("epoch_end_sec") > F.col("epoch_start_sec"))
        .select(
            *by,
            "epoch_start_sec",
            "epoch_end_sec",
            (F.col("epoch_end_sec") - F.col("epoch_start_sec")).alias("epoch_duration_sec"),
            "run_count",
            (F.col("_area") / 60.0).alias("area_min"),
            (F.col("run_count") * scale).alias("hourly_rate"),
            (F.col("_area") / 60.0 * scale).alias("hourly_burden"),
            severity_bin(F.col("run_count") * scale).alias("severity_bin"),
            "masked_fraction",
            (F.col("masked_fraction") >= max_masked).alias("excluded_from_training"),
        )
    )


def event_nadir(
    events: DataFrame,
    series: DataFrame,
    by: Sequence[str],
    pre: float = 100.0,
    post: float = 150.0,
    min_pre: int = 10,
    min_post: int = 5,
) -> DataFrame:
    """Lowest value after each event end against the highest before it.

    The boundary flag says that the lowest value is the last one searched.
    """
    by = list(by)
    width = max(pre, post)
    spans = events.select(
        *by, "event_id", "event_type", F.col("end").alias("_e"), F.explode(bins_of(F.col("end") - pre, F.col("end") + post, width)).alias("_bin")
    )
    samples = series.select(*by, "t", "v", time_chunk("t", width).alias("_bin"))
    near = spans.join(samples, [*by, "_bin"]).filter(
        (F.col("t") >= F.col("_e") - pre) & (F.col("t") < F.col("_e") + post)
    )
    earlier, later = F.col("t") < F.col("_e"), F.col("t") >= F.col("_e")
    out = near.groupBy(*by, "event_id", "event_type", "_e").agg(
        F.max(F.when(earlier, F.col("v"))).alias("baseline"),
        F.count_if(earlier).alias("_n_pre"),
        F.min(F.when(later, F.struct("v", "t"))).alias("_low"),
        F.max(F.when(later, F.col("t"))).alias("_last"),
        F.count_if(later).alias("_n_post"),
    )
    return out.filter((F.col("_n_pre") >= min_pre) & (F.col("_n_post") >= min_post)).select(
        *by,
        "event_id",
        "event_type",
        "baseline",
        F.col("_low.v").alias("nadir"),
        (F.col("_low.t") - F.col("_e")).alias("delay_sec"),
        (F.col("baseline") - F.col("_low.v")).alias("amplitude"),
        (F.col("_low.t") == F.col("_last")).alias("at_boundary"),
    )


def views(
    series: DataFrame,
    merged: DataFrame,
    requests: DataFrame,
    by: str,
    buffer: float = 150.0,
    bin_seconds: float = DAY,
    **detect,
) -> tuple[DataFrame, DataFrame]:
    """(samples, runs) of many requested stretches ``(view_id, key, lo, hi)``, each detected on its own with a buffer."""
    spans = requests.select(
        by,
        "view_id",
        F.col("lo").alias("_lo"),
        F.col("hi").alias("_hi"),
        F.explode(bins_of(F.col("lo") - buffer, F.col("hi") + buffer, bin_seconds)).alias("_bin"),
    )
    masked = mask_points(series, merged, [by], "t", bin_seconds)
    wide = (
        masked.withColumn("_bin", time_chunk("t", bin_seconds))
        .join(spans, [by, "_bin"])
        .filter((F.col("t") >= F.col("_lo") - buffer) & (F.col("t") <= F.col("_hi") + buffer))
        .select("view_id", by, "t", "v", "masked", "_lo", "_hi")
    )
    samples = wide.filter((F.col("t") >= F.col("_lo")) & (F.col("t") <= F.col("_hi"))).select("view_id", by, "t", "v")
    runs = detect_runs(wide.select("view_id", by, "t", "v", "masked"), ["view_id", by], **detect)
    shown = runs.join(requests.select("view_id", "lo", "hi"), "view_id").filter(
        (F.col("start") <= F.col("hi")) & (F.col("end") >= F.col("lo"))
    )
    return samples, shown.drop("lo", "hi")

"""Interval, nearest, containment and piecewise-linear joins of one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .intervals import DAY, bins_of
from .scan import neighbours, time_chunk


def _binned(df: DataFrame, start: Column, end: Column, width: float) -> DataFrame:
    return df.withColumn("_first", time_chunk(start, width)).withColumn("_bin", F.explode(bins_of(start, end, width)))


def _touch(lag: float) -> Column:
    return (F.col("l.start") <= F.col("r.end") + lag) & (F.col("l.end") >= F.col("r.start"))


def _keys(by: Sequence[str]) -> Column:
    cond = F.col("l._bin") == F.col("r._bin")
    for k in by:
        cond = cond & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return cond


def interval_join(left: DataFrame, right: DataFrame, by: Sequence[str], lag: float = 0.0, bin_seconds: float = DAY) -> DataFrame:
    """Pairs with ``left.start <= right.end + lag`` and ``left.end >= right.start``; right columns get ``r_``.

    Joined on (key, time bin). A pair that shares several bins is emitted in the
    first of them only, so no duplicate removal is needed.
    """
    lb = _binned(left, F.col("start"), F.col("end"), bin_seconds)
    rb = _binned(right, F.col("start"), F.col("end") + lag, bin_seconds)
    once = F.col("l._bin") == F.greatest("l._first", "r._first")
    joined = lb.alias("l").join(rb.alias("r"), _keys(by) & _touch(lag) & once)
    return joined.select(
        *[F.col(f"l.{c}") for c in left.columns],
        *[F.col(f"r.{c}").alias(f"r_{c}") for c in right.columns if c not in by],
    )


def touching(
    left: DataFrame, right: DataFrame, by: Sequence[str], lag: float = 0.0, bin_seconds: float = DAY, reverse: bool = False
) -> DataFrame:
    """Left rows that meet some right row; with ``reverse`` the slack is on the left side."""
    cond = (
        (F.col("r.start") <= F.col("l.end") + lag) & (F.col("r.end") >= F.col("l.start")) if reverse else _touch(lag)
    )
    lb = _binned(left, F.col("start"), F.col("end") + (lag if reverse else 0.0), bin_seconds)
    rb = _binned(right, F.col("start"), F.col("end") + (0.0 if reverse else lag), bin_seconds)
    hit = lb.alias("l").join(rb.alias("r"), _keys(by) & cond, "left_semi")
    return hit.select(*[F.col(f"l.{c}") for c in left.columns]).distinct()


def unmatched(detections: DataFrame, events: DataFrame, by: Sequence[str], lag: float, bin_seconds: float = DAY) -> DataFrame:
    """Detections that meet no event (theta anti join)."""
    keys = [*by, "start", "end"]
    met = touching(detections.select(*keys), events, by, lag, bin_seconds)
    return detections.join(met, keys, "left_anti")


def flag_corroborated(
    events: DataFrame, detections: DataFrame, by: Sequence[str], lag: float, event_key: str = "event_id", bin_seconds: float = DAY
) -> DataFrame:
    """Add ``corroborated`` to every event."""
    met = (
        touching(events.select(*by, event_key, "start", "end"), detections, by, lag, bin_seconds, reverse=True)
        .select(*by, event_key)
        .withColumn("_met", F.lit(True))
    )
    return events.join(met, [*by, event_key], "left").select(
        *events.columns, F.coalesce("_met", F.lit(False)).alias("corroborated")
    )


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_t: str,
    right_t: str,
    right_seq: str,
    payload: Sequence[str],
    tolerance: float = 3.0,
    chunk_seconds: float = DAY,
) -> DataFrame:
    """The right row nearest in time to every left row, strictly within the tolerance; ties go to the earlier one.

    Two neighbours per left row come out of one ordered scan, so dense
    neighbourhoods do not multiply rows.
    """
    both = neighbours(left, right, by, left_t, right_t, right_seq, payload, chunk_seconds)
    t = F.col(left_t).cast("double")
    back, ahead = t - F.col("prev.t"), F.col("next.t") - t
    use_prev = F.col("prev").isNotNull() & (F.col("next").isNull() | (back <= ahead))
    pick = F.when(use_prev, F.col("prev")).otherwise(F.col("next"))
    return (
        both.withColumn("match", pick)
        .withColumn("distance", F.abs(F.col("match.t") - t))
        .filter(F.col("distance") < tolerance)
        .select(*left.columns, "match", "distance")
    )


def propagate_flag(manifest: DataFrame, flags: DataFrame, flag: str) -> DataFrame:
    """Give every device row of a logical window its flag; negatives and unmatched windows hold true."""
    return manifest.join(flags.select("logical_window_id", F.col(flag).alias("_f")), "logical_window_id", "left").select(
        *manifest.columns,
        F.when(F.col("label") == 0, F.lit(True)).otherwise(F.coalesce("_f", F.lit(True))).alias(flag),
    )


def segment_anchors(
    anchors: DataFrame,
    durations: DataFrame,
    by: str,
    max_gap: float = 1800.0,
    max_jump: float = 5.0,
    pad: float = 450.0,
    chunk_seconds: float = DAY,
) -> DataFrame:
    """Stretches of anchors without a long gap or a lag jump.

    The first and last stretch of a recording reach ``pad`` seconds further,
    clipped to it. One row per stretch: segment_start, segment_end, lower, upper
    and the number of its anchors.
    """
    from .scan import Running, running

    staged = anchors.select(by, "t", "lag").withColumn("_chunk", time_chunk("t", chunk_seconds))
    prev = running(staged, [by], "_chunk", {"_p": Running("last", F.struct("t", "lag"), ("t",), inclusive=False)})
    opens = (
        F.col("_p").isNull()
        | (F.col("t") - F.col("_p.t") > max_gap)
        | (F.abs(F.col("lag") - F.col("_p.lag")) > max_jump)
    )
    named = running(
        prev.withColumn("_first", F.when(opens, F.col("t"))), [by], "_chunk", {"segment_start": Running("last", F.col("_first"), ("t",))}
    )
    parts = named.groupBy(by, "segment_start").agg(F.max("t").alias("segment_end"), F.count("*").alias("anchors"))
    ends = anchors.groupBy(by).agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    out = parts.join(ends, by).join(durations, by)
    lower = F.when(F.col("segment_start") == F.col("_lo"), F.greatest(F.lit(0.0), F.col("segment_start") - pad)).otherwise(F.col("segment_start"))
    upper = F.when(F.col("segment_end") == F.col("_hi"), F.least(F.col("duration"), F.col("segment_end") + pad)).otherwise(F.col("segment_end"))
    return (
        out.select(by, "segment_start", "segment_end", "anchors", lower.alias("lower"), upper.alias("upper"))
        .filter(F.col("upper") > F.col("lower"))
    )


def assign_segment(windows: DataFrame, segments: DataFrame, by: str, bin_seconds: float = DAY) -> DataFrame:
    """Windows that lie inside a stretch, with the first such stretch; the others are left out."""
    spans = segments.select(
        by, "segment_start", "segment_end", "lower", "upper", F.explode(bins_of(F.col("lower"), F.col("upper"), bin_seconds)).alias("_bin")
    )
    # Equal windows are windows of their own, so each gets a number; written once, so that a retried task sees the same.
    own = stage(windows.withColumn("_row", F.monotonically_increasing_id()), "windows")
    at = own.withColumn("_bin", time_chunk("start_sec", bin_seconds))
    joined = at.join(spans, [by, "_bin"]).filter((F.col("start_sec") >= F.col("lower")) & (F.col("end_sec") <= F.col("upper")))
    first = F.min(F.struct("segment_start", "segment_end", "lower", "upper")).alias("_s")
    found = joined.groupBy("_row").agg(first)
    return own.join(found, "_row").select(*windows.columns, "_s.*")


def drop_incomplete(rows: DataFrame, kept: DataFrame, key: str = "logical_window_id") -> DataFrame:
    """Rows of ``kept`` whose logical window lost no device row against ``rows``."""
    lost = rows.select(key, "device").join(kept.select(key, "device"), [key, "device"], "left_anti").select(key).distinct()
    return kept.join(lost, key, "left_anti")


def interpolate(
    points: DataFrame, anchors: DataFrame, by: Sequence[str], t: str, value: str, name: str, chunk_seconds: float = DAY
) -> DataFrame:
    """Piecewise-linear lookup of ``value`` at ``t``, held constant outside the anchors.

    Points of a key without anchors get NULL.
    """
    seq = anchors.withColumn("_seq", F.lit(0))
    both = neighbours(points, seq, by, t, "t", "_seq", [value], chunk_seconds)
    x = F.col(t).cast("double")
    t0, v0, t1, v1 = F.col("prev.t"), F.col(f"prev.{value}"), F.col("next.t"), F.col(f"next.{value}")
    line = v0 + (v1 - v0) * ((x - t0) / (t1 - t0))
    out = (
        F.when(F.col("prev").isNull(), v1)
        .when(F.col("next").isNull() | (t0 == x), v0)
        .otherwise(line)
    )
    return both.select(*points.columns, out.alias(name))


def interpolate_both(
    rows: DataFrame, anchors: DataFrame, by: Sequence[str], first: tuple[str, str], second: tuple[str, str], value: str, chunk_seconds: float = DAY
) -> DataFrame:
    """``interpolate`` at two columns of a row in one scan: (time column, output name) each. Output names may not be columns."""
    numbered = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    side = F.inline(F.array(*[F.struct(F.lit(i).alias("_side"), F.col(t).cast("double").alias("_t")) for i, (t, _) in enumerate((first, second))]))
    points = numbered.select(*by, "_row", side)
    found = interpolate(points, anchors, by, "_t", value, "_v", chunk_seconds)
    pairs = found.groupBy("_row").agg(*[F.max(F.when(F.col("_side") == i, F.col("_v"))).alias(name) for i, (_, name) in enumerate((first, second))])
    return numbered.join(pairs, "_row").drop("_row")


def aligned_windows(
    windows: DataFrame,
    segments: DataFrame,
    anchors: DataFrame,
    durations: DataFrame,
    by: str,
    chunk_seconds: float = DAY,
) -> DataFrame:
    """Map recorder windows onto the recorder clock by the anchors of their stretch.

    Phone rows keep their clock. A window outside every stretch, or leaving the
    recording after mapping, loses both device rows.
    """
    placed = assign_segment(windows, segments, by, chunk_seconds)
    # An anchor meets the stretches of its time bin, not all of its key.
    reach = bins_of(F.col("segment_start"), F.col("segment_end"), chunk_seconds)
    spans = segments.select(by, "segment_start", "segment_end", F.explode(reach).alias("_bin"))
    inside = anchors.withColumn("_bin", time_chunk("t", chunk_seconds)).join(spans, [by, "_bin"]).filter(
        (F.col("t") >= F.col("segment_start")) & (F.col("t") <= F.col("segment_end"))
    )
    keyed = inside.select(by, "segment_start", "t", "lag")
    keys = [by, "segment_start"]
    both = interpolate_both(placed, keyed, keys, ("start_sec", "_l0"), ("end_sec", "_l1"), "lag", chunk_seconds)
    is_r = F.col("device") == "R"
    off0 = F.when(is_r, F.col("_l0")).otherwise(F.lit(0.0))
    off1 = F.when(is_r, F.col("_l1")).otherwise(F.lit(0.0))
    mapped = both.join(durations.select(by, F.col("duration").alias("_dur")), by).select(
        *[c for c in windows.columns if c not in ("start_sec", "end_sec")],
        F.col("start_sec").alias("reference_start_sec"),
        F.col("end_sec").alias("reference_end_sec"),
        (F.col("start_sec") + off0).alias("start_sec"),
        (F.col("end_sec") + off1).alias("end_sec"),
        off0.alias("device_time_offset_start_sec"),
        off1.alias("device_time_offset_end_sec"),
        "_dur",
    )
    if "duration_sec" in windows.columns:
        mapped = mapped.withColumn("duration_sec", F.col("end_sec") - F.col("start_sec"))
    stays = (F.col("device") != "R") | (
        (F.col("start_sec") >= 0) & (F.col("end_sec") <= F.col("_dur")) & (F.col("end_sec") > F.col("start_sec"))
    )
    return drop_incomplete(windows, mapped.filter(stays).drop("_dur"))


def pair_devices(manifest: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Exactly one R and one S row per logical window, as one wide row with the alignment error in ms."""
    def side(device: str) -> Column:
        return F.max(F.when(F.col("device") == device, F.struct("sample_id", "start_sec", "end_sec", "offset")))

    wide = manifest.groupBy("logical_window_id", *keep).agg(
        side("R").alias("r"),
        side("S").alias("s"),
        F.count_if(F.col("device") == "R").alias("_nr"),
        F.count_if(F.col("device") == "S").alias("_ns"),
        F.count("*").alias("_n"),
    )
    return wide.filter((F.col("_nr") == 1) & (F.col("_ns") == 1) & (F.col("_n") == 2)).select(
        "logical_window_id",
        *keep,
        F.col("r.sample_id").alias("r_sample_id"),
        F.col("s.sample_id").alias("s_sample_id"),
        F.col("r.start_sec").alias("r_start_sec"),
        F.col("s.start_sec").alias("s_start_sec"),
        F.col("r.end_sec").alias("r_end_sec"),
        F.col("s.end_sec").alias("s_end_sec"),
        (F.abs(F.col("r.offset") - F.col("s.offset")) * 1000.0).alias("alignment_error_ms"),
    )


def epoch_manifest(epochs: DataFrame, templates: DataFrame, by: str) -> DataFrame:
    """Epoch windows for every device recording of the subject that reaches their end."""
    start = F.floor("epoch_start_sec").cast("long").cast("string")
    return (
        epochs.join(templates, by)
        .filter(F.col("epoch_end_sec") <= F.col("available_sec"))
        .select(
            F.concat_ws("_", F.lit("SW"), F.col(by).cast("string"), "device", start).alias("sample_id"),
            F.concat_ws("_", F.lit("SW"), F.col(by).cast("string"), start).alias("logical_window_id"),
            *epochs.columns,
            "device",
        )
    )


def attach_required(left: DataFrame, right: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """Inner join by key in which a left row without a partner fails the query."""
    keys = list(keys)
    found = left.join(right.withColumn("_found", F.lit(True)), keys, "left")
    text = F.concat(F.lit(f"no {what} for "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    check = F.when(F.col("_found").isNull(), F.raise_error(text).cast("boolean")).otherwise(F.col("_found"))
    return found.withColumn("_found", check).filter("_found").drop("_found")


def align_predictions(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Paired predictions; a row of either side without its partner fails the query."""
    keys = list(keys)
    left = a.select(*keys, F.col("probability").alias("probability_a"))
    right = b.select(*keys, F.col("probability").alias("probability_b"))
    both = left.join(right, keys, "full")
    lost = F.col("probability_a").isNull() | F.col("probability_b").isNull()
    check = F.when(lost, F.raise_error(F.lit("prediction sets do not align")).cast("boolean")).otherwise(F.lit(True))
    return both.withColumn("_ok", check).filter("_ok").drop("_ok")


def alignment_report(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of matched and one-sided rows instead of a failure."""
    keys = list(keys)
    both = a.select(*keys).withColumn("_a", F.lit(1)).join(b.select(*keys).withColumn("_b", F.lit(1)), keys, "full")
    return both.agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("matched"),
        F.count_if(F.col("_b").isNull()).alias("only_left"),
        F.count_if(F.col("_a").isNull()).alias("only_right"),
    )


def pending(grid: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid cells without finished work."""
    return grid.join(done.select(*keys).distinct(), list(keys), "left_anti")


def exclude_seen(target: DataFrame, source: DataFrame, key: str = "patient_id") -> DataFrame:
    """Target rows of patients that do not occur in the source."""
    return target.join(source.select(key).distinct(), key, "left_anti")


def grid(*dimensions: DataFrame) -> DataFrame:
    """Experiment grid: every combination of the dimension tables, which is what a grid is."""
    out = dimensions[0]
    for dim in dimensions[1:]:
        out = out.crossJoin(dim)
    return out


def with_ci(summary: DataFrame, ci: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Attach ``<metric>_<statistic>`` columns of a long interval table."""
    wide = ci.groupBy(key).pivot("metric", list(metrics)).agg(
        F.first("subject_mean").alias("subject_mean"), F.first("ci95_low").alias("ci95_low"), F.first("ci95_high").alias("ci95_high")
    )
    return summary.join(wide, key, "left")

"""Interval algebra on (key, start, end) rows, in seconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import overlaps
from .scan import Running, running, time_chunk

DAY = 86400.0


def _as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(float(value))


def merge_intervals(df: DataFrame, by: Sequence[str], lo=None, hi=None, chunk_seconds: float = DAY) -> DataFrame:
    """Clip to ``[lo, hi]``, drop empties, merge overlapping and touching intervals.

    An interval without key, start or end covers nothing of any key, like an empty one.
    """
    by = list(by)
    df = df.dropna(subset=by)
    start = F.greatest("start", _as_col(lo)) if lo is not None else F.col("start")
    end = F.least("end", _as_col(hi)) if hi is not None else F.col("end")
    clipped = (
        df.select(*by, start.alias("start"), end.alias("end"))
        .filter(F.col("end") > F.col("start"))
        .withColumn("_chunk", time_chunk("start", chunk_seconds))
    )
    reach = running(
        clipped, by, "_chunk", {"_reach": Running("max", F.col("end"), ("start", "end"), inclusive=False)}
    )
    opens = F.col("_reach").isNull() | (F.col("start") > F.col("_reach"))
    marked = running(
        reach.withColumn("_first", F.when(opens, F.col("start"))),
        by,
        "_chunk",
        {"_island": Running("last", F.col("_first"), ("start", "end"))},
    )
    return marked.groupBy(*by, "_island").agg(F.max("end").alias("end")).select(
        *by, F.col("_island").alias("start"), "end"
    )


def complement_intervals(df: DataFrame, bounds: DataFrame, by: Sequence[str], chunk_seconds: float = DAY) -> DataFrame:
    """Free stretches of ``[lo, hi]`` per key of ``bounds`` (key, lo, hi); a key without intervals is free throughout."""
    by = list(by)
    merged = merge_intervals(df.join(bounds, by), by, "lo", "hi", chunk_seconds)
    # Both ends of the range enter as empty markers: the first and last gap, and the
    # single gap of a key without intervals, fall out of the same scan.
    ends = bounds.filter(F.col("hi") > F.col("lo")).select(*by, F.explode(F.array("lo", "hi")).alias("start"))
    steps = merged.unionByName(ends.withColumn("end", F.col("start"))).withColumn("_chunk", time_chunk("start", chunk_seconds))
    seen = running(steps, by, "_chunk", {"_prev": Running("max", F.col("end"), ("start", "end"), inclusive=False)})
    return seen.filter(F.col("start") > F.col("_prev")).select(*by, F.col("_prev").alias("start"), F.col("start").alias("end"))


def bins_of(start: Column, end: Column, width: float) -> Column:
    """All time bins an interval touches."""
    return F.sequence(time_chunk(start, width), time_chunk(F.greatest(start, end), width))


def mask_points(points: DataFrame, merged: DataFrame, by: Sequence[str], t: str = "t", bin_seconds: float = DAY) -> DataFrame:
    """Add ``masked``: the point lies in one of the merged intervals, ends included.

    Joined on (key, time bin), so a hot key is spread over its bins; merged
    intervals never share a point, so no row is multiplied.
    """
    by = list(by)
    spans = merged.select(
        *by, F.col("start").alias("_s"), F.col("end").alias("_e"), F.explode(bins_of(F.col("start"), F.col("end"), bin_seconds)).alias("_bin")
    )
    at = points.withColumn("_bin", time_chunk(t, bin_seconds))
    hit = (F.col(f"p.{t}") >= F.col("i._s")) & (F.col(f"p.{t}") <= F.col("i._e"))
    keys = [F.col(f"p.{k}") == F.col(f"i.{k}") for k in [*by, "_bin"]]
    cond = hit
    for k in keys:
        cond = cond & k
    return at.alias("p").join(spans.alias("i"), cond, "left").select(
        *[F.col(f"p.{c}") for c in points.columns], F.col("i._s").isNotNull().alias("masked")
    )


def masked_seconds(
    series: DataFrame, intervals: DataFrame, by: Sequence[str], merge: bool = True, chunk_seconds: float = DAY
) -> DataFrame:
    """Seconds of the series span (first to last sample) that the intervals cover."""
    by = list(by)
    span = series.groupBy(*by).agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("samples"))
    inner = intervals.join(span.select(*by, "lo", "hi"), by)
    if merge:
        pieces = merge_intervals(inner, by, "lo", "hi", chunk_seconds)
    else:
        pieces = inner.filter(
            (F.col("end") > F.col("lo")) & (F.col("start") < F.col("hi")) & (F.col("end") > F.col("start"))
        ).select(*by, F.greatest("start", "lo").alias("start"), F.least("end", "hi").alias("end"))
    covered = pieces.groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias("masked_sec"))
    return span.join(covered, by, "left").select(
        *by, "samples", "lo", "hi", F.coalesce("masked_sec", F.lit(0.0)).alias("masked_sec")
    )


def overlap_earlier(df: DataFrame, by: Sequence[str], seq: str, bin_seconds: float = DAY, tol: float = 1e-9) -> DataFrame:
    """Rows that overlap a row of the same key with a lower sequence number: adds ``overlaps_earlier``."""
    by = list(by)
    binned = df.withColumn("_bin", F.explode(bins_of(F.col("start"), F.col("end"), bin_seconds)))
    cond = (F.col(f"b.{seq}") < F.col(f"a.{seq}")) & overlaps("a.start", "a.end", "b.start", "b.end", tol)
    for k in [*by, "_bin"]:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    hit = (
        binned.alias("a")
        .join(binned.select(*by, "_bin", "start", "end", seq).alias("b"), cond, "left_semi")
        .select(*by, seq)
        .distinct()
        .withColumn("overlaps_earlier", F.lit(True))
    )
    return df.join(hit, [*by, seq], "left").withColumn(
        "overlaps_earlier", F.coalesce("overlaps_earlier", F.lit(False))
    )

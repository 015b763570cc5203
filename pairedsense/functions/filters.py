"""Row filters on event windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def covered(hi: Column | str, start: str = "start", end: str = "end") -> Column:
    """Inside [0, hi] with positive length."""
    hi = F.col(hi) if isinstance(hi, str) else hi
    return (F.col(start) >= 0) & (F.col(end) <= hi) & (F.col(end) > F.col(start))


def filter_coverage(df: DataFrame, hi: Column | str) -> DataFrame:
    return df.filter(covered(hi))


def coverage_counts(df: DataFrame, hi: Column | str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(covered(hi)).alias("kept"), F.count_if(~covered(hi)).alias("excluded"))


def filter_stage(df: DataFrame, stage: str = "W") -> DataFrame:
    return df.filter(F.coalesce("sleep_stage", F.lit("")) != stage)

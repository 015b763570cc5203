"""Ordering, union, set and duplicate operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered(df: DataFrame, spec: Sequence[tuple[str, str]]) -> DataFrame:
    """Total order over several columns, each ``asc`` or ``desc``; nulls last in both."""
    return df.orderBy(*[F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last() for c, way in spec])


def union_families(families: dict[str, DataFrame]) -> DataFrame:
    """Stack tables by name with their family; a column one of them lacks is NULL there."""
    tagged = [df.withColumn("family", F.lit(name)) for name, df in families.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, distinct, with their side."""
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def duplicates(df: DataFrame, keys: Sequence[str], name: str = "copies") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name)).filter(F.col(name) > 1)


def common_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def role_sets_check(roles: dict[str, DataFrame], everyone: DataFrame, key: str) -> DataFrame:
    """Two check rows: no key has two roles, and the roles cover every key."""
    tagged = union_families({r: df.select(key).distinct() for r, df in roles.items()})
    shared = tagged.groupBy(key).agg(F.countDistinct("family").alias("_n")).filter(F.col("_n") > 1)
    missing = everyone.select(key).distinct().join(tagged.select(key).distinct(), key, "left_anti")

    def row(df: DataFrame, text: str) -> DataFrame:
        return df.agg(F.count("*").alias("violations")).select(
            F.lit(text).alias("check"), (F.col("violations") == 0).alias("passed"), "violations", F.lit(key).alias("detail")
        )

    return row(shared, "roles are disjoint").unionByName(row(missing, "roles cover all"))

"""The scalar functions as SQL functions of the session (inlined by the optimizer)."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Bodies are SQL expressions, so a call costs the same as the built-in functions it stands for.
DEFINITIONS = {
    "clock_to_seconds": (
        "clock STRING",
        "DOUBLE",
        "cast(split(clock, ':')[0] AS DOUBLE) * 3600 + cast(split(clock, ':')[1] AS DOUBLE) * 60"
        " + cast(split(clock, ':')[2] AS DOUBLE) + if(cast(split(clock, ':')[0] AS DOUBLE) < 12, 86400D, 0D)",
    ),
    "stable_id": ("parts ARRAY<STRING>", "STRING", "substr(sha1(array_join(parts, '|')), 1, 16)"),
    "severity_bin": (
        "rate DOUBLE",
        "STRING",
        "CASE WHEN rate < 5 THEN 'normal' WHEN rate < 15 THEN 'mild' WHEN rate < 30 THEN 'moderate' ELSE 'severe' END",
    ),
    "sigmoid_clip": ("score DOUBLE", "DOUBLE", "1D / (1D + exp(-greatest(least(score, 30D), -30D)))"),
}


def register(spark: SparkSession) -> None:
    for name, (parameter, result, body) in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameter}) RETURNS {result} RETURN {body}")

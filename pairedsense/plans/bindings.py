"""The given tables read as recordings, annotations, predictions, runs and vectors.

Each binding has a twin in ``oracle_ctes`` written in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN = "2024-01-01 00:00:00"
# Parameters for the sparse event series: window, drop, shortest run, epoch, slack (seconds).
WINDOW, DROP, MIN_DURATION, EPOCH, LAG = 604800.0, 30.0, 86400.0, 86400.0, 43200.0
BIN = 86400.0
N_FOLDS = 5
SEED = 42
LINE_ROWS = 1_000_000  # order lines that one task groups


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def seconds_since_origin(ts: str = "ts") -> Column:
    """Microseconds between two zone-less timestamps, so the session zone does not matter."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{ORIGIN}', cast({ts} as timestamp_ntz))") / F.lit(1e6)


def timed_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("subject_id"), "event_type", "value", seconds_since_origin().alias("t")
    )


def b_series(spark: SparkSession, sf: str) -> DataFrame:
    return timed_events(spark, sf).select("subject_id", "t", F.col("value").alias("v"))


def b_annotation(spark: SparkSession, sf: str) -> DataFrame:
    e = timed_events(spark, sf).filter(F.col("event_type") == "error")
    return e.select(
        "subject_id",
        "event_id",
        F.col("t").alias("start"),
        (F.col("t") + F.col("value") * 600.0).alias("end"),
        F.when(F.col("event_id") % 2 == 1, "hypo").otherwise("osa").alias("event_type"),
    )


def b_awake(spark: SparkSession, sf: str) -> DataFrame:
    e = timed_events(spark, sf).filter(F.col("event_type") == "signup")
    return e.select("subject_id", F.col("t").alias("start"), (F.col("t") + F.col("value") * 600.0).alias("end"))


def b_anchors(spark: SparkSession, sf: str) -> DataFrame:
    e = timed_events(spark, sf).filter(F.col("event_type") == "click")
    return e.select(
        "subject_id", "event_id", "t", (F.col("value") / 10.0).alias("lag"), ((F.col("event_id") % 100) / 100.0).alias("correlation")
    )


def b_recordings(spark: SparkSession, sf: str) -> DataFrame:
    """Recorder and phone duration per subject; common is the shorter one."""
    e = timed_events(spark, sf).filter(F.col("event_type").isin("click", "view"))
    both = e.groupBy("subject_id").agg(
        F.max(F.when(F.col("event_type") == "click", F.col("t"))).alias("recorder_sec"),
        F.max(F.when(F.col("event_type") == "view", F.col("t"))).alias("phone_sec"),
    )
    return both.filter(F.col("recorder_sec").isNotNull() & F.col("phone_sec").isNotNull()).withColumn(
        "common_sec", F.least("recorder_sec", "phone_sec")
    )


def b_devices(spark: SparkSession, sf: str) -> DataFrame:
    """Daily mean of each device per subject: one row per (subject, day, device)."""
    e = timed_events(spark, sf).filter(F.col("event_type").isin("click", "view"))
    return e.groupBy(
        "subject_id",
        F.floor(F.col("t") / 86400.0).cast("long").alias("day"),
        F.when(F.col("event_type") == "click", "R").otherwise("S").alias("device"),
    ).agg(F.avg("value").alias("value"))


def b_device_pairs(spark: SparkSession, sf: str) -> DataFrame:
    d = b_devices(spark, sf)
    return (
        d.groupBy("subject_id", "day")
        .agg(
            F.max(F.when(F.col("device") == "R", F.col("value"))).alias("r"),
            F.max(F.when(F.col("device") == "S", F.col("value"))).alias("s"),
        )
        .filter(F.col("r").isNotNull() & F.col("s").isNotNull())
    )


def b_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order line with two arms m = 1, 2 of probabilities.

    Nearly every line is a group of its own, so partial sums before the shuffle would only fill memory, and a fixed
    number of partitions would grow with the table: the lines are dealt out first, ``LINE_ROWS`` a task.
    """
    lines = table(spark, sf, "lineitem")
    tasks = max(spark.sparkContext.defaultParallelism, -(-lines.count() // LINE_ROWS))
    base = (
        lines.select("l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey", "l_linestatus")
        .repartition(tasks, "l_orderkey", "l_linenumber")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(
            # R and O are the last letters of their columns: "the largest is R" is "some row is R".
            # A number as aggregate state lets Spark aggregate by hash instead of by sort.
            F.max((F.col("l_returnflag") == "R").cast("int")).alias("label"),
            F.max("l_suppkey").alias("subject_id"),
            F.when(F.max((F.col("l_linestatus") == "O").cast("int")) == 1, "R").otherwise("S").alias("device"),
        )
    )

    def arm(m: int) -> Column:
        return ((F.col("l_orderkey") * (7919 * m) + F.col("l_linenumber").cast("long") * 104729) % 1009) / F.lit(1009.0)

    return base.select(
        F.concat_ws("_", "l_orderkey", "l_linenumber").alias("sample_id"),
        "subject_id",
        "device",
        "label",
        (F.col("subject_id") % N_FOLDS).cast("int").alias("fold"),
        F.inline(
            F.array(
                F.struct(F.lit("m1").alias("arm"), arm(1).alias("probability")),
                F.struct(F.lit("m2").alias("arm"), arm(2).alias("probability")),
            )
        ),
    )


def b_results(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions spread over the protocols: representation = arm, train device drawn from the order line.

    Gives every (representation, classifier, protocol, fold) cell of the result tables.
    """
    p = b_predictions(spark, sf)
    train = F.when(F.length("sample_id") % 2 == 0, "R").otherwise("S")
    classifier = F.when(F.col("subject_id") % 2 == 0, "tree").otherwise("linear")
    return p.withColumn("classifier", classifier).withColumn("protocol", F.concat_ws("_", train, "device"))


def b_runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("experiment"),
        F.col("o_orderpriority").alias("arm"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("finished"),
        F.col("o_orderkey").alias("path"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("score"),
    )


def b_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        "embedding",
        F.when(F.col("label") % 2 == 0, "R").otherwise("S").alias("device"),
        (F.col("label") >= 5).cast("int").alias("label"),
        (F.col("vec_id") % 25).alias("subject_id"),
        (F.col("vec_id") % N_FOLDS).cast("int").alias("fold"),
    )


def b_features(spark: SparkSession, sf: str) -> DataFrame:
    """Two feature blocks per sample: the first and second half of the embedding."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").alias("sample_id"),
        F.inline(
            F.array(
                F.struct(F.lit("low").alias("feature"), F.slice("embedding", 1, 32).alias("vector")),
                F.struct(F.lit("high").alias("feature"), F.slice("embedding", 33, 32).alias("vector")),
            )
        ),
    )


def b_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Dense frames per subject: samples numbered by time within blocks of 16 frames of the day grid."""
    e = timed_events(spark, sf)
    return e.select("subject_id", "event_id", F.floor(F.col("t") / 3600.0).cast("long").alias("frame"), F.col("value").alias("v"), "t")

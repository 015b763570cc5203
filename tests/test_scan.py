import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairedsense.operators.ranks import mid_ranks, quantiles
from pairedsense.operators.scan import Running, neighbours, numbered, running, time_chunk


@pytest.mark.parametrize("width", [1.0, 13.0, 500.0])
def test_running_equals_a_plain_window(spark, width):
    rng = random.Random(7)
    data = [(rng.choice("ab"), float(t), rng.choice([None, 1.0, 2.0, 5.0])) for t in rng.sample(range(200), 120)]
    df = spark.createDataFrame(data, "k string, t double, x double").withColumn("c", time_chunk("t", width))
    got = running(
        df,
        ["k"],
        "c",
        {
            "s": Running("sum", F.col("x"), ("t",)),
            "m": Running("max", F.col("x"), ("t",), inclusive=False),
            "l": Running("last", F.col("x"), ("t",), inclusive=False),
            "n": Running("last", F.col("x"), ("t",), inclusive=False, descending=True),
        },
    )
    up = Window.partitionBy("k").orderBy("t")
    down = Window.partitionBy("k").orderBy(F.desc("t"))
    before = (Window.unboundedPreceding, -1)
    want = df.select(
        "k",
        "t",
        F.coalesce(F.sum("x").over(up.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)).alias("s"),
        F.max("x").over(up.rowsBetween(*before)).alias("m"),
        F.last("x", True).over(up.rowsBetween(*before)).alias("l"),
        F.last("x", True).over(down.rowsBetween(*before)).alias("n"),
    )
    key = lambda r: (r["k"], r["t"])
    assert [tuple(r) for r in sorted(got.select("k", "t", "s", "m", "l", "n").collect(), key=key)] == [
        tuple(r) for r in sorted(want.collect(), key=key)
    ]


def test_numbers_are_dense_and_unique(spark):
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("h"), (F.col("id") % 3).alias("k"))
    got = numbered(df, ["k"], "h", "n")
    stats = got.groupBy("k").agg(F.min("n"), F.max("n"), F.countDistinct("n"), F.count("*")).collect()
    assert all(r[1] == 1 and r[2] == r[3] == r[4] for r in stats)


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    data = [(g, float(v)) for g in (0, 1) for v in np.round(rng.lognormal(0, 2, 301 + g), 3)] + [(2, 4.0)]
    got = quantiles(spark.createDataFrame(data, "g int, v double"), ["g"], {"a": ("v", 0.1), "b": ("v", 0.5), "c": ("v", 0.975)})
    for r in got.collect():
        v = [x for g, x in data if g == r["g"]]
        assert (r["a"], r["b"], r["c"]) == pytest.approx(tuple(np.percentile(v, [10, 50, 97.5])))


def test_mid_ranks_of_ties(spark):
    df = spark.createDataFrame([(v,) for v in (3.0, 1.0, 3.0, 2.0, 3.0)], "v double")
    got = {r["v"]: r["mid_rank"] for r in mid_ranks(df, [], "v").collect()}
    assert got == {1.0: 1.0, 2.0: 2.0, 3.0: 4.0}


def test_neighbours_take_the_lowest_sequence_at_one_time(spark):
    left = spark.createDataFrame([("a", 5.0), ("a", 0.0)], "k string, t0 double")
    right = spark.createDataFrame([("a", 3.0, 2), ("a", 3.0, 1), ("a", 9.0, 4), ("a", 9.0, 3)], "k string, t double, s long")
    got = {r["t0"]: r for r in neighbours(left, right, ["k"], "t0", "t", "s", ["s"], 2.0).collect()}
    assert got[5.0]["prev"]["s"] == 1 and got[5.0]["next"]["s"] == 3
    assert got[0.0]["prev"] is None and got[0.0]["next"]["s"] == 1


def test_one_key_is_spread_over_tasks(spark):
    """The chunk is part of the shuffle key, so one key fills many partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    df = spark.range(8000).select(F.lit("hot").alias("k"), F.col("id").cast("double").alias("t")).withColumn("c", time_chunk("t", 100.0))
    out = running(df, ["k"], "c", {"s": Running("sum", F.lit(1).cast("long"), ("t",))})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = out.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(parts) == 8 and max(r["count"] for r in parts) < 8000 / 2


def test_rows_without_place_stay(spark):
    data = [("a", 1.0, 1.0), ("a", None, 2.0), (None, 2.0, 4.0), ("a", 3.0, 8.0)] + [(None, None, 16.0)] * 3
    df = spark.createDataFrame(data, "k string, t double, x double").withColumn("c", time_chunk("t", 1.0))
    got = running(df, ["k"], "c", {"s": Running("sum", F.col("x"), ("t",)), "l": Running("last", F.col("x"), ("t",), inclusive=False)})
    want = [("a", 1.0, 1.0, 1.0, None), ("a", 3.0, 8.0, 9.0, 1.0), ("a", None, 2.0, None, None), (None, 2.0, 4.0, None, None)]
    want += [(None, None, 16.0, None, None)] * 3
    assert sorted(map(str, map(tuple, got.select("k", "t", "x", "s", "l").collect()))) == sorted(map(str, want))


def test_cells_follow_the_rows(spark, monkeypatch):
    from pairedsense.operators import ranks

    monkeypatch.setattr(ranks, "WHOLE", 1000)
    monkeypatch.setattr(ranks, "CELL_ROWS", 200)
    df = spark.range(50_000).select(F.lit("a").alias("g"), (F.col("id") / 1e6).alias("x")).union(spark.createDataFrame([("a", 1e12), ("b", 1.0), ("b", 2.0)], "g string, x double"))
    placed = ranks.with_cells(df, ["g"], "x")
    load = placed.groupBy("g", "_cell").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("g", "_cell").collect()
    own = [r for r in load if r["g"] == "a"]
    assert max(r["n"] for r in own) < 2 * ranks.CELL_ROWS and len(own) > 200  # neither an outlier nor a large group crowds a cell
    assert all(x["high"] < y["low"] for x, y in zip(own, own[1:])) and sum(r["n"] for r in load) == 50_003
    halves = ranks.quantiles(df, ["g"], {"m": ("x", 0.5)}).collect()
    assert sorted((r["g"], r["m"]) for r in halves) == [("a", 0.025), ("b", 1.5)]


def test_staged_tables_go_with_their_block(spark):
    from pathlib import Path

    from pairedsense.session import stage, staging

    with staging(spark):
        kept = stage(spark.range(3))
        path = Path(kept.inputFiles()[0].removeprefix("file:")).parent
        assert kept.count() == 3 and path.exists()
    assert not path.exists()

"""Runs by event time, late samples, compacted changes."""

import random

import pytest
from pyspark.sql import functions as F

from pairedsense.operators import series
from pairedsense.session import folder_names, shared_path
from pairedsense.streaming import jobs

SAMPLES = "subject_id long, t double, v double, masked boolean"


@pytest.fixture
def rocks(spark):
    spark.conf.set(jobs.PROVIDER_KEY, jobs.ROCKS)
    yield spark
    spark.conf.unset(jobs.PROVIDER_KEY)


def recording(seed):
    rng = random.Random(seed)
    rows = []
    for subject in (1, 2, 3):
        level = 97.0
        for t in range(0, 600, 2):
            level = min(99.0, max(80.0, level + rng.choice([-2, -1, 0, 0, 1, 2])))
            rows.append((subject, float(t), level, 200 <= t < 230))
    return rows


def arrive(spark, batches):
    path = shared_path(spark, "arrivals")
    for part in batches:
        spark.createDataFrame(part, SAMPLES).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(path)


def as_rows(df):
    return sorted((r["subject_id"], r["start"], r["end"], round(r["max_drop"], 6)) for r in df.select("subject_id", "start", "end", "max_drop").collect())


def test_shuffled_batches_give_the_batch_result(rocks):
    rows = recording(3)
    shuffled = rows[:]
    random.Random(4).shuffle(shuffled)
    batches = [shuffled[i::4] for i in range(4)]
    batches[3] = batches[3] + [(9, 5000.0, 0.0, False)]  # lets the watermark pass all samples
    out, query = jobs.run_stream(jobs.stream_runs(arrive(rocks, batches), delay=700.0), "runs")
    whole = as_rows(series.detect_runs(rocks.createDataFrame(rows, SAMPLES), ["subject_id"], 3.0, 8.0, 100.0))
    last = max(t for _, t, _, _ in rows)
    assert as_rows(out) == [r for r in whole if r[2] < last] and len(whole) > 3
    assert jobs.late_rows(query) == 0


def test_late_samples_are_counted(rocks):
    rows = [r for r in recording(5) if r[0] == 1]
    early, late = [r for r in rows if r[1] != 100.0], [r for r in rows if r[1] == 100.0]
    batches = [early[:150], early[150:], late, [(9, 5000.0, 0.0, False)]]
    out, query = jobs.run_stream(jobs.stream_runs(arrive(rocks, batches), delay=20.0), "runs")
    assert jobs.late_rows(query) == 1
    want = as_rows(series.detect_runs(rocks.createDataFrame(early, SAMPLES), ["subject_id"], 3.0, 8.0, 100.0))
    assert as_rows(out) == [r for r in want if r[2] < 598.0]
    with pytest.raises(ValueError, match="watermark"):
        jobs.stream_runs(arrive(rocks, batches), idle_ms=5, delay=1.0)


def test_changes_are_compacted(spark, monkeypatch):
    path = shared_path(spark, "log")
    schema = "k long, ts timestamp, n long"
    for i in range(7):
        rows = spark.range(20).select(F.col("id").alias("k"), F.timestamp_seconds(F.lit(1000 + i) + F.col("id") * 0).alias("ts"), F.lit(i).cast("long").alias("n"))
        rows.filter(F.col("k") % (i + 1) == 0).coalesce(1).write.mode("append").parquet(path)
    made = []
    real = jobs.shared_path
    monkeypatch.setattr(jobs, "shared_path", lambda s, name: made.append(real(s, name)) or made[-1])
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r["k"]: r["n"] for r in jobs.stream_latest(log, ["k"], "ts", "n", compact=2).collect()}
    assert got == {k: max(i for i in range(7) if k % (i + 1) == 0) for k in range(20)}
    assert len(folder_names(spark, made[0])) <= 5

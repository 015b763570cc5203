import random

import pytest

from pairedsense.operators import series as se

S = "subject_id string, t double, v double, masked boolean"


def brute_runs(data, drop, min_dur, window):
    out = []
    for key in sorted({r[0] for r in data}):
        rows = sorted(r for r in data if r[0] == key)
        if len(rows) < 10:
            continue
        base = [max(v for _, u, v, _ in rows if t - window <= u <= t) for _, t, _, _ in rows]
        run = []
        for (_, t, v, m), b in [*zip(rows, base), ((None, None, 0.0, True), 0.0)]:
            if t is not None and b - v >= drop and not m:
                run.append((t, b - v))
                continue
            if run and run[-1][0] - run[0][0] >= min_dur:
                area = sum((a[1] + c[1]) / 2 * (c[0] - a[0]) for a, c in zip(run, run[1:]))
                out.append((key, run[0][0], run[-1][0], round(max(d for _, d in run), 9), round(area, 6)))
            run = []
    return sorted(out)


@pytest.mark.parametrize("pieces,chunk", [(1, 3.0), (8, 50.0), (5, 1000.0)])
def test_runs_match_brute_force(spark, pieces, chunk):
    rng = random.Random(2)
    data = []
    for key in "abc":
        level = 95.0
        for t in range(400):
            if rng.random() < 0.9:
                level = min(99.0, max(85.0, level + rng.choice([-1, 0, 1])))
                data.append((key, float(t), level, rng.random() < 0.05))
    got = se.detect_runs(spark.createDataFrame(data, S), ["subject_id"], 3.0, 8.0, 40.0, pieces, chunk).collect()
    assert sorted((r[0], r[1], r[2], round(r[4], 9), round(r[5], 6)) for r in got) == brute_runs(data, 3.0, 8.0, 40.0)


def test_thresholds_are_inclusive_and_open_runs_count(spark):
    data = [("a", float(t), 96.0, False) for t in range(10)]
    data += [("a", float(t), 93.0, False) for t in range(10, 19)]
    got = se.detect_runs(spark.createDataFrame(data, S), ["subject_id"]).collect()
    assert [(r["start"], r["end"], r["max_drop"], r["area"]) for r in got] == [(10.0, 18.0, 3.0, 24.0)]


def test_nine_samples_are_ignored(spark):
    data = [("a", float(t), 96.0 if t == 0 else 80.0, False) for t in range(0, 90, 10)]
    assert se.detect_runs(spark.createDataFrame(data, S), ["subject_id"]).count() == 0


def test_peers_at_one_time_are_in_the_window(spark):
    data = [("a", 0.0, 90.0), ("a", 5.0, 91.0), ("a", 5.0, 97.0), ("a", 105.0, 80.0), ("a", 105.1, 81.0)]
    got = se.trailing_max(spark.createDataFrame(data, "subject_id string, t double, v double"), ["subject_id"], 100.0).collect()
    assert sorted((r["t"], r["v"], r["baseline"]) for r in got) == [
        (0.0, 90.0, 90.0), (5.0, 91.0, 97.0), (5.0, 97.0, 97.0), (105.0, 80.0, 97.0), (105.1, 81.0, 81.0),
    ]


def test_samples_before_the_origin_have_no_epoch(spark):
    data = [("a", -1.0, 96.0, True)] + [("a", float(t), 96.0, t >= 300) for t in range(0, 650, 10)]
    series = spark.createDataFrame(data, S)
    runs = spark.createDataFrame([("a", 640.0, 640.0, 30.0), ("a", -1.0, 5.0, 9.0)], "subject_id string, start double, end double, area double")
    got = se.epoch_targets(series, runs, ["subject_id"]).orderBy("epoch_start_sec").collect()
    assert [(r["epoch_start_sec"], r["epoch_end_sec"], r["run_count"], r["masked_fraction"], r["excluded_from_training"]) for r in got] == [
        (0.0, 300.0, 0, 0.0, False), (300.0, 600.0, 0, 1.0, True), (600.0, 640.0, 1, 1.0, True),
    ]
    assert got[2]["hourly_rate"] == pytest.approx(90.0) and got[2]["severity_bin"] == "severe"


def test_empty_epochs_stay(spark):
    data = [("a", float(t), 96.0, False) for t in range(10)] + [("a", 1000.0, 96.0, False)]
    runs = spark.createDataFrame([], "subject_id string, start double, end double, area double")
    got = se.epoch_targets(spark.createDataFrame(data, S), runs, ["subject_id"]).orderBy("epoch_start_sec").collect()
    assert [r["masked_fraction"] for r in got] == [0.0, 1.0, 1.0, 0.0]


def test_trailing_max_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(se, "BLOCK", 5)
    rng = random.Random(3)
    data = [("a", float(t), rng.random()) for t in rng.sample(range(-500, 2000), 700)]
    got = {r["t"]: r["baseline"] for r in se.trailing_max(spark.createDataFrame(data, "k string, t double, v double"), ["k"], 100.0).collect()}
    assert got == {t: max(v for _, u, v in data if t - 100 <= u <= t) for _, t, _ in data}

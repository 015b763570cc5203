import random

import pytest
from pyspark.sql import functions as F

from pairedsense.operators import intervals as iv
from pairedsense.operators import joins as jn
from pairedsense.operators import negatives as ng

IV = "subject_id string, start double, end double"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_touching_intervals_merge_and_gaps(spark):
    df = spark.createDataFrame([("a", 0.0, 5.0), ("a", 5.0, 9.0), ("a", 20.0, 21.0)], IV)
    assert rows(iv.merge_intervals(df, ["subject_id"], 1.0, 30.0, 4.0)) == [("a", 1.0, 9.0), ("a", 20.0, 21.0)]
    bounds = spark.createDataFrame([("a", 1.0, 30.0), ("b", 0.0, 7.0)], "subject_id string, lo double, hi double")
    assert rows(iv.complement_intervals(df, bounds, ["subject_id"], 4.0)) == [
        ("a", 9.0, 20.0), ("a", 21.0, 30.0), ("b", 0.0, 7.0),
    ]


def test_covered_throughout_leaves_no_gap(spark):
    df = spark.createDataFrame([("a", -5.0, 50.0)], IV)
    bounds = spark.createDataFrame([("a", 0.0, 30.0)], "subject_id string, lo double, hi double")
    assert rows(iv.complement_intervals(df, bounds, ["subject_id"])) == []


@pytest.mark.parametrize("chunk", [1.0, 7.0, 1000.0])
def test_merge_is_idempotent_and_does_not_depend_on_chunks(spark, chunk):
    rng = random.Random(3)
    data = [(rng.choice("ab"), s := rng.uniform(0, 90), s + rng.uniform(0, 6)) for _ in range(120)]
    expected = []
    for key in "ab":
        merged = []
        for _, s, e in sorted(r for r in data if r[0] == key and r[2] > r[1]):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        expected += [(key, s, e) for s, e in merged]
    once = iv.merge_intervals(spark.createDataFrame(data, IV), ["subject_id"], chunk_seconds=chunk)
    assert rows(once) == sorted(expected)
    assert rows(iv.merge_intervals(once, ["subject_id"], chunk_seconds=chunk)) == sorted(expected)


def test_merged_and_gaps_cover_exactly(spark):
    rng = random.Random(5)
    data = [("a", s := rng.uniform(-5, 100), s + rng.uniform(0, 9)) for _ in range(40)]
    df = spark.createDataFrame(data, IV)
    bounds = spark.createDataFrame([("a", 0.0, 90.0)], "subject_id string, lo double, hi double")
    both = rows(iv.merge_intervals(df, ["subject_id"], 0.0, 90.0, 10.0)) + rows(iv.complement_intervals(df, bounds, ["subject_id"], 10.0))
    both.sort()
    assert both[0][1] == 0.0 and both[-1][2] == 90.0
    assert all(a[2] == b[1] for a, b in zip(both, both[1:]))


def test_mask_ends_are_closed(spark):
    pts = spark.createDataFrame([("a", t) for t in (0.9, 1.0, 2.0, 3.0, 3.1)], "subject_id string, t double")
    df = spark.createDataFrame([("a", 1.0, 3.0)], IV)
    got = {r["t"]: r["masked"] for r in iv.mask_points(pts, df, ["subject_id"], "t", 2.0).collect()}
    assert got == {0.9: False, 1.0: True, 2.0: True, 3.0: True, 3.1: False}


def test_interval_join_bound_is_inclusive_and_pairs_come_once(spark):
    d = spark.createDataFrame([("a", 55.0, 300.0), ("a", 55.001, 56.0)], IV)
    e = spark.createDataFrame([("a", 0.0, 10.0)], IV)
    got = jn.interval_join(d, e, ["subject_id"], 45.0, 5.0).collect()
    assert [(r["start"], r["end"]) for r in got] == [(55.0, 300.0)]


def test_nearest_ties_and_strict_tolerance(spark):
    left = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 50.0)], "subject_id string, id int, t0 double")
    right = spark.createDataFrame([("a", 7, 8.0), ("a", 8, 12.0), ("a", 9, 53.0)], "subject_id string, rid long, t double")
    got = jn.nearest_join(left, right, ["subject_id"], "t0", "t", "rid", ["rid"], 3.0, 4.0).collect()
    assert [(r["id"], r["match"]["rid"]) for r in got] == [(1, 7)]


def test_interpolation_is_clamped(spark):
    pts = spark.createDataFrame([("a", t) for t in (0.0, 10.0, 15.0, 20.0, 99.0)], "subject_id string, x double")
    anchors = spark.createDataFrame([("a", 10.0, 1.0), ("a", 20.0, 3.0)], "subject_id string, t double, lag double")
    got = {r["x"]: r["y"] for r in jn.interpolate(pts, anchors, ["subject_id"], "x", "lag", "y", 6.0).collect()}
    assert got == {0.0: 1.0, 10.0: 1.0, 15.0: 2.0, 20.0: 3.0, 99.0: 3.0}


def test_segments_break_on_gap_and_jump(spark):
    anchors = spark.createDataFrame(
        [("a", 1000.0, 0.0), ("a", 2800.0, 5.0), ("a", 4601.0, 5.0), ("a", 5000.0, 10.1)], "subject_id string, t double, lag double"
    )
    dur = spark.createDataFrame([("a", 5200.0)], "subject_id string, duration double")
    got = jn.segment_anchors(anchors, dur, "subject_id", chunk_seconds=900.0).orderBy("lower").collect()
    assert [(r["lower"], r["upper"], r["anchors"]) for r in got] == [(550.0, 2800.0, 2), (5000.0, 5200.0, 1)]


def test_pairs_are_by_logical_window(spark):
    data = [("w1", "w1_R", "R", 1.0, 2.0, 0.5), ("w1", "w1_S", "S", 1.5, 2.5, 0.0), ("w2", "w2_R", "R", 1.0, 2.0, 0.0)]
    df = spark.createDataFrame(data, "logical_window_id string, sample_id string, device string, start_sec double, end_sec double, offset double")
    got = jn.pair_devices(df, []).collect()
    assert [(r["r_sample_id"], r["s_sample_id"], r["alignment_error_ms"]) for r in got] == [("w1_R", "w1_S", 500.0)]


def test_missing_partner_fails(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, 5)], "k int, v int")
    with pytest.raises(Exception, match="no value for 2"):
        jn.attach_required(left, right, ["k"], "value").collect()


def events_and_blocked(spark, n=60):
    rng = random.Random(11)
    ev = [("a" if i % 3 else "b", i, s := rng.uniform(0, 950), s + rng.uniform(1, 12)) for i in range(n)]
    events = spark.createDataFrame(ev, "subject_id string, seq long, start double, end double")
    bounds = spark.createDataFrame([("a", 0.0, 1000.0), ("b", 0.0, 1000.0)], "subject_id string, lo double, hi double")
    return events, events.select("subject_id", "start", "end"), bounds


def test_fanout_does_not_change_the_draw(spark, monkeypatch):
    events, blocked, bounds = events_and_blocked(spark)
    gaps = iv.complement_intervals(blocked, bounds, ["subject_id"], 100.0)
    whole = rows(ng.place_negatives(events, gaps, ["subject_id"], "seq"))
    monkeypatch.setattr(ng, "FANOUT", 3)
    levels = ng.stretch_tree(gaps, ["subject_id"])
    assert len(levels) >= 3 and all(level.filter("size(entries) > 3").isEmpty() for level in levels)
    assert levels[-1].filter("node > 0").isEmpty() and levels[-1].count() == 2
    small = rows(ng.place_negatives(events, gaps, ["subject_id"], "seq"))
    assert len(whole) == 60
    for a, b in zip(whole, small):
        assert a[:2] == b[:2] and a[4] == pytest.approx(b[4], abs=1e-6)


def test_strict_negatives_are_clear(spark):
    events, blocked, bounds = events_and_blocked(spark)
    got = ng.place_strict(events, blocked, bounds, ["subject_id"], "seq", chunk_seconds=100.0).collect()
    busy = [tuple(r) for r in blocked.collect()]
    assert len(got) == 60
    clean = [r for r in got if not r["fallback"]]
    assert clean
    for r in got:
        assert r["end"] - r["start"] == pytest.approx(r["event_end"] - r["event_start"])
        assert -1e-6 <= r["start"] and r["end"] <= 1000.0 + 1e-6
        assert not any(k == r["subject_id"] and r["start"] < e - 1e-6 and r["end"] > s + 1e-6 for k, s, e in busy)
    for i, r in enumerate(clean):
        for q in clean[i + 1 :]:
            if q["subject_id"] == r["subject_id"]:
                assert r["start"] >= q["end"] - 1e-6 or q["start"] >= r["end"] - 1e-6


def test_too_long_event_is_dropped(spark):
    gaps = spark.createDataFrame([("a", 0.0, 5.0)], IV)
    events = spark.createDataFrame([("a", 1, 0.0, 6.0), ("a", 2, 0.0, 5.0)], "subject_id string, seq long, start double, end double")
    got = ng.place_negatives(events, gaps, ["subject_id"], "seq").collect()
    assert [(r["seq"], r["start"], r["end"]) for r in got] == [(2, 0.0, 5.0)]


def test_rounding_stays_inside_the_stretch(spark):
    """start + (end - start) may round past the end; strict negatives must not."""
    lo, hi = next((a, b) for a, b in zip((i / 7 + 1e7 for i in range(9999)), (i / 3 + 2.7e7 for i in range(9999))) if a + (b - a) > b)
    gaps = spark.createDataFrame([("a", lo, hi)], IV)
    events = spark.createDataFrame([("a", 1, 0.0, hi - lo)], "subject_id string, seq long, start double, end double")
    got = [ng.place_negatives(events, gaps, ["subject_id"], "seq", inside=x).first() for x in (False, True)]
    assert [r["start"] for r in got] == [lo, lo] and got[0]["end"] > hi and got[1]["end"] == hi


def test_draws_are_proportional_to_slack(spark):
    gaps = spark.createDataFrame([("a", 0.0, 11.0), ("a", 20.0, 51.0)], IV)
    events = spark.range(4000).select(F.lit("a").alias("subject_id"), F.col("id").alias("seq"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"))
    got = ng.place_negatives(events, gaps, ["subject_id"], "seq")
    low = got.filter("start < 15").agg(F.count("*"), F.avg("start")).first()
    assert abs(low[0] / 4000 - 0.25) < 0.03 and abs(low[1] - 5.0) < 0.5


def test_equal_windows_are_kept_apart(spark):
    from pairedsense.operators import joins as jn

    windows = spark.createDataFrame([("w", 1.0, 2.0), ("w", 1.0, 2.0), ("x", 9.0, 20.0)], "logical_window_id string, start_sec double, end_sec double").selectExpr("1L as s", "*")
    spans = spark.createDataFrame([(1, 0.0, 5.0, 0.0, 6.0), (1, 3.0, 9.0, 1.0, 9.0)], "s long, segment_start double, segment_end double, lower double, upper double")
    got = [(r["logical_window_id"], r["segment_start"]) for r in jn.assign_segment(windows, spans, "s").collect()]
    assert got == [("w", 0.0)] * 2
    points = spark.createDataFrame([(1, 0.0, 3.0), (1, 0.0, 3.0), (2, 0.0, 1.0)], "s long, a double, b double")
    anchors = spark.createDataFrame([(1, 0.0, 0.0), (1, 4.0, 8.0)], "s long, t double, lag double")
    both = jn.interpolate_both(points, anchors, ["s"], ("a", "x"), ("b", "y"), "lag")
    assert sorted((r["s"], r["x"], r["y"]) for r in both.collect() if r["s"] == 1) == [(1, 0.0, 6.0)] * 2 and both.filter("s = 2 and x is null and y is null").count() == 1

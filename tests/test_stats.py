import numpy as np
import pytest

from pyspark.sql import functions as F

from pairedsense.functions import tails
from pairedsense.operators import resample as rs
from pairedsense.operators import slopes
from pairedsense.operators import stats as st
from pairedsense.operators import vectors as vc


def test_tail_values():
    """Values of printed tables."""
    assert tails.t_quantile(0.975, 4) == pytest.approx(2.776445105, abs=1e-8)
    assert tails.t_quantile(0.975, 40) == pytest.approx(2.021075390, abs=1e-8)
    assert tails.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert tails.signed_rank_exact(0, 5) == pytest.approx(0.0625)


def test_signed_rank_drops_zeros_and_shares_ranks(spark):
    df = spark.createDataFrame([(0, v) for v in (0.0, 1.0, -1.0, 2.0, 3.0)], "g int, d double")
    r = st.wilcoxon_statistic(df, ["g"], "d").first()
    assert (r["n"], r["w_plus"], r["w_minus"], r["ties"]) == (4, 8.5, 1.5, 6.0)


def test_mann_whitney_of_separate_groups(spark):
    df = spark.createDataFrame([(0, "R", 5.0), (0, "R", 6.0), (0, "S", 1.0), (0, "S", 2.0), (1, "R", 1.0)], "g int, d string, v double")
    got = {r["g"]: r for r in st.mann_whitney(df, ["g"], "d", "R", "v").collect()}
    assert (got[0]["u"], got[0]["cliffs_delta"]) == (4.0, 1.0)
    assert got[1]["u"] is None and got[1]["p_value"] is None


def test_bootstrap_spread_and_repeatability(spark):
    rng = np.random.default_rng(0)
    values = rng.normal(3, 2, 60)
    df = spark.createDataFrame([(f"s{i}", float(v)) for i, v in enumerate(values)], "subject_id string, m double")
    a = rs.draws(df.repartition(1), [], "subject_id", ["m"], 800).orderBy("iteration").toPandas()
    b = rs.draws(df.repartition(5), [], "subject_id", ["m"], 800).orderBy("iteration").toPandas()
    assert np.allclose(a["m"], b["m"])
    assert a["m"].std() == pytest.approx(values.std() / np.sqrt(60), rel=0.15)
    assert a["m"].mean() == pytest.approx(values.mean(), abs=0.05)


def test_theil_sen_of_a_line(spark):
    df = spark.createDataFrame([("a", k, float(k * 100), 2.0 + 0.01 * k * 100 + (5.0 if k == 4 else 0.0)) for k in range(5)], "s string, k int, x double, y double")
    r = st.theil_sen(df, ["s"], "x", "y").first()
    assert r["slope"] == pytest.approx(0.01) and r["intercept"] == pytest.approx(2.0) and r["max_residual"] == pytest.approx(5.0)


def test_coral_gives_the_target_covariance(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4)) + 1.0
    b = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) - 2.0
    frame = lambda x: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, vector array<double>")
    out = vc.coral_apply(frame(a), vc.coral_fit(frame(a), frame(b), 1e-9)).toPandas()
    z = np.stack(out["vector"])
    assert np.allclose(np.cov(z, rowvar=False), np.cov(b, rowvar=False), atol=1e-4)
    assert np.allclose(z.mean(axis=0), b.mean(axis=0), atol=1e-6)


def test_missing_block_fails(spark):
    feats = spark.createDataFrame([(1, "a", [1.0]), (1, "b", [2.0]), (2, "a", [3.0])], "sample_id int, feature string, vector array<float>")
    rep = spark.createDataFrame([("b", 0), ("a", 1)], "feature string, ordinal int")
    assert vc.assemble(feats.filter("sample_id = 1"), rep).first()["vector"] == [2.0, 1.0]
    with pytest.raises(Exception, match="incomplete feature blocks"):
        vc.assemble(feats, rep).collect()


def test_alignment_uses_reliable_anchors(spark):
    good = [("a", float(k * 900), 1.0 + 0.001 * k * 900, 0.9) for k in range(4)] + [("a", 4500.0, 99.0, 0.1)]
    weak = [("b", float(k * 900), float(k % 2) * 8, 0.2) for k in range(5)]
    df = spark.createDataFrame(good + weak, "s string, t double, lag double, correlation double")
    r = {x["s"]: x for x in st.alignment_models(df, ["s"]).collect()}
    assert (r["a"]["anchors"], r["a"]["reliable_anchors"], r["a"]["points"]) == (5, 4, 4)
    assert r["a"]["slope"] == pytest.approx(0.001) and r["a"]["max_residual"] == pytest.approx(0, abs=1e-9) and not r["a"]["low_confidence"]
    assert r["b"]["points"] == 5 and r["b"]["low_confidence"]


def test_slopes_of_a_crowded_key_are_selected(spark, monkeypatch):
    monkeypatch.setattr(slopes, "GROUP_BITS", 3)
    rng = np.random.default_rng(2)
    n = {"a": 700, "b": 51, "c": 3}
    rows = [(s, float(x), float(y), 0.9) for s, k in n.items() for x, y in zip(rng.integers(0, 400, k), rng.normal(size=k))]
    df = spark.createDataFrame(rows + [("d", 1.0, 2.0, 0.9), ("d", 1.0, 3.0, 0.9)], "s string, t double, lag double, correlation double")
    out = st.alignment_models(df, ["s"])
    plan = out._jdf.queryExecution().toString()
    assert "median(" not in plan
    got = {r["s"]: r for r in out.collect()}
    assert set(got) == set(n)
    for s in n:
        x, y = np.array([r[1:3] for r in rows if r[0] == s]).T
        i, j = np.nonzero(x[None, :] > x[:, None])
        slope = np.median((y[j] - y[i]) / (x[j] - x[i]))
        icpt = np.median(y) - slope * np.median(x)
        assert got[s]["points"] == n[s] and got[s]["slope"] == pytest.approx(slope, rel=1e-9) and got[s]["intercept"] == pytest.approx(icpt, rel=1e-9)
        assert got[s]["max_residual"] == pytest.approx(np.abs(y - icpt - slope * x).max(), rel=1e-9)


def test_median_slopes_against_all_pairs(spark, monkeypatch):
    """One table with all kinds of keys: smooth, on a grid, on a line, flat, with one slope in most pairs."""
    monkeypatch.setattr(slopes, "GROUP_BITS", 4)
    rng = np.random.default_rng(7)
    rows = []
    kinds = {key: (kind, n) for kind in ("smooth", "grid", "line", "flat", "heavy") for key, n in ((f"{kind}-a", 300), (f"{kind}-b", 70), (f"{kind}-c", 2), (f"{kind}-d", 20))}
    for key, (kind, n) in kinds.items():
        x = rng.integers(0, 3 * n, n).astype(float) if kind != "smooth" else rng.uniform(1e6, 2e6, n)
        y = {"smooth": 3e-4 * x + rng.standard_t(2, n), "grid": np.round(rng.normal(size=n)), "line": 0.25 * x - 7, "flat": np.full(n, 5.0),
             "heavy": np.where(rng.random(n) < 0.8, 2 * x, rng.normal(size=n) * 100)}[kind]
        rows += [(key, float(a), float(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows + [("e", 1.0, 1.0), ("e", 1.0, 2.0), ("grid-a", None, 1.0), ("grid-a", 1.0, None)], "s string, _x double, _y double").withColumn("_i", F.monotonically_increasing_id())
    got = {r["s"]: r["slope"] for r in slopes.median_slopes(df, ["s"], small=10).collect()}
    assert set(got) <= set(kinds)
    for key in kinds:
        x, y = np.array([r[1:] for r in rows if r[0] == key]).T
        i, j = np.nonzero(x[None, :] > x[:, None])
        if len(i):
            assert got[key] == pytest.approx(np.median((y[j] - y[i]) / (x[j] - x[i])), rel=1e-9, abs=1e-11)


def test_inversions_are_counted(spark, monkeypatch):
    rng = np.random.default_rng(8)
    code, r = rng.integers(0, 150, 300), np.round(rng.normal(size=300), 1)
    want = int(((code[:, None] < code[None, :]) & (r[None, :] < r[:, None])).sum())
    df = spark.createDataFrame([("k", int(c), float(v)) for c, v in zip(code, r)], "s string, _code long, _r double")
    for bits in (12, 3):
        monkeypatch.setattr(slopes, "GROUP_BITS", bits)
        assert slopes.inversions(df, ["s"], 8).first()["below"] == want


def test_lag_by_blocks_equals_the_plain_search(spark):
    from pairedsense.operators import dsp

    rng = np.random.default_rng(9)
    base = rng.normal(size=900)
    left = [("a", i, float(base[i])) for i in range(60, 860) if rng.random() < 0.9] + [("b", 5, 1.0)]
    right = [("a", i, float(base[i + 37]) + float(rng.normal()) * 0.1) for i in range(0, 840)] + [("b", 2, 1.0), ("c", 1, 1.0)]
    l, r = (spark.createDataFrame(x, "s string, frame long, z double") for x in (left, right))
    take = lambda df: sorted((x["s"], x["lag"], round(x["correlation"], 9), x["at_boundary"]) for x in df.collect())
    for block, reach in ((64, 50), (16, 200), (1024, 37)):
        got = take(dsp.best_lag_blocks(l, r, ["s"], reach, block))
        assert got == take(dsp.best_lag(l, r, ["s"], reach)) and got[0][1] == 37 and got[1][:2] == ("b", 3)


def test_lag_by_blocks_takes_many_pairs_at_once(spark):
    """60,000 windows of one pair each: a frame built for every pair took over a millisecond, half a minute in all."""
    from time import perf_counter

    from pyspark.sql import functions as F

    from pairedsense.operators import dsp

    ids = spark.range(60000).coalesce(1).select(F.col("id").alias("s"), F.explode(F.expr("array(1L, 4L)")).alias("frame"))
    side = ids.withColumn("z", F.when(F.col("frame") == 1, 1.0).otherwise(F.col("s") % 3 - 1.0))
    start = perf_counter()
    got = dsp.best_lag_blocks(side, side, ["s"], 5, 16).groupBy("lag").count().orderBy("lag").collect()
    assert perf_counter() - start < 20
    assert [tuple(r) for r in got] == [(0, 60000)]


def test_skipped_comparisons(spark):
    """Too few folds, unequal numbers, equal numbers of different samples, and a pair that aligns; the arms read the lines once."""
    from pairedsense.operators import resample as rs
    from pairedsense.plans import inference

    sizes = {"a": range(10), "b": range(10), "c": range(9), "d": range(1, 11), "e": range(3)}
    rows = [(arm, i % 5, i) for arm, ids in sizes.items() for i in ids]
    specs = spark.createDataFrame([(f"a{x}", "a", x) for x in "bcdef"], "comparison string, left string, right string")
    got = rs.skipped(spark.createDataFrame(rows, "arm string, fold int, sample_id long"), specs, 5, ["sample_id"]).collect()
    uneven, short = "prediction sets do not align", "incomplete folds"
    assert sorted(map(tuple, got)) == [("ac", uneven), ("ad", uneven), ("ae", short), ("af", short)]
    plan = inference.arms(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1

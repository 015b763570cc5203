"""Grids of fits: recovery after a failure, records, kept models, alignment; projections against a plain eigen-decomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairedsense.operators import grid as gr
from pairedsense.operators import models as ml
from pairedsense.operators import vectors as vc
from pairedsense.session import shared_path, stage

LEARN, BLIND = {"maxIter": 10}, {"maxIter": 0}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    out = []
    for i in range(240):
        label, device = i % 2, "RS"[(i // 2) % 2]
        x = rng.normal(0, 0.1, 6)
        x[0] += 2.0 * label - 1 + (6.0 if device == "S" else 0.0)
        out.append((i, i % 15, device, label, (i % 15) % 3, x.tolist()))
    return stage(spark.createDataFrame(out, "sample_id long, subject_id long, device string, label int, fold int, vector array<double>"), "rows")


def test_a_failed_run_resumes(spark, rows, monkeypatch):
    root, asked = shared_path(spark, "grid"), ["R_R", "R_S", "S_S"]
    run = lambda protocols: gr.run_grid({"a": rows}, {"logistic_regression": [BLIND, LEARN]}, protocols, [0, 1, 2], 3, root, workers=1)
    real, begun = gr._run_fit, []

    def fails(given, known, fit, *rest):
        begun.append(fit)
        if len(begun) == 4:
            raise RuntimeError("lost")
        real(given, known, fit, *rest)

    monkeypatch.setattr(gr, "_run_fit", fails)
    with pytest.raises(RuntimeError, match="lost"):
        run(asked)
    first = {(r["protocol"], r["fold"]) for r in gr.records(spark, root).collect()}
    assert 0 < len(first) < 9 and len(begun) < 6
    before = len(begun)
    out = gr.cell_metrics(run(asked)).collect()
    assert len(begun) - before == 6 - 3  # a fit serves R_R and R_S
    assert len(out) == 9 and all(r["n"] == 40 for r in out)
    before = len(begun)
    assert run(asked).count() == 9 * 40 and len(begun) == before
    assert {r["protocol"] for r in run(["R_R"]).select("protocol").distinct().collect()} == {"R_R"} and len(begun) == before
    # Rows that differ in one value are another grid.
    other = rows.withColumn("vector", F.when(F.col("sample_id") == 3, F.array(*[F.lit(0.5)] * 6)).otherwise(F.col("vector")))
    gr.run_grid({"a": other}, {"logistic_regression": [BLIND, LEARN]}, ["R_R"], [0], 3, root, workers=1)
    assert len(begun) == before + 1


def test_records(spark, rows):
    root = shared_path(spark, "grid")
    p = gr.run_grid({"a": rows}, {"logistic_regression": [BLIND, LEARN]}, ["R_R", "R_S"], [1], 3, root)
    by = {r["protocol"]: r for r in gr.records(spark, root).collect()}
    r = by["R_S"]
    assert (r["selected"], r["train_rows"], r["validation_rows"], r["test_rows"]) == (1, 40, 40, 40)
    assert r["test_subjects"] == [s for s in range(15) if s % 3 == 1] and r["validation_subjects"] == [s for s in range(15) if s % 3 == 2]
    assert not set(r["train_subjects"]) & {*r["test_subjects"], *r["validation_subjects"]} and '"maxIter": 10' in r["parameters"]
    got = {(m["protocol"], m["device"]): (m["n"], m["balanced_accuracy"]) for m in gr.cell_metrics(p, ["protocol", "device"]).collect()}
    assert got == {("R_R", "R"): (40, 1.0), ("R_S", "S"): (40, 0.5)}
    assert p.columns == ["representation", "classifier", "protocol", "fold", "sample_id", "subject_id", "device", "label", "probability"]


def test_a_kept_model_serves_later_protocols(spark, rows, monkeypatch):
    root = shared_path(spark, "grid")
    run = lambda protocols: gr.run_grid({"a": rows}, {"logistic_regression": [LEARN]}, protocols, [0], 3, root, keep_models=True)
    run(["R_R"])
    monkeypatch.setattr(ml, "fit", lambda *a, **b: pytest.fail("fitted again"))
    both = run(["R_R", "R_S"])
    assert {r["protocol"]: r["reused"] for r in gr.records(spark, root).collect()} == {"R_R": False, "R_S": True}
    assert both.count() == 80


def test_fits_share_one_pass_over_their_rows(spark, rows):
    """The vectors come from a function that counts its calls: once for the digest and counts, once for all fits, candidates and scorings."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def counted(x):
        calls.add(1)
        return x

    made = rows.withColumn("vector", counted("vector"))
    p = gr.run_grid({"a": made}, {"logistic_regression": [BLIND, LEARN], "random_forest": [{"maxDepth": 2, "numTrees": 3}]}, ["R_R", "RS_RS"], [0, 1, 2], 3, workers=2)
    assert p.count() == 2 * (120 + 240) and calls.value <= 2 * 240


def test_a_single_fit_holds_its_rows(spark, rows):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def counted(x):
        calls.add(1)
        return x

    ml.fit(rows.withColumn("vector", counted("vector")), "random_forest", {"maxDepth": 2, "numTrees": 3}, counts={0: 120, 1: 120}, width=6)
    assert calls.value == 240


def test_alignment_lifts_accuracy_on_moved_rows(spark, rows):
    scores = {}
    for plan in (gr.plain_plan, gr.coral_plan, gr.coral_raw_plan):
        p = gr.run_grid({"a": rows}, {"logistic_regression": [LEARN]}, ["R_S", "S_R"], [0, 1, 2], 3, split=plan)
        assert p.groupBy("protocol", "sample_id").count().filter("count > 1").count() == 0 and p.count() == 240
        scores[plan.__name__] = {r["balanced_accuracy"] for r in gr.cell_metrics(p).collect()}
    assert scores["plain_plan"] == {0.5} and scores["coral_raw_plan"] == {1.0} and scores["coral_plan"] == {0.5}


def test_alignment_wants_one_source_device(spark, rows):
    with pytest.raises(ValueError, match="one source"):
        gr.coral_plan(rows, gr.Fit("", "", "", 0, ("R", "S"), ("RS_RS",)), 3)


def test_axes_span_the_leading_eigenvectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 12)) @ np.diag([9, 8, 7, 5, 4, 1, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4]) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    df = spark.createDataFrame([(v.tolist(),) for v in x], "vector array<double>")
    values, axes = np.linalg.eigh(np.cov(x.T))
    values, axes = values[::-1], axes[:, ::-1]
    model, _ = vc.fit_pca(df, 5)
    found = model.pc.toArray()
    np.testing.assert_allclose(model.explainedVariance.toArray(), values[:5] / values.sum(), rtol=1e-9)
    for k in range(1, 6):  # the projector has no sign or rotation freedom
        np.testing.assert_allclose(found[:, :k] @ found[:, :k].T, axes[:, :k] @ axes[:, :k].T, atol=1e-8)
    z = np.array([r[0] for r in vc.project(df, vc.fit_pca(df, 5), dimensions=3).collect()])
    np.testing.assert_allclose((z**2).sum(axis=0) / 399, values[:3], rtol=1e-8)

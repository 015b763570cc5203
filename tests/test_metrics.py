import random

import pytest
from pyspark.sql import functions as F

from pairedsense.operators import metrics as mt
from pairedsense.operators import summaries as sm

P = "g string, label int, probability double"


def test_published_row_follows_from_its_counts(spark):
    """Published metrics of one fold, from its four counts."""
    counts = spark.createDataFrame([(1874, 13, 1969, 13)], "tn long, fp long, fn long, tp long")
    r = mt.scores_from_counts(counts, []).first()
    want = {
        "accuracy": 0.4877229258206255, "balanced_accuracy": 0.49983489454908697, "precision": 0.5, "sensitivity": 0.006559031281533804,
        "specificity": 0.9931107578166402, "f1": 0.012948207171314742, "macro_f1": 0.3335247144059017, "mcc": -0.0020202602376233995,
        "cohen_kappa": -0.0003222066380306199,
    }
    assert {k: r[k] for k in want} == pytest.approx(want, abs=1e-12)
    empty = spark.createDataFrame([(1974, 0, 1992, 0)], "tn long, fp long, fn long, tp long")
    r = mt.scores_from_counts(empty, []).first()
    assert (r["precision"], r["f1"], r["mcc"], r["cohen_kappa"]) == (0.0, 0.0, 0.0, 0.0)
    assert r["macro_f1"] == pytest.approx(0.3323232323232323)


def test_published_summary_follows_from_its_folds(spark):
    folds = [(0, 0.538381394652086, 0.2384326802834514), (1, 0.5339162813276651, 0.3694697737250929), (2, 0.5322147251620464, 0.3643198906356801),
             (3, 0.608477800780222, 0.5718224427901847), (4, 0.5055273561684199, 0.2325581395348837)]
    df = spark.createDataFrame([("x", "R_S", *f) for f in folds], "representation string, protocol string, fold int, balanced_accuracy double, f1 double")
    r = sm.protocol_summary(df, ["representation", "protocol"], ["balanced_accuracy", "f1"]).first()
    assert r["folds"] == 5
    assert (r["balanced_accuracy_mean"], r["balanced_accuracy_std"]) == pytest.approx((0.5437035116180879, 0.0384357724046462))
    assert (r["f1_mean"], r["f1_std"]) == pytest.approx((0.3553205853938586, 0.1377385582867998))


def test_published_gap_follows_from_its_protocols(spark):
    data = [("x", p, v) for p, v in zip(("R_R", "S_S", "R_S", "S_R"), (0.5838606294429733, 0.6060859121488635, 0.535929046297993, 0.5652976667176312))]
    data += [("part", "R_R", 0.5)]
    got = sm.device_gap(spark.createDataFrame(data, "representation string, protocol string, score double"), ["representation"], "score").collect()
    assert len(got) == 1
    assert got[0]["mean_cross_device"] == pytest.approx(0.5506133565078121)
    assert got[0]["mean_device_gap"] == pytest.approx(0.0443599142881063)


def test_edge_rules(spark):
    data = [("one", 1, 0.7), ("one", 1, 0.2), ("tied", 0, 0.4), ("tied", 1, 0.4), ("half", 1, 0.5), ("half", 0, 0.1)]
    df = spark.createDataFrame(data, P)
    auc = {r["g"]: r["roc_auc"] for r in mt.roc_auc(df, ["g"]).collect()}
    assert auc == {"one": None, "tied": 0.5, "half": 1.0}
    m = {r["g"]: r for r in mt.binary_metrics(df, ["g"]).collect()}
    assert m["half"]["tp"] == 1
    assert m["one"]["specificity"] is None and m["one"]["balanced_accuracy"] == 0.5
    ap = {r["g"]: r["average_precision"] for r in mt.average_precision(df, ["g"]).collect()}
    assert ap["one"] is None and ap["half"] == 1.0


def test_auc_of_reversed_scores(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([("a", rng.randint(0, 1), round(rng.random(), 2)) for _ in range(300)], P)
    a = mt.roc_auc(df, ["g"]).first()["roc_auc"]
    b = mt.roc_auc(df.withColumn("probability", 1.0 - F.col("probability")), ["g"]).first()["roc_auc"]
    assert a + b == pytest.approx(1.0)


def test_first_path_wins_a_tie(spark):
    data = [("e", "2024-01-01 10:00:00", "b", 1), ("e", "2024-01-01 10:00:00", "a", 2), ("e", "2023-01-01 10:00:00", "0", 3)]
    df = spark.createDataFrame(data, "k string, ts string, path string, v int").withColumn("ts", F.to_timestamp("ts"))
    assert [r["v"] for r in sm.pick_latest(df, ["k"], "ts", "path").collect()] == [2]


def test_lines_of_a_task_are_bounded(spark, monkeypatch):
    from pairedsense.plans import bindings

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(bindings, "LINE_ROWS", 100)
    got = bindings.b_predictions(spark, sf).select("sample_id", F.spark_partition_id().alias("p")).groupBy("p").agg(F.countDistinct("sample_id").alias("n"))
    sizes = [r["n"] for r in got.collect()]
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct().count()
    assert sum(sizes) == lines > 4000 and len(sizes) > 50 and max(sizes) < 300

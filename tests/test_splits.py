import random

import pytest

from pairedsense.operators import splits as sp

SUM = "subject_id string, positives long"


def greedy(rows, n):
    loads, sizes = [0] * n, [0] * n
    out = []
    for w in sorted((w for _, w in rows), reverse=True):
        f = min(range(n), key=lambda i: (loads[i], sizes[i], i))
        loads[f] += w
        sizes[f] += 1
        out.append((w, f))
    return sorted(out), loads


@pytest.mark.parametrize("seed", range(6))
def test_folds_equal_the_greedy_rule(spark, seed):
    rng = random.Random(seed)
    top = rng.choice([0, 1, 3, 50])
    rows = [(f"s{i}", rng.randint(0, top)) for i in range(rng.choice([5, 17, 90]))]
    want, _ = greedy(rows, 5)
    got = sp.assign_folds(spark.createDataFrame(rows, SUM), 5).collect()
    assert sorted((r["positives"], r["fold"]) for r in got) == want
    assert {r["subject_id"] for r in got} == {s for s, _ in rows}


def test_too_few_subjects_fail(spark):
    with pytest.raises(ValueError):
        sp.assign_folds(spark.createDataFrame([(f"s{i}", 1) for i in range(4)], SUM), 5)


def test_partitions_do_not_change_a_split(spark):
    df = spark.range(320).selectExpr("id as row_id", "cast(id % 40 as string) as patient_id")
    a = sorted(tuple(r) for r in sp.group_split(df.repartition(1)).select("row_id", "role").collect())
    b = sorted(tuple(r) for r in sp.group_split(df.repartition(7)).select("row_id", "role").collect())
    assert a == b
    assert len({r for r, role in a if role == "test"}) == 80


def test_one_group_fails(spark):
    df = spark.createDataFrame([(1, "p")], "row_id int, patient_id string")
    with pytest.raises(Exception, match="two groups"):
        sp.group_split(df).collect()


def test_roles_are_disjoint_and_cover(spark):
    folds = spark.createDataFrame([(f"s{i}", i % 5) for i in range(20)], "subject_id string, fold int")
    for outer in range(5):
        rows = sp.fold_roles(folds).filter(f"outer_fold = {outer}").collect()
        assert len({r["subject_id"] for r in rows}) == len(rows) == 20
        assert sum(r["role"] == "validation" for r in rows) == 4


def test_filter_spares_the_test_role(spark):
    rows = spark.createDataFrame([("a", "train", 1), ("b", "test", 1), ("c", "train", 0), ("d", "train", 1)], "sample_id string, role string, label int")
    flags = spark.createDataFrame([(s, False) for s in "abc"], "sample_id string, corroborated boolean")
    assert sorted(r["sample_id"] for r in sp.filter_uncorroborated(rows, flags).collect()) == ["b", "c", "d"]


def test_unknown_experiment_fails(spark):
    with pytest.raises(ValueError):
        sp.build_experiment(spark.range(1), "no_such")


def test_manifest_faults_are_counted(spark):
    from pairedsense.operators import checks as ck

    good = [(f"w{i}_{d}", f"w{i}", f"s{i % 3}", d, i % 2, 1.0, 2.0, f"w{i}") for i in range(6) for d in "RS"]
    rows = good + [
        ("w9_R", "w9", "s1", "R", 1, 1.0, 2.0, "w9"),  # no phone row
        ("w8_R", "w8", "s1", "R", 1, 1.0, 2.0, "w8"), ("w8_S", "w8", "s1", "S", 0, 5.0, 2.0, "w8"),  # labels and times differ, empty interval
        ("w0_R", "w7", "s7", "R", 0, -1.0, 2.0, "w7"), ("w7_S", "w7", "s7", "S", 0, -1.0, 2.0, "w7"),  # an id twice, before the start, in no fold
    ]
    manifest = spark.createDataFrame(rows, "sample_id string, logical_window_id string, subject_id string, device string, label int, start_sec double, end_sec double, paired_positive_id string")
    folds = spark.createDataFrame([("s0", 0), ("s1", 1), ("s2", 2), ("s2", 3), ("s5", 4)], "subject_id string, fold int")
    found = {r["check"]: (r["violations"], r["passed"]) for r in ck.check_manifest(manifest, folds).collect()}
    assert found == {
        "sample ids are unique": (1, False), "intervals are valid": (3, False), "windows are R/S pairs": (1, False),
        "pairs agree on key fields": (1, False), "one fold per subject": (1, False), "folds cover the manifest": (1, False),
    }
    split = {r["check"]: r["violations"] for r in ck.check_splits(manifest, folds).collect()}
    assert split["subject sets are equal"] == 2 and split["pairs hold on the reference clock"] == 2 and split["folds are 0..n-1"] == 0
    clean = ck.check_manifest(spark.createDataFrame(good, manifest.schema), spark.createDataFrame([("s0", 0), ("s1", 1), ("s2", 2)], folds.schema))
    assert all(r["passed"] for r in clean.collect())
    assert ck.check_manifest(manifest.limit(0), folds.limit(0)).filter("violations > 0").isEmpty()

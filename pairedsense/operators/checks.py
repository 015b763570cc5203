"""Integrity checks: each returns rows (check, passed, violations, detail)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import DAY, overlap_earlier
from .joins import touching
from .splits import check_split, protocol_roles


def _row(bad: DataFrame, text: str, detail: str = "") -> DataFrame:
    return bad.agg(F.count("*").alias("violations")).select(
        F.lit(text).alias("check"), (F.col("violations") == 0).alias("passed"), "violations", F.lit(detail).alias("detail")
    )


def _rows(counts: DataFrame, names: dict[str, str]) -> DataFrame:
    """One check row per counter column of a single-row frame."""
    pairs = [F.struct(F.lit(text).alias("check"), F.col(c).cast("long").alias("violations")) for c, text in names.items()]
    return counts.select(F.inline(F.array(*pairs))).select(
        "check", (F.col("violations") == 0).alias("passed"), "violations", F.lit("").alias("detail")
    )


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _keyed(manifest: DataFrame, folds: DataFrame, equal: Sequence[str]) -> DataFrame:
    """One row of facts per sample id, logical window and subject, from one scan of either table and one shuffle.

    A manifest row counts under its three keys, a row of the folds under its subject; partial sums
    are taken before the shuffle, so a subject of any size is one row per task.
    """
    kinds = {f.name: f.dataType for f in manifest.schema.fields}
    invalid = ~(F.col("end_sec") > F.col("start_sec")) | (F.col("start_sec") < 0)

    def fact(kind: str, key: Column, window: bool = False, fold: Column | None = None) -> Column:
        fields = [(F.col(c) if window else F.lit(None).cast(kinds[c])).alias(f"_{c}") for c in equal]
        device = (F.col("device") if window else F.lit(None)).cast("string").alias("_device")
        bad = (invalid if kind == "sample" else F.lit(False)).alias("_bad")
        number = (fold if fold is not None else F.lit(None)).cast("int").alias("_fold")
        return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), device, bad, number, F.lit(fold is None).alias("_here"), *fields)

    rows = manifest.select(
        F.inline(F.array(fact("sample", F.col("sample_id")), fact("window", F.col("logical_window_id"), window=True), fact("subject", F.col("subject_id"))))
    )
    # The same columns for the folds; what they lack is NULL.
    known = folds.select(*[F.col(c) if c in ("subject_id", "fold") else F.lit(None).cast(kinds[c]).alias(c) for c in dict.fromkeys(["subject_id", "fold", "device", "start_sec", "end_sec"])])
    both = rows.unionByName(known.select(F.inline(F.array(fact("subject", F.col("subject_id"), fold=F.col("fold"))))))
    same = F.lit(True)
    for c in equal:
        same = same & (F.min(f"_{c}") == F.max(f"_{c}"))
    return both.groupBy("kind", "key").agg(
        F.count("*").alias("n"),
        F.count_if("_bad").alias("bad"),
        F.count_if("_here").alias("here"),
        F.count("_fold").alias("there"),
        (F.min("_fold") != F.max("_fold")).alias("twice"),
        ((F.count("*") != 2) | (F.count_if(F.col("_device") == "R") != 1) | (F.count_if(F.col("_device") == "S") != 1)).alias("pair"),
        (~same).alias("fields"),
    )


def check_manifest(manifest: DataFrame, folds: DataFrame, n: int = 5) -> DataFrame:
    """Unique ids, valid intervals, exact pairs with equal fields, every subject in one fold; one scan of the manifest."""
    facts = _keyed(manifest, folds, ["subject_id", "label", "start_sec", "end_sec", "paired_positive_id"])
    sample, window, subject = (F.col("kind") == k for k in ("sample", "window", "subject"))
    counts = facts.agg(
        F.count_if(sample & (F.col("n") > 1)).alias("a"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("b"),
        F.count_if(window & F.col("pair")).alias("c"),
        F.count_if(window & F.col("fields")).alias("d"),
        F.count_if(subject & F.col("twice")).alias("e"),
        F.count_if(subject & (F.col("here") > 0) & ((F.col("there") == 0) | F.col("key").isNull())).alias("f"),
    )
    return _rows(
        counts,
        {"a": "sample ids are unique", "b": "intervals are valid", "c": "windows are R/S pairs", "d": "pairs agree on key fields", "e": "one fold per subject", "f": "folds cover the manifest"},
    )


def check_splits(manifest: DataFrame, folds: DataFrame, n: int = 5) -> DataFrame:
    """Equal subject sets, folds 0..n-1, pairs on one clock, every (fold, protocol) usable; two scans of the manifest."""
    facts = _keyed(manifest, folds, ["subject_id", "label", "start_sec", "end_sec"])
    window, subject = (F.col("kind") == k for k in ("window", "subject"))
    counts = facts.agg(
        F.count_if(subject & ((F.col("here") > 0) != (F.col("there") > 0))).alias("a"), F.count_if(window & (F.col("pair") | F.col("fields"))).alias("b")
    )
    expected = folds.sparkSession.range(n).select(F.col("id").cast("int").alias("fold"))
    found = folds.select(F.col("fold").cast("int").alias("fold")).distinct()
    wrong = expected.subtract(found).unionByName(found.subtract(expected))
    # Classes per (subject, device, label) are enough to judge every split.
    small = manifest.select("subject_id", "device", "label").distinct()
    rows = small.join(protocol_roles(folds, n), ["subject_id", "device"])
    return _all(
        [
            _rows(counts, {"a": "subject sets are equal", "b": "pairs hold on the reference clock"}),
            _row(wrong, "folds are 0..n-1"),
            check_split(rows, by=["fold", "protocol"]),
        ]
    )


def check_windows(windows: DataFrame, events: DataFrame, awake: DataFrame, bounds: DataFrame, bin_seconds: float = DAY) -> DataFrame:
    """Windows in coverage, positives equal to an event, negatives clear of events and awake time.

    ``windows`` is one row per logical window; negative-negative overlaps are
    counted but allowed, so that row always passes.
    """
    by = ["subject_id"]
    outside = windows.join(bounds, by).filter(
        (F.col("start_sec") < 0) | (F.col("end_sec") > F.col("hi") + 1e-6) | (F.col("end_sec") <= F.col("start_sec"))
    )
    pos, neg = windows.filter("label = 1"), windows.filter("label = 0")
    # An event stands in its own millisecond and both neighbours, so a pair on an edge still meets.
    place = F.floor(F.col("start") * 1000)
    known = events.select("subject_id", F.col("start").alias("_s"), F.col("end").alias("_e"), F.explode(F.array(place - 1, place, place + 1)).alias("_ms"))
    spot = pos.select("subject_id", "start_sec", "end_sec", F.floor(F.col("start_sec") * 1000).alias("_ms"))
    same = (
        (spot["subject_id"] == known["subject_id"])
        & (spot["_ms"] == known["_ms"])
        & (F.abs(F.col("start_sec") - F.col("_s")) < 1e-6)
        & (F.abs(F.col("end_sec") - F.col("_e")) < 1e-6)
    )
    strange = spot.join(known, same, "left_anti")
    blocked = events.select("subject_id", "start", "end").unionByName(awake.select("subject_id", "start", "end"))
    # Shrunk by a microsecond, so shared ends do not count as an overlap.
    shrunk = neg.select("subject_id", "logical_window_id", (F.col("start_sec") + 1e-6).alias("start"), (F.col("end_sec") - 1e-6).alias("end"))
    hit = touching(shrunk, blocked, by, 0.0, bin_seconds)
    over = overlap_earlier(
        neg.select("subject_id", F.col("logical_window_id"), F.col("start_sec").alias("start"), F.col("end_sec").alias("end")),
        by,
        "logical_window_id",
        bin_seconds,
    ).filter("overlaps_earlier")
    counted = over.agg(F.count("*").alias("violations")).select(
        F.lit("negatives overlapping negatives").alias("check"), F.lit(True).alias("passed"), "violations", F.lit("allowed").alias("detail")
    )
    return _all(
        [
            _row(outside, "windows are in coverage"),
            _row(strange, "positives equal an annotation"),
            _row(hit, "negatives are clear"),
            counted,
        ]
    )


def check_pairing(manifest: DataFrame, folds: DataFrame) -> DataFrame:
    """Complete pairs, one subject per pair, one fold per subject, equal sets, no pair across folds."""
    joined = manifest.join(folds.select("subject_id", "fold"), "subject_id", "left")
    pairs = joined.groupBy("logical_window_id").agg(
        (F.count("*") != 2).alias("_incomplete"),
        (F.min("subject_id") != F.max("subject_id")).alias("_subjects"),
        (F.countDistinct("fold") > 1).alias("_across"),
        F.count_if(F.col("fold").isNull()).alias("_nofold"),
    )
    faults = pairs.agg(
        F.count_if("_incomplete").alias("a"),
        F.count_if("_subjects").alias("b"),
        F.count_if("_across").alias("c"),
        F.count_if(F.col("_nofold") > 0).alias("d"),
    )
    twice = folds.groupBy("subject_id").agg(F.countDistinct("fold").alias("_n")).filter(F.col("_n") > 1)
    return _rows(
        faults,
        {"a": "pairs are complete", "b": "one subject per pair", "c": "no pair across folds", "d": "every pair has a fold"},
    ).unionByName(_row(twice, "one fold per subject"))


def check_baseline(predictions: DataFrame, folds: DataFrame, protocols: Sequence[str], n: int = 5) -> DataFrame:
    """All cells present, exactly the test subjects in each, one role per subject, devices as the protocol says,
    finite probabilities, no sample twice."""
    spark = predictions.sparkSession
    cells = spark.range(n).select(F.col("id").cast("int").alias("fold")).crossJoin(
        spark.createDataFrame([(p,) for p in protocols], "protocol string")
    )
    missing = cells.join(predictions.select("fold", "protocol").distinct(), ["fold", "protocol"], "left_anti")
    foreign = predictions.join(folds.select("subject_id", F.col("fold").alias("_f")), "subject_id", "left").filter(
        F.col("_f").isNull() | (F.col("_f") != F.col("fold"))
    )
    expected = cells.join(folds.select("subject_id", "fold").distinct(), "fold")
    absent = expected.join(predictions.select("protocol", "fold", "subject_id").distinct(), ["protocol", "fold", "subject_id"], "left_anti")
    leaking = folds.groupBy("subject_id").agg(F.min("fold").alias("_a"), F.max("fold").alias("_b")).filter("_a <> _b")
    wrong: Column = ~F.contains(F.element_at(F.split("protocol", "_"), 2), F.col("device"))
    p = F.col("probability")
    broken = p.isNull() | F.isnan(p) | ~((p >= 0) & (p <= 1))
    faults = predictions.agg(F.count_if(wrong).alias("a"), F.count_if(broken).alias("b"))
    copies = predictions.groupBy("protocol", "sample_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
    return _all(
        [
            _row(missing, "all cells are present"),
            _row(foreign, "predictions are of test subjects"),
            _row(absent, "every test subject has predictions"),
            _row(leaking, "no subject in two roles"),
            _rows(faults, {"a": "devices fit the protocol", "b": "probabilities are finite"}),
            _row(copies, "no sample twice"),
        ]
    )


def check_predictions(predictions: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    """Every configuration has all folds and no sample twice."""
    short = predictions.groupBy(*keys).agg(F.countDistinct("fold").alias("_n")).filter(F.col("_n") != n)
    copies = predictions.groupBy(*keys, "sample_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
    return _row(short, "all folds are present").unionByName(_row(copies, "sample ids are unique"))

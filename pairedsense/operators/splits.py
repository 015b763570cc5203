"""Subject folds, protocols, holdouts and samples. All draws are digests of seed and key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import text_hash
from .joins import exclude_seen
from .scan import numbered

# Protocol name, train devices, test devices.
PROTOCOL_DEVICES = (
    ("R_R", ("R",), ("R",)),
    ("S_S", ("S",), ("S",)),
    ("R_S", ("R",), ("S",)),
    ("S_R", ("S",), ("R",)),
    ("RS_RS", ("R", "S"), ("R", "S")),
)


def protocols(spark: SparkSession) -> DataFrame:
    """Protocol dimension: train devices, test devices and regime (five rows)."""
    rows = [(p, list(a), list(t), "matched" if a == t else "cross") for p, a, t in PROTOCOL_DEVICES]
    return spark.createDataFrame(rows, "protocol string, train_devices array<string>, test_devices array<string>, regime string")


def _level_plan(levels: list[tuple[int, int]], n: int) -> list[tuple[int, list[int], list[int]]]:
    """Greedy folds for whole levels of equally heavy subjects.

    Within a level the greedy rule settles into a fixed rotation as soon as one
    round visits every reachable fold once; the picks before that are few
    (bounded by the load differences), whatever the number of subjects.
    """
    loads, counts, plan = [0] * n, [0] * n, []
    for weight, size in levels:
        reach = n if weight else sum(1 for x in loads if x == min(loads))
        prefix: list[int] = []
        cycle: list[int] = []
        left = size
        while left:
            picks: list[int] = []
            for _ in range(min(reach, left)):
                fold = min(range(n), key=lambda f: (loads[f], counts[f], f))
                loads[fold] += weight
                counts[fold] += 1
                picks.append(fold)
            left -= len(picks)
            if len(set(picks)) == reach:
                cycle = picks
                rounds, rest = divmod(left, reach)
                for fold in cycle:
                    loads[fold] += weight * rounds
                    counts[fold] += rounds
                for fold in cycle[:rest]:
                    loads[fold] += weight
                    counts[fold] += 1
                left = 0
            else:
                prefix += picks
        plan.append((weight, prefix, cycle or [0]))
    return plan


def assign_folds(summary: DataFrame, n: int = 5, seed: int = 42, key: str = "subject_id", weight: str = "positives") -> DataFrame:
    """Heaviest subjects first, each to the lightest fold (then fewest subjects, then lowest index).

    Only the distinct weights and how many subjects have each reach the driver;
    there are at most as many as windows of the heaviest subject. Every
    subject finds its fold from its rank inside its weight.
    """
    levels = [
        (int(r[0]), int(r[1]))
        for r in summary.groupBy(weight).agg(F.count("*")).orderBy(F.desc(weight)).collect()
    ]
    if sum(size for _, size in levels) < n:
        raise ValueError(f"fewer subjects than the {n} folds asked for")
    plan = summary.sparkSession.createDataFrame(
        _level_plan(levels, n), f"{weight} long, _prefix array<int>, _cycle array<int>"
    )
    ranked = numbered(
        summary.select(key, F.col(weight).cast("long").alias(weight), text_hash(seed, key).alias("_h")), [weight], "_h", "_rank", tie=(key,)
    )
    early = F.size("_prefix")
    place = F.col("_rank") - 1
    fold = F.when(place < early, F.get("_prefix", place.cast("int"))).otherwise(
        F.get("_cycle", ((place - early) % F.size("_cycle")).cast("int"))
    )
    return ranked.join(plan, weight).select(key, fold.alias("fold"), weight)


def fold_roles(folds: DataFrame, n: int = 5, key: str = "subject_id") -> DataFrame:
    """Role of every subject in every outer fold; validation is the fold after the test fold."""
    outer = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("outer_fold")
    role = (
        F.when(F.col("fold") == F.col("outer_fold"), "test")
        .when(F.col("fold") == (F.col("outer_fold") + 1) % n, "validation")
        .otherwise("train")
    )
    return folds.select(key, "fold", outer).select("outer_fold", key, role.alias("role"))


def protocol_roles(folds: DataFrame, n: int = 5, key: str = "subject_id") -> DataFrame:
    """Role of every (subject, device) in every fold and protocol; validation uses the train devices."""
    dims = protocols(folds.sparkSession)
    roles = fold_roles(folds, n, key).crossJoin(F.broadcast(dims))
    devices = F.when(F.col("role") == "test", F.col("test_devices")).otherwise(F.col("train_devices"))
    return roles.select(F.col("outer_fold").alias("fold"), "protocol", "role", key, F.explode(devices).alias("device"))


def split(manifest: DataFrame, folds: DataFrame, fold: int, protocol: str, n: int = 5, key: str = "subject_id") -> DataFrame:
    """Rows of one fold and protocol with their role."""
    roles = protocol_roles(folds, n, key).filter((F.col("fold") == fold) & (F.col("protocol") == protocol))
    return manifest.join(roles.select(key, "device", "role"), [key, "device"])


def check_split(rows: DataFrame, key: str = "subject_id", by: Sequence[str] = ()) -> DataFrame:
    """No subject in two roles; every role present with both classes."""
    by = list(by)
    shared = rows.groupBy(*by, key).agg(F.countDistinct("role").alias("_n")).filter(F.col("_n") > 1)
    classes = rows.groupBy(*by, "role").agg(F.countDistinct("label").alias("_c"))
    cells = classes.groupBy(*by).agg(F.count("*").alias("_roles"), F.min("_c").alias("_low"))
    bad = cells.filter((F.col("_roles") < 3) | (F.col("_low") < 2))

    def row(df: DataFrame, text: str) -> DataFrame:
        return df.agg(F.count("*").alias("violations")).select(
            F.lit(text).alias("check"), (F.col("violations") == 0).alias("passed"), "violations", F.lit(",".join([*by, key])).alias("detail")
        )

    return row(shared, "no subject in two roles").unionByName(row(bad, "three roles with both classes"))


def filter_uncorroborated(rows: DataFrame, flags: DataFrame, key: str = "sample_id") -> DataFrame:
    """Drop uncorroborated positives from train and validation; the test role keeps everything."""
    joined = rows.join(flags.select(key, F.col("corroborated").alias("_f")), key, "left")
    keep = (F.col("role") == "test") | (F.col("label") == 0) | F.coalesce("_f", F.lit(True))
    return joined.filter(keep).drop("_f")


def _holdout_keys(keys: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    ranked = numbered(keys.select(key).distinct().withColumn("_h", text_hash(seed, key)), [], "_h", "_rank", tie=(key,))
    total = ranked.agg(F.count("*").alias("_n"))
    size = F.greatest(F.lit(1.0), F.bround(F.col("_n") * fraction))
    return ranked.crossJoin(F.broadcast(total)).filter(F.col("_rank") <= size).select(key)


def subject_holdout(df: DataFrame, fraction: float = 0.2, seed: int = 42, key: str = "subject_id") -> DataFrame:
    """Add ``role``: whole subjects in digest order become validation, the rest train."""
    held = _holdout_keys(df, key, fraction, seed).withColumn("_held", F.lit(True))
    return df.join(held, key, "left").withColumn(
        "role", F.when(F.col("_held").isNotNull(), "validation").otherwise("train")
    ).drop("_held")


def group_split(df: DataFrame, test_size: float = 0.25, seed: int = 42, group: str = "patient_id") -> DataFrame:
    """Whole groups to test or train; fewer than two groups fail. The test share is rounded up."""
    groups = df.select(group).distinct()
    ranked = numbered(groups.withColumn("_h", text_hash(seed, group)), [], "_h", "_rank", tie=(group,))
    total = ranked.agg(F.count("*").alias("_n"))
    enough = F.when(F.col("_n") < 2, F.raise_error(F.lit("a grouped split needs two groups")).cast("long")).otherwise(F.col("_n"))
    test = F.col("_rank") <= F.ceil(enough * F.lit(test_size))
    held = ranked.crossJoin(F.broadcast(total)).select(group, F.when(test, "test").otherwise("train").alias("role"))
    return df.join(held, group)


def build_experiment(df: DataFrame, name: str, test_size: float = 0.25, seed: int = 42, strict: bool = False) -> DataFrame:
    """Rows with ``role`` for an experiment name.

    ``in_domain_<device>``: grouped split of one device. ``cross_<a>_to_<b>``:
    train on one device, test on the other, with ``strict`` without patients
    seen in training; a side without rows fails. ``combined_device_group_split``: grouped split of all.
    """
    if name.startswith("in_domain_"):
        return group_split(df.filter(F.col("device") == name[len("in_domain_") :]), test_size, seed)
    if name.startswith("cross_") and "_to_" in name:
        source, target = name[len("cross_") :].split("_to_", 1)
        train, test = df.filter(F.col("device") == source), df.filter(F.col("device") == target)
        if strict:
            test = exclude_seen(test, train)
        for side, rows in (("source", train), ("target", test)):
            if rows.isEmpty():
                raise ValueError(f"experiment {name} has no {side} rows")
        return train.withColumn("role", F.lit("train")).unionByName(test.withColumn("role", F.lit("test")))
    if name == "combined_device_group_split":
        return group_split(df, test_size, seed)
    raise ValueError(f"unknown experiment {name}")


def stratified(df: DataFrame, strata: Sequence[str], k: int, key: str, seed: int = 42) -> DataFrame:
    """Up to k rows of every stratum, in digest order (limited per task before the shuffle)."""
    order = Window.partitionBy(*strata).orderBy(text_hash(seed, key), key)
    return df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k).drop("_rn")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight per class, and the negative/positive ratio, at least one."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(
        F.sum("n").alias("_all"),
        F.count("*").alias("_classes"),
        F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0)).alias("_pos"),
    )
    ratio = F.when(F.col("_pos") > 0, F.greatest(F.lit(1.0), (F.col("_all") - F.col("_pos")) / F.col("_pos")))
    return counts.crossJoin(F.broadcast(totals)).select(
        label, "n", (F.col("_all") / (F.col("_classes") * F.col("n"))).alias("balanced_weight"), ratio.alias("positive_weight")
    )

"""Metric, summary, set and ordering queries over predictions and run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..functions.tails import t_p_value
from ..operators import joins as jn
from ..operators import metrics as mt
from ..operators import setops as so
from ..operators import summaries as sm
from . import bindings as b
from .oracle_ctes import SUBJECT_SQL, with_ctes
from .registry import register

CELL = ["arm", "classifier", "protocol", "fold"]
CONFIG = ["arm", "classifier", "protocol"]


def r10(value):
    """Ten places: ratios of small counts are then almost never half-way cases."""
    return F.round(F.col(value), 10) + F.lit(0.0)


def r10s(df, keep, names):
    return df.select(*keep, *[r10(n).alias(n) for n in names])


COUNT_SQL = """CAST(sum(CASE WHEN label = 0 AND probability < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
CAST(sum(CASE WHEN label = 0 AND probability >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
CAST(sum(CASE WHEN label = 1 AND probability < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
CAST(sum(CASE WHEN label = 1 AND probability >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp"""

# Metrics from counts, each by its textbook definition (rates, then means of rates).
SCORE_SQL = """round(CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn), 10) + 0.0 AS accuracy,
round(CASE WHEN tp + fn = 0 THEN CAST(tn AS DOUBLE) / nullif(tn + fp, 0) WHEN tn + fp = 0 THEN CAST(tp AS DOUBLE) / (tp + fn)
  ELSE (CAST(tp AS DOUBLE) / (tp + fn) + CAST(tn AS DOUBLE) / (tn + fp)) / 2 END, 10) + 0.0 AS balanced_accuracy,
round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0), 10) + 0.0 AS "precision",
round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 10) + 0.0 AS sensitivity,
round(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 10) + 0.0 AS specificity,
round(coalesce(2 * CAST(tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0), 10) + 0.0 AS f1,
round((coalesce(2 * CAST(tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * CAST(tn AS DOUBLE) / nullif(2 * tn + fp + fn, 0), 0))
  / (CASE WHEN tp + fp + fn > 0 THEN 1 ELSE 0 END + CASE WHEN tn + fp + fn > 0 THEN 1 ELSE 0 END), 10) + 0.0 AS macro_f1,
round(coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE)) * sqrt(CAST(tp + fn AS DOUBLE))
  * sqrt(CAST(tn + fp AS DOUBLE)) * sqrt(CAST(tn + fn AS DOUBLE)), 0), 0), 10) + 0.0 AS mcc,
round(1 - (CAST(fp + fn AS DOUBLE) * (tp + tn + fp + fn)) / nullif(CAST(tp + fp AS DOUBLE) * (tn + fp) + CAST(tn + fn AS DOUBLE) * (tp + fn), 0), 10) + 0.0 AS cohen_kappa"""

TOTALS_SQL = """tn, fp, fn, tp, tn + fp + fn + tp AS n, tn + fp AS support_negative, tp + fn AS support_positive"""

COUNT_COLS = ["tn", "fp", "fn", "tp", "n", "support_negative", "support_positive"]


def counted(by: str, source: str = "results") -> str:
    return f"counted AS (SELECT {by}, {COUNT_SQL} FROM {source} GROUP BY {by})"


CELL_SQL = counted("arm, classifier, protocol, fold")
SCORED = CELL_SQL + f", scored AS (SELECT arm, classifier, protocol, fold, {TOTALS_SQL}, {SCORE_SQL} FROM counted)"


def cell_scores(spark, sf):
    return mt.binary_metrics(b.b_results(spark, sf), CELL)


def rounded_scores(spark, sf):
    return r10s(cell_scores(spark, sf), [*CELL, *COUNT_COLS], mt.SCORES)


@register(
    "ag7_binary_metrics",
    with_ctes("results", "SELECT * FROM scored", SCORED),
)
def binary(spark, sf):
    return rounded_scores(spark, sf)


@register(
    "ag8_subject_metrics",
    with_ctes("results", f"SELECT arm, subject_id, {TOTALS_SQL}, {SCORE_SQL} FROM counted", counted("arm, subject_id")),
)
def per_subject(spark, sf):
    out = mt.binary_metrics(b.b_predictions(spark, sf), ["arm", "subject_id"])
    return r10s(out, ["arm", "subject_id", *COUNT_COLS], mt.SCORES)


@register(
    "ag9_scoped_metrics",
    with_ctes(
        "pred",
        f"""SELECT arm, fold, scope, device_scope, {TOTALS_SQL}, {SCORE_SQL} FROM (
        SELECT arm, fold, 'overall' AS scope, 'all' AS device_scope, {COUNT_SQL} FROM pred GROUP BY arm, fold
        UNION ALL SELECT arm, fold, 'per_device', device, {COUNT_SQL} FROM pred GROUP BY arm, fold, device)""",
    ),
)
def scoped(spark, sf):
    out = mt.scoped_metrics(b.b_predictions(spark, sf), ["arm", "fold"])
    return r10s(out, ["arm", "fold", "scope", "device_scope", *COUNT_COLS], mt.SCORES)


_AUC = """ranked AS (SELECT arm, subject_id, label, rank() OVER (PARTITION BY arm, subject_id ORDER BY probability)
    + (count(*) OVER (PARTITION BY arm, subject_id, probability) - 1) / CAST(2 AS DOUBLE) AS r FROM pred),
auc AS (SELECT arm, subject_id, count(CASE WHEN label = 1 THEN 1 END) AS p, count(CASE WHEN label = 0 THEN 1 END) AS q,
    sum(CASE WHEN label = 1 THEN r END) AS s FROM ranked GROUP BY arm, subject_id)"""


@register(
    "ag10_roc_auc",
    with_ctes(
        "pred",
        """SELECT arm, subject_id, round(CASE WHEN p > 0 AND q > 0 THEN (s - CAST(p AS DOUBLE) * (p + 1) / 2) / (CAST(p AS DOUBLE) * q) END, 10) + 0.0 AS roc_auc FROM auc""",
        _AUC,
    ),
)
def auc(spark, sf):
    return r10s(mt.roc_auc(b.b_predictions(spark, sf), ["arm", "subject_id"]), ["arm", "subject_id"], ["roc_auc"])


_AP = """steps AS (SELECT arm, fold, probability, sum(label) AS pos, count(*) AS n FROM pred GROUP BY arm, fold, probability),
cum AS (SELECT a.arm, a.fold, a.probability, a.pos, a.n, sum(c.pos) AS tpc, sum(c.n) AS nc FROM steps a JOIN steps c
    ON c.arm = a.arm AND c.fold = a.fold AND c.probability >= a.probability GROUP BY ALL),
tot AS (SELECT arm, fold, sum(pos) AS p, sum(n) AS m FROM steps GROUP BY arm, fold)"""


@register(
    "ag11_average_precision",
    with_ctes(
        "pred",
        """SELECT arm, fold, round(sum(CAST(pos AS DOUBLE) / p * tpc / nc), 10) + 0.0 AS average_precision FROM cum JOIN tot USING (arm, fold)
        GROUP BY arm, fold""",
        _AP,
    ),
)
def ap(spark, sf):
    return r10s(mt.average_precision(b.b_predictions(spark, sf), ["arm", "fold"]), ["arm", "fold"], ["average_precision"])


@register(
    "ag12_roc_points",
    with_ctes(
        "pred",
        """SELECT arm, fold, round(probability, 10) + 0.0 AS threshold, round(CAST(nc - tpc AS DOUBLE) / (m - p), 10) + 0.0 AS fpr,
        round(CAST(tpc AS DOUBLE) / p, 10) + 0.0 AS tpr FROM cum JOIN tot USING (arm, fold)""",
        _AP,
    ),
)
def roc(spark, sf):
    return r10s(mt.roc_points(b.b_predictions(spark, sf), ["arm", "fold"]), ["arm", "fold"], ["threshold", "fpr", "tpr"])


@register(
    "ag12_pr_points",
    with_ctes(
        "pred",
        """SELECT arm, fold, round(probability, 10) + 0.0 AS threshold, round(CAST(tpc AS DOUBLE) / nc, 10) + 0.0 AS "precision",
        round(CAST(tpc AS DOUBLE) / p, 10) + 0.0 AS recall FROM cum JOIN tot USING (arm, fold)""",
        _AP,
    ),
)
def pr(spark, sf):
    return r10s(mt.pr_points(b.b_predictions(spark, sf), ["arm", "fold"]), ["arm", "fold"], ["threshold", "precision", "recall"])


@register(
    "ag13_calibration",
    with_ctes(
        "pred",
        """SELECT arm, CAST(least(floor(probability * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(probability), 10) + 0.0 AS mean_predicted,
        round(avg(CAST(label AS DOUBLE)), 10) + 0.0 AS observed FROM pred GROUP BY 1, 2""",
    ),
)
def calibrate(spark, sf):
    return r10s(mt.calibration(b.b_predictions(spark, sf), ["arm"]), ["arm", "bin", "n"], ["mean_predicted", "observed"])


SUMMARY = SCORED + """, summary AS (SELECT arm, classifier, protocol, count(*) AS folds, avg(balanced_accuracy) AS balanced_accuracy_mean,
    stddev_samp(balanced_accuracy) AS balanced_accuracy_std, avg(f1) AS f1_mean, stddev_samp(f1) AS f1_std FROM scored GROUP BY arm, classifier, protocol)"""


def summary(spark, sf):
    return sm.protocol_summary(cell_scores(spark, sf), CONFIG, ["balanced_accuracy", "f1"])


@register(
    "ag14_protocol_summary",
    with_ctes(
        "results",
        """SELECT arm, classifier, protocol, folds, round(balanced_accuracy_mean, 6) + 0.0 AS balanced_accuracy_mean,
        round(balanced_accuracy_std, 6) + 0.0 AS balanced_accuracy_std, round(f1_mean, 6) + 0.0 AS f1_mean, round(f1_std, 6) + 0.0 AS f1_std FROM summary""",
        SUMMARY,
    ),
)
def protocol_summary(spark, sf):
    return summary(spark, sf).select(
        *CONFIG, "folds", *[r6(c).alias(c) for c in ("balanced_accuracy_mean", "balanced_accuracy_std", "f1_mean", "f1_std")]
    )


@register(
    "ag15_device_gap",
    with_ctes(
        "results",
        """SELECT a.arm, a.classifier, round(a.v, 6) + 0.0 AS balanced_accuracy_mean_R_R, round(b.v, 6) + 0.0 AS balanced_accuracy_mean_S_S,
        round(c.v, 6) + 0.0 AS balanced_accuracy_mean_R_S, round(d.v, 6) + 0.0 AS balanced_accuracy_mean_S_R,
        round(a.v - c.v, 6) + 0.0 AS gap_r_to_s, round(b.v - d.v, 6) + 0.0 AS gap_s_to_r, round((a.v + b.v) / 2, 6) + 0.0 AS mean_matched,
        round((c.v + d.v) / 2, 6) + 0.0 AS mean_cross_device, round((a.v + b.v) / 2 - (c.v + d.v) / 2, 6) + 0.0 AS mean_device_gap
        FROM s a JOIN s b USING (arm, classifier) JOIN s c USING (arm, classifier) JOIN s d USING (arm, classifier)
        WHERE a.protocol = 'R_R' AND b.protocol = 'S_S' AND c.protocol = 'R_S' AND d.protocol = 'S_R'""",
        SUMMARY + ", s AS (SELECT arm, classifier, protocol, balanced_accuracy_mean AS v FROM summary)",
    ),
)
def gap(spark, sf):
    out = sm.device_gap(summary(spark, sf), ["arm", "classifier"], "balanced_accuracy_mean")
    return out.select("arm", "classifier", *[r6(c).alias(c) for c in out.columns[2:]])


@register(
    "ag16_confusion_totals",
    with_ctes("results", f"SELECT arm, classifier, protocol, {COUNT_SQL} FROM results GROUP BY arm, classifier, protocol"),
)
def totals(spark, sf):
    return sm.confusion_totals(cell_scores(spark, sf), CONFIG)


@register(
    "ag17_contribution",
    with_ctes(
        "pred",
        """SELECT x.subject_id, 'm2' AS removed, round(x.accuracy - y.accuracy, 6) + 0.0 AS difference FROM
        (SELECT subject_id, avg(CASE WHEN (probability >= 0.5) = (label = 1) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM pred WHERE arm = 'm1' GROUP BY 1) x
        JOIN (SELECT subject_id, avg(CASE WHEN (probability >= 0.5) = (label = 1) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM pred WHERE arm = 'm2' GROUP BY 1) y
        USING (subject_id)""",
    ),
)
def contributions(spark, sf):
    scores = mt.binary_metrics(b.b_predictions(spark, sf), ["arm", "subject_id"]).withColumnRenamed("arm", "representation")
    out = sm.contribution(scores, "m1", ["subject_id"], "accuracy")
    return out.select("subject_id", "removed", r6("difference").alias("difference"))


@register(
    "ag17_contribution_table",
    with_ctes(
        "pred",
        """SELECT 'm2' AS removed, metric, count(*) AS subjects, round(avg(d), 6) + 0.0 AS difference, CAST(0.05 AS DOUBLE) AS tail_at_limit FROM (
        SELECT x.metric, x.v - y.v AS d FROM long x JOIN long y ON y.subject_id = x.subject_id AND y.metric = x.metric AND x.arm = 'm1' AND y.arm = 'm2') GROUP BY metric""",
        SUBJECT_SQL + """, long AS (SELECT arm, subject_id, 'accuracy' AS metric, accuracy AS v FROM subj UNION ALL SELECT arm, subject_id, 'f1', f1 FROM subj)""",
    ),
)
def contribution_table(spark, sf):
    """The limits stand where a t test of the distance to the mean has a tail of 0.05."""
    scores = mt.binary_metrics(b.b_predictions(spark, sf), ["arm", "subject_id"]).withColumnRenamed("arm", "representation")
    out = sm.contribution_table(scores, "m1", "subject_id", ["accuracy", "f1"])
    t = (F.col("ci95_high") - F.col("difference")) / (F.col("std") / F.sqrt("subjects"))
    return out.select("removed", "metric", "subjects", r6("difference").alias("difference"), r6(t_p_value(t, F.col("subjects") - 1)).alias("tail_at_limit"))


@register(
    "ag18_select_by_validation",
    with_ctes(
        "runlog",
        """SELECT arm, round(avg(score), 4) + 0.0 AS score_mean, round(stddev_samp(score), 4) + 0.0 AS score_std, count(score) AS runs
        FROM runlog WHERE status = 'F' GROUP BY arm""",
    ),
)
def select(spark, sf):
    out = sm.select_by_validation(b.b_runs(spark, sf).filter("status = 'F'"), "arm", "score")
    return out.select("arm", (F.round("score_mean", 4) + 0.0).alias("score_mean"), (F.round("score_std", 4) + 0.0).alias("score_std"), "runs")


@register(
    "ag19_cost_table",
    """SELECT p_brand AS representation, CAST(sum(p_size) AS BIGINT) AS cached_bytes, count(*) AS branches,
    round(max(lat), 6) + 0.0 AS latency_mean, round(max(q), 6) + 0.0 AS quality FROM part JOIN
    (SELECT p_brand AS b, avg(l_quantity) AS lat, avg(l_discount) AS q FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) ON b = p_brand
    GROUP BY p_brand""",
)
def cost(spark, sf):
    part, line = b.table(spark, sf, "part"), b.table(spark, sf, "lineitem")
    blocks = part.select(F.col("p_brand").alias("representation"), F.col("p_size").cast("long").alias("bytes"))
    tagged = line.join(part.select("p_partkey", F.col("p_brand").alias("representation")), line.l_partkey == part.p_partkey)
    latency = tagged.select("representation", F.col("l_quantity").alias("seconds"))
    quality = tagged.groupBy("representation").agg(F.avg("l_discount").alias("quality"))
    out = sm.cost_table(blocks, latency, quality, "representation")
    return out.select("representation", "cached_bytes", "branches", r6("latency_mean").alias("latency_mean"), r6("quality").alias("quality"))


@register(
    "ag22_progress",
    with_ctes(
        "runlog",
        """SELECT experiment, count(*) AS expected, count(d.arm) AS completed FROM
        (SELECT DISTINCT experiment FROM runlog) e CROSS JOIN (SELECT DISTINCT arm FROM runlog) a
        LEFT JOIN (SELECT DISTINCT experiment, arm FROM runlog WHERE status = 'F') d USING (experiment, arm) GROUP BY experiment""",
    ),
)
def progress(spark, sf):
    runs = b.b_runs(spark, sf)
    grid = jn.grid(runs.select("experiment").distinct(), runs.select("arm").distinct())
    return sm.progress(grid, runs.filter("status = 'F'"), "experiment", ["experiment", "arm"])


@register(
    "ag27_transfer_matrix",
    with_ctes(
        "results",
        """SELECT arm, substr(protocol, 1, 1) AS train_device, round(avg(CASE WHEN substr(protocol, 3, 1) = 'R' THEN v END), 6) + 0.0 AS test_r,
        round(avg(CASE WHEN substr(protocol, 3, 1) = 'S' THEN v END), 6) + 0.0 AS test_s FROM (SELECT arm, protocol, balanced_accuracy_mean AS v FROM summary) GROUP BY 1, 2""",
        SUMMARY,
    ),
)
def transfer(spark, sf):
    out = sm.transfer_matrix(summary(spark, sf), ["arm"], "balanced_accuracy_mean")
    return out.select("arm", "train_device", r6("test_r").alias("test_r"), r6("test_s").alias("test_s"))


@register(
    "ag27_regime_gap",
    with_ctes(
        "results",
        """SELECT arm, round(m, 6) + 0.0 AS matched, round(c, 6) + 0.0 AS cross_device, round(m - c, 6) + 0.0 AS gap FROM (
        SELECT arm, avg(v) FILTER (protocol IN ('R_R', 'S_S')) AS m, avg(v) FILTER (protocol IN ('R_S', 'S_R')) AS c
        FROM (SELECT arm, protocol, balanced_accuracy_mean AS v FROM summary) GROUP BY arm)""",
        SUMMARY,
    ),
)
def regimes(spark, sf):
    out = sm.regime_gap(summary(spark, sf), ["arm"], "balanced_accuracy_mean")
    return out.select("arm", *[r6(c).alias(c) for c in ("matched", "cross_device", "gap")])


def _part_scores(spark, sf):
    """Result-table shape over parts: brand as representation, size class as experiment."""
    part = b.table(spark, sf, "part")
    return part.select(
        F.col("p_brand").alias("representation"),
        F.concat(F.lit("e"), F.col("p_size") % 3).alias("experiment"),
        F.col("p_retailprice").alias("score"),
    )


@register(
    "ag29_best_pivot",
    """WITH s AS (SELECT p_brand AS representation, 'e' || (p_size % 3) AS experiment, p_retailprice AS score FROM part),
    top AS (SELECT representation FROM s GROUP BY 1 ORDER BY avg(score) DESC, representation LIMIT 12)
    SELECT representation, max(score) FILTER (experiment = 'e0') AS e0, max(score) FILTER (experiment = 'e1') AS e1,
    max(score) FILTER (experiment = 'e2') AS e2 FROM s WHERE representation IN (SELECT representation FROM top) GROUP BY representation""",
)
def pivot(spark, sf):
    return sm.best_pivot(_part_scores(spark, sf), ["e0", "e1", "e2"])


@register(
    "ag30_breakdown_of_best",
    with_ctes(
        "results",
        """SELECT arm, classifier, protocol, fold, CAST(count(*) AS BIGINT) AS rows, CAST(sum(label) AS BIGINT) AS positives FROM results
        WHERE (arm, classifier, protocol) = (SELECT (arm, classifier, protocol) FROM (SELECT arm, classifier, protocol FROM summary
        ORDER BY round(balanced_accuracy_mean, 9) DESC, round(f1_mean, 9) DESC, arm, classifier, protocol LIMIT 1)) GROUP BY ALL""",
        SUMMARY,
    ),
)
def breakdown(spark, sf):
    detail = b.b_results(spark, sf).groupBy(*CONFIG, "fold").agg(
        F.count("*").alias("rows"), F.sum("label").cast("long").alias("positives")
    )
    order = [F.desc(F.round("balanced_accuracy_mean", 9)), F.desc(F.round("f1_mean", 9)), F.asc("arm"), F.asc("classifier"), F.asc("protocol")]
    return sm.breakdown_of_best(summary(spark, sf), detail, order, CONFIG).select(*CONFIG, "fold", "rows", "positives")


@register(
    "ag31_representation_catalog",
    """SELECT p_brand AS representation, string_agg(f, '+' ORDER BY o, f) AS features, CAST(sum(len) AS BIGINT) AS dimension, count(*) AS blocks FROM (
    SELECT p_brand, p_type AS f, min(p_size) AS o FROM part GROUP BY p_brand, p_type)
    JOIN (SELECT p_type AS t, count(*) AS len FROM part GROUP BY 1) ON t = f GROUP BY p_brand""",
)
def catalog(spark, sf):
    part = b.table(spark, sf, "part")
    dim = part.groupBy(F.col("p_brand").alias("representation"), F.col("p_type").alias("feature")).agg(F.min("p_size").alias("ordinal"))
    sizes = part.groupBy(F.col("p_type").alias("feature")).agg(F.count("*").alias("length"))
    return sm.representation_catalog(dim, sizes)


@register("ag31_base_features", "SELECT p_type AS feature, count(DISTINCT p_brand) AS representations FROM part GROUP BY 1")
def base_features(spark, sf):
    part = b.table(spark, sf, "part")
    return sm.base_features(part.select(F.col("p_brand").alias("representation"), F.col("p_type").alias("feature")))


@register(
    "ag2_dataset_summary",
    with_ctes("pred", "SELECT device, label, count(*) AS samples, count(DISTINCT subject_id) AS patients FROM pred GROUP BY 1, 2"),
)
def dataset(spark, sf):
    return sm.dataset_summary(b.b_predictions(spark, sf))


@register(
    "wn3_latest_runs",
    with_ctes(
        "runlog",
        """SELECT experiment, arm, path, status, score FROM (SELECT *, row_number() OVER (PARTITION BY experiment, arm
        ORDER BY finished DESC, path) AS rn FROM runlog) WHERE rn = 1""",
    ),
)
def latest(spark, sf):
    return sm.pick_latest(b.b_runs(spark, sf), ["experiment", "arm"], "finished", "path").select(
        "experiment", "arm", "path", "status", "score"
    )


def scoped_cells(spark, sf):
    return mt.scoped_metrics(b.b_predictions(spark, sf), ["arm", "fold"]).withColumnRenamed("fold", "experiment")


_SCOPED = f"""scoped AS (SELECT arm, fold AS experiment, scope, device_scope, {SCORE_SQL} FROM (
    SELECT arm, fold, 'overall' AS scope, 'all' AS device_scope, {COUNT_SQL} FROM pred GROUP BY arm, fold
    UNION ALL SELECT arm, fold, 'per_device', device, {COUNT_SQL} FROM pred GROUP BY arm, fold, device))"""


@register(
    "wn4_add_ranks",
    with_ctes(
        "pred",
        """SELECT arm, experiment, scope, device_scope, CASE WHEN scope = 'overall' THEN rank() OVER (PARTITION BY experiment, scope ORDER BY accuracy DESC) END AS rank_accuracy,
        CASE WHEN scope = 'overall' THEN rank() OVER (PARTITION BY experiment, scope ORDER BY balanced_accuracy DESC) END AS rank_balanced_accuracy,
        CASE WHEN scope = 'overall' THEN rank() OVER (PARTITION BY experiment, scope ORDER BY macro_f1 DESC) END AS rank_macro_f1 FROM scoped""",
        _SCOPED,
    ),
)
def ranks(spark, sf):
    base = r10s(scoped_cells(spark, sf), ["arm", "experiment", "scope", "device_scope"], ["accuracy", "balanced_accuracy", "macro_f1"])
    out = sm.add_ranks(base, "experiment", ["accuracy", "balanced_accuracy", "macro_f1"])
    return out.select("arm", "experiment", "scope", "device_scope", "rank_accuracy", "rank_balanced_accuracy", "rank_macro_f1")


@register(
    "wn5_best_per_group",
    with_ctes(
        "pred",
        """SELECT arm, experiment, accuracy, balanced_accuracy, macro_f1 FROM (SELECT *, row_number() OVER (PARTITION BY experiment
        ORDER BY accuracy DESC, balanced_accuracy DESC, macro_f1 DESC, arm) AS rn FROM scoped WHERE scope = 'overall') WHERE rn = 1""",
        _SCOPED,
    ),
)
def best(spark, sf):
    base = r10s(scoped_cells(spark, sf), ["arm", "experiment", "scope"], ["accuracy", "balanced_accuracy", "macro_f1"])
    out = sm.best_per_group(base.filter("scope = 'overall'"), ["experiment"], ["accuracy", "balanced_accuracy", "macro_f1"], ["arm"])
    return out.select("arm", "experiment", "accuracy", "balanced_accuracy", "macro_f1")


@register(
    "wn6_first_per_group",
    with_ctes(
        "timed",
        """SELECT subject_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, event_type ORDER BY t, event_id) AS rn
        FROM timed) WHERE rn = 1""",
    ),
)
def first(spark, sf):
    out = sm.first_per_group(b.timed_events(spark, sf), ["subject_id", "event_type"], ["t", "event_id"])
    return out.select("subject_id", "event_type", "event_id", "value")


@register(
    "so1_ordered",
    with_ctes("runlog", "SELECT experiment, arm, path, score FROM runlog WHERE status = 'F' ORDER BY experiment, score DESC, path"),
)
def ordered(spark, sf):
    runs = b.b_runs(spark, sf).filter("status = 'F'").select("experiment", "arm", "path", "score")
    return so.ordered(runs, [("experiment", "asc"), ("score", "desc"), ("path", "asc")])


@register(
    "so2_top_k",
    with_ctes("runlog", "SELECT experiment, arm, path, score FROM runlog ORDER BY score DESC, path LIMIT 30"),
)
def top(spark, sf):
    return sm.top_k(b.b_runs(spark, sf), [F.desc("score"), F.asc("path")], 30).select("experiment", "arm", "path", "score")


@register(
    "so3_nearest_k",
    with_ctes(
        "timed",
        """SELECT subject_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, event_type
        ORDER BY abs(value - 20), event_id) AS rn FROM timed) WHERE rn <= 2""",
    ),
)
def nearest(spark, sf):
    out = sm.nearest_k(b.timed_events(spark, sf), ["subject_id", "event_type"], "value", 20.0, 2, "event_id")
    return out.select("subject_id", "event_type", "event_id")


@register(
    "so4_errors_first",
    with_ctes(
        "pred",
        """SELECT sample_id, arm, label, round(probability, 10) + 0.0 AS probability, (probability >= 0.5) = (label = 1) AS is_correct FROM pred
        ORDER BY is_correct, sample_id""",
    ),
)
def errors(spark, sf):
    out = sm.errors_first(b.b_predictions(spark, sf), ["sample_id", "arm"])
    return out.select("sample_id", "arm", "label", r10("probability").alias("probability"), "is_correct")


@register(
    "se1_union_families",
    """SELECT 'customer' AS family, c_custkey AS id, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey, NULL FROM supplier""",
)
def union(spark, sf):
    c = b.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")
    )
    s = b.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")
    )
    return so.union_families({"customer": c, "supplier": s}).select("family", "id", "name", "nation", "segment")


@register(
    "se2_role_sets",
    """WITH cust AS (SELECT DISTINCT o_custkey AS k, o_custkey % 5 AS f FROM orders)
    SELECT 'roles are disjoint' AS "check", (SELECT count(*) FROM (SELECT k FROM cust WHERE f = 0 INTERSECT SELECT k FROM cust WHERE f <> 0)) AS violations, true AS passed
    UNION ALL SELECT 'roles cover all', (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT k FROM cust)),
    NOT EXISTS (SELECT c_custkey FROM customer EXCEPT SELECT k FROM cust)""",
)
def role_sets(spark, sf):
    cust = b.table(spark, sf, "orders").select(F.col("o_custkey").alias("subject_id")).distinct()
    test, rest = cust.filter("subject_id % 5 = 0"), cust.filter("subject_id % 5 <> 0")
    everyone = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id"))
    return so.role_sets_check({"test": test, "rest": rest}, everyone, "subject_id").select("check", "violations", "passed")


@register(
    "se3_set_difference",
    """SELECT 'left' AS side, k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
    UNION ALL SELECT 'right', k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def difference(spark, sf):
    orders = b.table(spark, sf, "orders")
    finished, open_ = (orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in ("F", "O"))
    return so.set_diff(finished, open_)


@register(
    "se4_duplicates",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicates(spark, sf):
    return so.duplicates(b.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register(
    "se5_common_keys",
    with_ctes("runlog", "SELECT experiment, arm FROM runlog WHERE status = 'F' INTERSECT SELECT experiment, arm FROM runlog WHERE status = 'O'"),
)
def common(spark, sf):
    runs = b.b_runs(spark, sf)
    return so.common_keys(runs.filter("status = 'F'"), runs.filter("status = 'O'"), ["experiment", "arm"])


# Both arms stand in one grouped row here, so nothing is joined.
_BOTH_ARMS = """SELECT max(l_suppkey) AS subject_id, l_orderkey || '_' || l_linenumber AS sample_id, CAST(bool_or(l_returnflag = 'R') AS INTEGER) AS label,
    round(((l_orderkey * 7919 + CAST(l_linenumber AS BIGINT) * 104729) % 1009) / 1009.0::DOUBLE, 10) + 0.0 AS probability_a,
    round(((l_orderkey * 15838 + CAST(l_linenumber AS BIGINT) * 104729) % 1009) / 1009.0::DOUBLE, 10) + 0.0 AS probability_b FROM lineitem GROUP BY l_orderkey, l_linenumber"""


@register("jn13_align_predictions", _BOTH_ARMS)
def aligned(spark, sf):
    p = b.b_predictions(spark, sf)
    out = jn.align_predictions(p.filter("arm = 'm1'"), p.filter("arm = 'm2'"), ["subject_id", "sample_id", "label"])
    return out.select("subject_id", "sample_id", "label", r10("probability_a").alias("probability_a"), r10("probability_b").alias("probability_b"))


@register(
    "jn13_alignment_report",
    with_ctes(
        "pred",
        """SELECT count(*) FILTER (x.k IS NOT NULL AND y.k IS NOT NULL) AS matched, count(*) FILTER (y.k IS NULL) AS only_left,
        count(*) FILTER (x.k IS NULL) AS only_right FROM (SELECT sample_id AS k FROM pred WHERE arm = 'm1' AND probability < 0.8) x
        FULL JOIN (SELECT sample_id AS k FROM pred WHERE arm = 'm2' AND probability > 0.1) y ON x.k = y.k""",
    ),
)
def report(spark, sf):
    p = b.b_predictions(spark, sf)
    return jn.alignment_report(p.filter("arm = 'm1' and probability < 0.8"), p.filter("arm = 'm2' and probability > 0.1"), ["sample_id"])


@register(
    "jn15_pending",
    with_ctes(
        "runlog",
        """SELECT experiment, arm FROM (SELECT DISTINCT experiment FROM runlog) CROSS JOIN (SELECT DISTINCT arm FROM runlog)
        EXCEPT SELECT experiment, arm FROM runlog WHERE status = 'F'""",
    ),
)
def pending(spark, sf):
    runs = b.b_runs(spark, sf)
    cells = jn.grid(runs.select("experiment").distinct(), runs.select("arm").distinct())
    return jn.pending(cells, runs.filter("status = 'F'"), ["experiment", "arm"])


@register(
    "jn17_experiment_grid",
    with_ctes(
        "results",
        """SELECT arm, classifier, protocol, fold FROM (SELECT DISTINCT arm FROM results), (SELECT DISTINCT classifier FROM results),
        (SELECT DISTINCT protocol FROM results), (SELECT DISTINCT fold FROM results)""",
    ),
)
def grid(spark, sf):
    r = b.b_results(spark, sf)
    return jn.grid(*[r.select(c).distinct() for c in CELL])


_TWO = ["accuracy", "f1"]


@register(
    "jn18_with_ci",
    with_ctes(
        "results",
        """SELECT arm, count(*) AS cells, round(avg(accuracy), 6) + 0.0 AS accuracy_subject_mean, round(min(accuracy), 6) + 0.0 AS accuracy_ci95_low,
        round(max(accuracy), 6) + 0.0 AS accuracy_ci95_high, round(avg(f1), 6) + 0.0 AS f1_subject_mean, round(min(f1), 6) + 0.0 AS f1_ci95_low,
        round(max(f1), 6) + 0.0 AS f1_ci95_high FROM scored GROUP BY arm""",
        SCORED,
    ),
)
def with_ci(spark, sf):
    cells = rounded_scores(spark, sf)
    long = cells.select("arm", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in _TWO])))
    ci = long.groupBy("arm", "metric").agg(
        F.avg("v").alias("subject_mean"), F.min("v").alias("ci95_low"), F.max("v").alias("ci95_high")
    )
    out = jn.with_ci(cells.groupBy("arm").agg(F.count("*").alias("cells")), ci, "arm", _TWO)
    return out.select("arm", "cells", *[r6(c).alias(c) for c in out.columns[2:]])


@register(
    "fn20_flatten_runs",
    """SELECT o_orderkey AS run_id, status, accuracy, seconds, "rows", best_validation_balanced_accuracy FROM (
    SELECT o_orderkey, o_orderstatus AS status, o_totalprice / 1000000 AS accuracy, CAST(o_custkey AS DOUBLE) AS seconds FROM orders)
    JOIN (SELECT l_orderkey, count(*) AS "rows", max(l_discount) AS best_validation_balanced_accuracy FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def flatten(spark, sf):
    lines = b.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(
        F.collect_list(F.struct(F.col("l_linenumber").alias("candidate"), F.col("l_discount").alias("validation_balanced_accuracy"))).alias("tuning"),
        F.struct(F.count("*").alias("rows")).alias("row_counts"),
    )
    orders = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderstatus").alias("status"),
        F.struct((F.col("o_totalprice") / 1000000.0).alias("accuracy")).alias("metrics"),
        F.struct(F.col("o_custkey").cast("double").alias("seconds")).alias("runtime"),
    )
    return sm.flatten_runs(orders.join(lines, "run_id")).select(
        "run_id", "status", "accuracy", "seconds", "rows", "best_validation_balanced_accuracy"
    )

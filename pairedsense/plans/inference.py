"""Bootstrap, interval and test queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import r6, r9
from ..functions.tails import t_p_value
from ..operators import metrics as mt
from ..operators import resample as rs
from ..operators import stats as st
from ..operators import summaries as sm
from ..session import stage
from . import bindings as b
from .oracle_ctes import NORMAL_TAIL, STEPS, SUBJECT_SQL, T_TAIL, with_ctes
from .registry import register
from .series import burden_table

METRICS = ["accuracy", "f1"]
ITERATIONS = 2000


# The mixer is spelled out step by step in CTEs, since a nested expression would repeat itself.
def mix_cte(name: str, source: str, expr: str, keep: str) -> str:
    m = 2147483647
    return f"""{name}_0 AS (SELECT {keep}, ({expr}) % {m} AS x FROM {source}),
{name}_1 AS (SELECT {keep}, (xor(x, x >> 16) * 73244475) % {m} AS x FROM {name}_0),
{name}_2 AS (SELECT {keep}, (xor(x, x >> 16) * 295559667) % {m} AS x FROM {name}_1),
{name} AS (SELECT {keep}, xor(x, x >> 15) % {m} AS x FROM {name}_2)"""


def draw_ctes(source: str, by: str) -> str:
    """Bootstrap draws over ``source`` (by, subject_id, accuracy, f1)."""
    keep = f"{by}, slot, n, iteration"
    return (
        f"""slots AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5('42|' || subject_id), subject_id) AS slot, count(*) OVER (PARTITION BY {by}) AS n FROM {source}),
its AS (SELECT {by}, slot, n, iteration FROM slots CROSS JOIN (SELECT unnest(range(0, {ITERATIONS})) AS iteration)),
"""
        + mix_cte("ha", "its", "iteration + 42 * 1000003", keep)
        + ",\n"
        + mix_cte("hb", "ha", "x + slot", keep)
        + f""",
drawn AS (SELECT h.{by}, h.iteration, avg(s.accuracy) AS accuracy, avg(s.f1) AS f1 FROM hb h JOIN slots s ON s.{by} = h.{by} AND s.slot = h.x % h.n + 1 GROUP BY h.{by}, h.iteration),
long AS (SELECT {by}, iteration, 'accuracy' AS metric, accuracy AS value FROM drawn UNION ALL SELECT {by}, iteration, 'f1', f1 FROM drawn)"""
    )


def subject_scores(spark, sf):
    return mt.binary_metrics(b.b_predictions(spark, sf), ["arm", "subject_id"]).select("arm", "subject_id", *METRICS)


@register(
    "st1_bootstrap_mean",
    with_ctes("pred", "SELECT arm, iteration, round(accuracy, 9) + 0.0 AS accuracy, round(f1, 9) + 0.0 AS f1 FROM drawn", SUBJECT_SQL + "," + draw_ctes("subj", "arm")),
)
def bootstrap(spark, sf):
    out = rs.draws(subject_scores(spark, sf), ["arm"], "subject_id", METRICS, ITERATIONS, b.SEED)
    return out.select("arm", "iteration", *[r9(m).alias(m) for m in METRICS])


_DIFF = SUBJECT_SQL + """, diff AS (SELECT 'm1-m2' AS pair, subject_id, x.accuracy - y.accuracy AS accuracy, x.f1 - y.f1 AS f1 FROM subj x JOIN subj y USING (subject_id)
    WHERE x.arm = 'm1' AND y.arm = 'm2'),"""


@register(
    "st2_bootstrap_diff",
    with_ctes("pred", "SELECT iteration, round(accuracy, 9) + 0.0 AS accuracy, round(f1, 9) + 0.0 AS f1 FROM drawn", _DIFF + draw_ctes("diff", "pair")),
)
def bootstrap_diff(spark, sf):
    s = subject_scores(spark, sf)
    out = rs.bootstrap_diff(s.filter("arm = 'm1'"), s.filter("arm = 'm2'"), "subject_id", METRICS, ITERATIONS, b.SEED)
    return out.select("iteration", *[r9(m).alias(m) for m in METRICS])


@register(
    "st3_interval",
    with_ctes(
        "pred",
        """SELECT arm, metric, round(avg(value), 7) + 0.0 AS mean, round(stddev_samp(value), 7) + 0.0 AS std, round(quantile_cont(value, 0.025), 7) + 0.0 AS ci95_low,
        round(quantile_cont(value, 0.975), 7) + 0.0 AS ci95_high, count(*) AS iterations FROM long GROUP BY arm, metric""",
        SUBJECT_SQL + "," + draw_ctes("subj", "arm"),
    ),
)
def interval(spark, sf):
    drawn = rs.draws(subject_scores(spark, sf), ["arm"], "subject_id", METRICS, ITERATIONS, b.SEED)
    out = rs.interval(rs.long_draws(drawn, ["arm"], METRICS), ["arm", "metric"])
    return out.select("arm", "metric", *[(F.round(c, 7) + 0.0).alias(c) for c in ("mean", "std", "ci95_low", "ci95_high")], "iterations")


VERDICT_SQL = """round(avg(value), 7) + 0.0 AS mean_difference, round(quantile_cont(value, 0.025), 7) + 0.0 AS ci95_low, round(quantile_cont(value, 0.975), 7) + 0.0 AS ci95_high,
    round(least(1, 2 * least(avg(CASE WHEN value <= 0 THEN 1.0::DOUBLE ELSE 0 END), avg(CASE WHEN value >= 0 THEN 1.0::DOUBLE ELSE 0 END))), 9) + 0.0 AS p_value,
    CASE WHEN quantile_cont(value, 0.025) > 0 OR quantile_cont(value, 0.975) < 0 THEN 'CI excludes zero' ELSE 'CI includes zero' END AS interpretation"""


@register(
    "st4_verdict",
    with_ctes("pred", f"SELECT metric, {VERDICT_SQL} FROM long GROUP BY metric", _DIFF + draw_ctes("diff", "pair")),
)
def verdict(spark, sf):
    s = subject_scores(spark, sf)
    drawn = rs.bootstrap_diff(s.filter("arm = 'm1'"), s.filter("arm = 'm2'"), "subject_id", METRICS, ITERATIONS, b.SEED)
    out = rs.verdict(rs.long_draws(drawn, [], METRICS), ["metric"])
    return out.select(
        "metric", *[(F.round(c, 7) + 0.0).alias(c) for c in ("mean_difference", "ci95_low", "ci95_high")], r9("p_value").alias("p_value"), "interpretation"
    )


def arms(spark, sf):
    """Four complete arms by device, and one without its last fold."""
    own = F.concat_ws("/", "arm", "device")
    also = F.expr("arm = 'm1' and device = 'R' and fold < 4")
    return b.b_predictions(spark, sf).withColumn("arm", F.explode(F.when(also, F.array(own, F.lit("m3/R"))).otherwise(F.array(own))))


SPECS = [
    ("m1_vs_m2_R", "m1/R", "m2/R"),
    ("m1_vs_m2_S", "m1/S", "m2/S"),
    ("m1_R_vs_S", "m1/R", "m1/S"),
    ("m3_vs_m1_R", "m3/R", "m1/R"),
    ("m4_vs_m1_R", "m4/R", "m1/R"),
]


def compared(spark, sf):
    specs = spark.createDataFrame(SPECS, "comparison string, left string, right string")
    return rs.compare_all(arms(spark, sf), specs, METRICS, b.N_FOLDS, iterations=ITERATIONS, seed=b.SEED)


_COMPARE = (
    SUBJECT_SQL.replace("subj AS", "subj0 AS").replace("SELECT arm, subject_id", "SELECT arm || '/' || device AS a, subject_id").replace("GROUP BY arm, subject_id", "GROUP BY arm, device, subject_id")
    + """, diff AS (SELECT CASE WHEN x.a = 'm1/R' THEN 'm1_vs_m2_R' ELSE 'm1_vs_m2_S' END AS comparison, subject_id, x.accuracy - y.accuracy AS accuracy, x.f1 - y.f1 AS f1
    FROM subj0 x JOIN subj0 y USING (subject_id) WHERE (x.a = 'm1/R' AND y.a = 'm2/R') OR (x.a = 'm1/S' AND y.a = 'm2/S')),"""
    + draw_ctes("diff", "comparison")
)


@register(
    "st5_compare_all",
    with_ctes("pred", f"SELECT comparison, metric, {VERDICT_SQL} FROM long GROUP BY comparison, metric", _COMPARE),
)
def compare_all(spark, sf):
    out, _ = compared(spark, sf)
    return out.select(
        "comparison",
        "metric",
        *[(F.round(c, 7) + 0.0).alias(c) for c in ("mean_difference", "ci95_low", "ci95_high")],
        r9("p_value").alias("p_value"),
        "interpretation",
    )


@register(
    "st5_skipped_comparisons",
    with_ctes(
        "pred",
        """SELECT comparison, 'incomplete folds' AS reason FROM short UNION ALL SELECT DISTINCT comparison, 'prediction sets do not align' FROM uneven
        WHERE comparison NOT IN (SELECT comparison FROM short)""",
        """armed AS (SELECT arm || '/' || device AS a, subject_id, sample_id, label, fold FROM pred UNION ALL
            SELECT 'm3/R', subject_id, sample_id, label, fold FROM pred WHERE arm = 'm1' AND device = 'R' AND fold < 4),
        specs AS (SELECT * FROM (VALUES ('m1_vs_m2_R', 'm1/R', 'm2/R'), ('m1_vs_m2_S', 'm1/S', 'm2/S'), ('m1_R_vs_S', 'm1/R', 'm1/S'),
            ('m3_vs_m1_R', 'm3/R', 'm1/R'), ('m4_vs_m1_R', 'm4/R', 'm1/R')) AS t(comparison, l, r)),
        short AS (SELECT comparison FROM specs WHERE (SELECT count(DISTINCT fold) FROM armed WHERE a = l) < 5 OR (SELECT count(DISTINCT fold) FROM armed WHERE a = r) < 5),
        uneven AS (SELECT comparison FROM specs s JOIN armed x ON x.a = s.l WHERE NOT EXISTS (SELECT 1 FROM armed y WHERE y.a = s.r AND y.sample_id = x.sample_id AND y.label = x.label))""",
    ),
)
def skipped(spark, sf):
    specs = spark.createDataFrame(SPECS, "comparison string, left string, right string")
    keys = ["subject_id", "sample_id", "label"]
    rows = stage(arms(spark, sf).select("arm", "fold", *keys), "arms")
    return rs.skipped(rows, specs, b.N_FOLDS, keys).select("comparison", "reason")


@register(
    "ag28_significance_tally",
    with_ctes(
        "pred",
        f"""SELECT regime, metric, count(*) AS n, round(avg(mean_difference), 6) + 0.0 AS mean_difference, count(*) FILTER (interpretation = 'CI excludes zero') AS excludes_zero,
        count(*) FILTER (ci95_low > 0) AS positive, count(*) FILTER (ci95_high < 0) AS negative FROM (SELECT right(comparison, 1) AS regime, metric, {VERDICT_SQL.replace("round(avg(value), 7) + 0.0", "avg(value)")} FROM long GROUP BY comparison, metric)
        GROUP BY regime, metric""",
        _COMPARE,
    ),
)
def tally(spark, sf):
    out, _ = compared(spark, sf)
    rows = out.withColumn("regime", F.substring("comparison", -1, 1))
    return sm.significance_tally(rows, ["regime", "metric"]).withColumn("mean_difference", r6("mean_difference"))


# ---------------------------------------------------------------- tests on device pairs

PAIR_CTES = """means AS (SELECT subject_id, avg(r) AS r, avg(s) AS s, avg(r) - avg(s) AS d FROM pairs GROUP BY subject_id)"""


def paired_means(spark, sf):
    p = b.b_device_pairs(spark, sf).groupBy("subject_id").agg(F.avg("r").alias("r"), F.avg("s").alias("s"))
    return p.withColumn("d", F.col("r") - F.col("s"))


def grouped_means(spark, sf):
    return paired_means(spark, sf).withColumn("g", (F.col("subject_id") % 3).cast("int"))


@register(
    "st6_t_moments",
    with_ctes("pairs", "SELECT CAST(subject_id % 3 AS INTEGER) AS g, count(d) AS n, round(avg(d), 6) + 0.0 AS mean, round(stddev_samp(d), 6) + 0.0 AS std FROM means GROUP BY 1", PAIR_CTES),
)
def t_moments(spark, sf):
    return st.moments(grouped_means(spark, sf), ["g"], "d").select("g", "n", r6("mean").alias("mean"), r6("std").alias("std"))


@register(
    "st6_t_interval",
    with_ctes(
        "pairs",
        """SELECT CAST(subject_id % 3 AS INTEGER) AS g, count(d) AS n, round(avg(d), 6) + 0.0 AS mean, CAST(0.05 AS DOUBLE) AS tail_at_high, CAST(0.05 AS DOUBLE) AS tail_at_low FROM means GROUP BY 1""",
        PAIR_CTES,
    ),
)
def t_interval(spark, sf):
    """The limits stand where a t test of the distance to the mean has a tail of 0.05."""
    out = st.t_interval(grouped_means(spark, sf), ["g"], "d")
    error = F.col("std") / F.sqrt("n")
    tail = lambda limit: r6(t_p_value((F.col(limit) - F.col("mean")) / error, F.col("n") - 1))
    return out.select("g", "n", r6("mean").alias("mean"), tail("ci95_high").alias("tail_at_high"), tail("ci95_low").alias("tail_at_low"))


@register(
    "st7_paired_t_statistic",
    with_ctes("pairs", "SELECT CAST(subject_id % 3 AS INTEGER) AS g, count(d) AS n, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) + 0.0 AS t FROM means GROUP BY 1", PAIR_CTES),
)
def t_statistic(spark, sf):
    return st.paired_t_statistic(grouped_means(spark, sf), ["g"], "d").select("g", "n", r6("t").alias("t"))


@register(
    "st7_paired_t",
    with_ctes(
        "pairs",
        f"SELECT g, any_value(n) AS n, round(any_value(t), 6) + 0.0 AS t, round({T_TAIL}, 7) + 0.0 AS p_value FROM s {STEPS} GROUP BY g",
        PAIR_CTES + """, s AS (SELECT CAST(subject_id % 3 AS INTEGER) AS g, count(d) AS n, avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t FROM means GROUP BY 1)""",
    ),
)
def paired_t(spark, sf):
    out = st.paired_t(grouped_means(spark, sf), ["g"], "d")
    return out.select("g", "n", r6("t").alias("t"), (F.round("p_value", 7) + 0.0).alias("p_value"))


_WILCOXON = PAIR_CTES + """, nz AS (SELECT CAST(subject_id % 3 AS INTEGER) AS g, floor(d * 4) / 4 AS d FROM means WHERE floor(d * 4) <> 0),
    rk AS (SELECT g, d, rank() OVER (PARTITION BY g ORDER BY abs(d)) + (count(*) OVER (PARTITION BY g, abs(d)) - 1) / 2.0::DOUBLE AS r FROM nz)"""


@register(
    "st8_wilcoxon_statistic",
    with_ctes(
        "pairs",
        """SELECT g, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END)::DOUBLE AS w_minus,
        least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END))::DOUBLE AS statistic FROM rk GROUP BY g""",
        _WILCOXON,
    ),
)
def wilcoxon_statistic(spark, sf):
    rounded = grouped_means(spark, sf).withColumn("d", F.floor(F.col("d") * 4) / 4.0)
    return st.wilcoxon_statistic(rounded, ["g"], "d").select("g", "n", "w_plus", "w_minus", "statistic")


@register(
    "st8_wilcoxon",
    with_ctes(
        "pairs",
        f"SELECT g, any_value(n) AS n, any_value(w) AS statistic, round(any_value(-z), 6) + 0.0 AS z, round({NORMAL_TAIL}, 7) + 0.0 AS p_value FROM zs {STEPS} GROUP BY g",
        _WILCOXON
        + """, ties AS (SELECT g, sum(c * c * c - c) AS ties FROM (SELECT g, CAST(count(*) AS DOUBLE) AS c FROM rk GROUP BY g, abs(d)) GROUP BY g),
        ws AS (SELECT g, count(*) AS n, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0))::DOUBLE AS w FROM rk GROUP BY g),
        zs AS (SELECT g, n, w, (n * (n + 1) / 4.0::DOUBLE - w) / sqrt((CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM ws JOIN ties USING (g))""",
    ),
)
def wilcoxon(spark, sf):
    """By the normal approximation with its tie correction; the exact form is tested against printed tables."""
    out = st.wilcoxon(grouped_means(spark, sf).withColumn("d", F.floor(F.col("d") * 4) / 4.0), ["g"], "d", "normal")
    return out.select("g", "n", "statistic", r6("z").alias("z"), (F.round("p_value", 7) + 0.0).alias("p_value"))


def device_values(spark, sf):
    return b.b_devices(spark, sf).select("device", F.col("value"), (F.col("subject_id") % 3).cast("int").alias("g"))


@register(
    "st9_mann_whitney_statistic",
    with_ctes(
        "devices",
        """SELECT g, count(*) FILTER (device = 'R') AS n1, count(*) FILTER (device = 'S') AS n2,
        (sum(r) FILTER (device = 'R') - count(*) FILTER (device = 'R') * (count(*) FILTER (device = 'R') + 1) / 2)::DOUBLE AS u FROM (
        SELECT CAST(subject_id % 3 AS INTEGER) AS g, device, rank() OVER (PARTITION BY subject_id % 3 ORDER BY value) + (count(*) OVER (PARTITION BY subject_id % 3, value) - 1) / 2.0::DOUBLE AS r FROM devices) GROUP BY g""",
    ),
)
def mw_statistic(spark, sf):
    return st.mann_whitney_statistic(device_values(spark, sf), ["g"], "device", "R", "value").select("g", "n1", "n2", "u")


@register(
    "st9_mann_whitney",
    with_ctes(
        "devices",
        f"SELECT g, round(any_value(z), 6) + 0.0 AS z, round({NORMAL_TAIL}, 7) + 0.0 AS p_value FROM scored {STEPS} GROUP BY g",
        """rk AS (SELECT CAST(subject_id % 3 AS INTEGER) AS g, device, value, rank() OVER (PARTITION BY subject_id % 3 ORDER BY value) + (count(*) OVER (PARTITION BY subject_id % 3, value) - 1) / 2.0::DOUBLE AS r FROM devices),
        tied AS (SELECT g, sum(pow(c, 3) - c) AS ties FROM (SELECT g, value, CAST(count(*) AS DOUBLE) AS c FROM rk GROUP BY 1, 2) GROUP BY g),
        us AS (SELECT g, CAST(count(*) FILTER (device = 'R') AS DOUBLE) AS n, CAST(count(*) FILTER (device = 'S') AS DOUBLE) AS m, sum(r) FILTER (device = 'R') AS rs FROM rk GROUP BY g),
        scored AS (SELECT g, greatest((abs(rs - n * (n + 1) / 2 - n * m / 2) - 0.5::DOUBLE) / sqrt(n * m / 12 * (n + m + 1 - ties / ((n + m) * (n + m - 1)))), 0) AS z FROM us JOIN tied USING (g))""",
    ),
)
def mw(spark, sf):
    out = st.mann_whitney(device_values(spark, sf), ["g"], "device", "R", "value")
    return out.select("g", r6("z").alias("z"), (F.round("p_value", 7) + 0.0).alias("p_value"))


@register(
    "st10_cliffs_delta",
    with_ctes(
        "devices",
        """SELECT g, round((gt - lt) / (CAST(n AS DOUBLE) * m), 9) + 0.0 AS cliffs_delta FROM (SELECT r.g, sum(CASE WHEN r.value > s.value THEN 1 ELSE 0 END) AS gt,
        sum(CASE WHEN r.value < s.value THEN 1 ELSE 0 END) AS lt, count(DISTINCT r.k) AS n, count(DISTINCT s.k) AS m FROM
        (SELECT CAST(subject_id % 3 AS INTEGER) AS g, subject_id * 1000 + day AS k, value FROM devices WHERE device = 'R') r JOIN
        (SELECT CAST(subject_id % 3 AS INTEGER) AS g, subject_id * 1000 + day AS k, value FROM devices WHERE device = 'S') s USING (g) GROUP BY r.g)""",
    ),
)
def cliffs(spark, sf):
    out = st.mann_whitney_statistic(device_values(spark, sf), ["g"], "device", "R", "value")
    return out.select("g", r9("cliffs_delta").alias("cliffs_delta"))


@register(
    "st11_theil_sen",
    with_ctes(
        "anchors rec",
        """SELECT l.subject_id, count(*) AS points, round(any_value(slope) * 3600, 6) + 0.0 AS drift_per_hour, round(median(y) - any_value(slope) * median(x), 6) + 0.0 AS intercept,
        round(max(abs(y - icpt - slope * x)), 6) + 0.0 AS max_residual FROM (SELECT p.*, s.slope, median(y) OVER (PARTITION BY p.subject_id) - s.slope * median(x) OVER (PARTITION BY p.subject_id) AS icpt
        FROM pts p JOIN (SELECT a.subject_id, median((b.y - a.y) / (b.x - a.x)) AS slope FROM pts a JOIN pts b ON b.subject_id = a.subject_id AND b.x > a.x GROUP BY 1) s ON s.subject_id = p.subject_id) l GROUP BY l.subject_id""",
        """pts AS (SELECT a.subject_id, CAST(floor(t / (common_sec / 5)) AS BIGINT) AS k, avg(t) AS x, avg(lag) AS y FROM anchors a JOIN rec r USING (subject_id)
        WHERE floor(t / (common_sec / 5)) BETWEEN 0 AND 4 GROUP BY 1, 2)""",
    ),
)
def theil_sen(spark, sf):
    rec = b.b_recordings(spark, sf).select("subject_id", "common_sec")
    rows = b.b_anchors(spark, sf).join(rec, "subject_id").withColumn("k", F.floor(F.col("t") / (F.col("common_sec") / 5)).cast("long"))
    five = rows.filter(F.col("k").between(0, 4)).groupBy("subject_id", "k").agg(F.avg("t").alias("t"), F.avg("lag").alias("lag"))
    out = st.theil_sen(five, ["subject_id"], "t", "lag")
    return out.select("subject_id", "points", *[r6(c).alias(c) for c in ("drift_per_hour", "intercept", "max_residual")])


@register(
    "st11_alignment_models",
    with_ctes(
        "anchors",
        """SELECT k.subject_id, anchors, reliable AS reliable_anchors, n AS points, round(med, 6) + 0.0 AS median_correlation, round(slope * 3600, 6) + 0.0 AS drift_per_hour,
        round(worst, 6) + 0.0 AS max_residual, reliable < 3 OR med < 0.45 OR worst > 2 AS low_confidence
        FROM known k JOIN (SELECT f.subject_id, count(*) AS n, any_value(f.slope) AS slope, max(abs(f.lag - f.icpt - f.slope * f.t)) AS worst FROM fitted f GROUP BY f.subject_id) z USING (subject_id)""",
        """known AS (SELECT subject_id, count(*) AS anchors, count(*) FILTER (correlation >= 0.45) AS reliable, median(correlation) AS med FROM anchors GROUP BY 1),
        used AS (SELECT a.subject_id, t, lag FROM anchors a JOIN known USING (subject_id) WHERE correlation >= 0.45 OR reliable < 3),
        slopes AS (SELECT a.subject_id, median((b.lag - a.lag) / (b.t - a.t)) AS slope FROM used a JOIN used b ON b.subject_id = a.subject_id AND b.t > a.t GROUP BY 1),
        fitted AS (SELECT u.*, slope, median(lag) OVER (PARTITION BY u.subject_id) - slope * median(t) OVER (PARTITION BY u.subject_id) AS icpt FROM used u JOIN slopes USING (subject_id))""",
    ),
)
def alignment_models(spark, sf):
    out = st.alignment_models(b.b_anchors(spark, sf), ["subject_id"])
    return out.select(
        "subject_id", "anchors", "reliable_anchors", "points", *[r6(c).alias(c) for c in ("median_correlation", "drift_per_hour", "max_residual")], "low_confidence"
    )


@register(
    "ag24_subject_means",
    with_ctes(
        "devices",
        """SELECT device, count(*) AS subjects, round(avg(m), 6) + 0.0 AS mean, round(stddev_samp(m) / sqrt(count(*)), 6) + 0.0 AS sem FROM
        (SELECT subject_id, device, avg(value) AS m FROM devices GROUP BY 1, 2) GROUP BY device""",
    ),
)
def means(spark, sf):
    out = sm.mean_and_sem(sm.subject_means(b.b_devices(spark, sf), "value"), ["device"])
    return out.select("device", "subjects", r6("mean").alias("mean"), r6("sem").alias("sem"))


@register(
    "ag25_correlate",
    with_ctes(
        "series awake_merged runs ann",
        "SELECT round(corr(event_index, n), 6) + 0.0 AS pearson, count(*) AS n FROM idx JOIN (SELECT subject_id, CAST(count(*) AS DOUBLE) AS n FROM ann GROUP BY 1) USING (subject_id)",
        """span AS (SELECT subject_id, min(t) AS lo, max(t) AS hi, count(*) AS n FROM series GROUP BY subject_id),
        cover AS (SELECT s.subject_id, coalesce(sum(CASE WHEN m.e > s.lo AND m.s < s.hi THEN least(m.e, s.hi) - greatest(m.s, s.lo) END), 0) AS sec
            FROM span s LEFT JOIN awake_merged m ON m.subject_id = s.subject_id GROUP BY s.subject_id),
        hours AS (SELECT subject_id, (hi - lo) / 3600 - sec / 3600 AS h FROM span JOIN cover USING (subject_id) WHERE n >= 10),
        idx AS (SELECT h.subject_id, count(r.s) / h.h AS event_index FROM hours h LEFT JOIN runs r ON r.subject_id = h.subject_id WHERE h.h > 0 GROUP BY h.subject_id, h.h)""",
    ),
)
def correlate(spark, sf):
    counts = b.b_annotation(spark, sf).groupBy("subject_id").agg(F.count("*").cast("double").alias("events"))
    joined = burden_table(spark, sf).join(counts, "subject_id")
    return sm.correlate(joined, "event_index", "events").select(r6("pearson").alias("pearson"), "n")

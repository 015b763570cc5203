"""Epochs, window manifests, alignment mapping, splits and integrity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import r6, r9, severity_bin, stable_id
from ..operators import checks as ck
from ..operators import intervals as iv
from ..operators import joins as jn
from ..operators import negatives as ng
from ..operators import series as se
from ..operators import splits as sp
from ..operators import summaries as sm
from ..session import stage
from . import bindings as b
from .oracle_ctes import with_ctes
from .registry import register
from .series import detected_runs, flagged_events, masked_series, merged_awake

KEY = ["subject_id"]

# ---------------------------------------------------------------- epochs

_EPOCH = """
span AS (SELECT subject_id, max(t) AS fin, CAST(ceil(max(t) / 86400) AS BIGINT) AS n FROM series GROUP BY subject_id HAVING count(*) >= 10 AND max(t) > 0),
grid AS (SELECT subject_id, fin, n, unnest(range(0, n)) AS epoch FROM span),
hitc AS (SELECT r.subject_id, least(CAST(floor(r.s / 86400) AS BIGINT), n - 1) AS epoch, count(*) AS c, sum(area) AS a FROM runs r JOIN span USING (subject_id) WHERE r.s >= 0 GROUP BY 1, 2),
share AS (SELECT m.subject_id, least(CAST(floor(m.t / 86400) AS BIGINT), n - 1) AS epoch, avg(CASE WHEN masked THEN 1.0::DOUBLE ELSE 0 END) AS f FROM masked_series m JOIN span USING (subject_id) WHERE m.t >= 0 GROUP BY 1, 2),
ep AS (SELECT g.subject_id, g.epoch * 86400.0::DOUBLE AS b, least((g.epoch + 1) * 86400.0::DOUBLE, fin) AS f2, coalesce(c, 0) AS c, coalesce(a, 0) AS a, coalesce(f, 1.0::DOUBLE) AS f
    FROM grid g LEFT JOIN hitc h ON h.subject_id = g.subject_id AND h.epoch = g.epoch LEFT JOIN share s ON s.subject_id = g.subject_id AND s.epoch = g.epoch)
"""


def epochs(spark, sf):
    return se.epoch_targets(masked_series(spark, sf), detected_runs(spark, sf), KEY, b.EPOCH)


@register(
    "ag3_epoch_targets",
    with_ctes(
        "runs masked_series",
        """SELECT subject_id, round(b, 6) + 0.0 AS epoch_start_sec, round(f2, 6) + 0.0 AS epoch_end_sec, c AS run_count, round(a / 60, 3) + 0.0 AS area_min,
        round(c * 3600 / (f2 - b), 9) + 0.0 AS hourly_rate, CASE WHEN c * 3600 / (f2 - b) < 5 THEN 'normal' WHEN c * 3600 / (f2 - b) < 15 THEN 'mild'
        WHEN c * 3600 / (f2 - b) < 30 THEN 'moderate' ELSE 'severe' END AS severity_bin, round(f, 9) + 0.0 AS masked_fraction, f >= 0.5 AS excluded_from_training FROM ep WHERE f2 > b""",
        _EPOCH,
    ),
)
def epoch_targets(spark, sf):
    return epochs(spark, sf).select(
        "subject_id",
        r6("epoch_start_sec").alias("epoch_start_sec"),
        r6("epoch_end_sec").alias("epoch_end_sec"),
        "run_count",
        (F.round("area_min", 3) + 0.0).alias("area_min"),
        r9("hourly_rate").alias("hourly_rate"),
        "severity_bin",
        r9("masked_fraction").alias("masked_fraction"),
        "excluded_from_training",
    )


@register(
    "jn9_epoch_manifest",
    with_ctes(
        "runs masked_series rec",
        """SELECT 'SW_' || subject_id || '_' || device || '_' || CAST(b AS BIGINT) AS sample_id, 'SW_' || subject_id || '_' || CAST(b AS BIGINT) AS logical_window_id,
        subject_id, device, c AS run_count FROM ep JOIN (SELECT subject_id, 'R' AS device, recorder_sec AS avail FROM rec UNION ALL
        SELECT subject_id, 'S', phone_sec FROM rec) USING (subject_id) WHERE f2 > b AND f2 <= avail""",
        _EPOCH,
    ),
)
def epoch_manifest(spark, sf):
    templates = b.b_recordings(spark, sf).select(
        "subject_id",
        F.inline(
            F.array(
                F.struct(F.lit("R").alias("device"), F.col("recorder_sec").alias("available_sec")),
                F.struct(F.lit("S").alias("device"), F.col("phone_sec").alias("available_sec")),
            )
        ),
    )
    out = jn.epoch_manifest(epochs(spark, sf), templates, "subject_id")
    return out.select("sample_id", "logical_window_id", "subject_id", "device", "run_count")


PRE, POST = 864000.0, 432000.0

_NADIR = f"""
pre AS (SELECT a.subject_id, a.event_id, max(x.v) AS baseline, count(*) AS n FROM ann a JOIN series x ON x.subject_id = a.subject_id
    AND x.t >= a.e - {PRE} AND x.t < a.e GROUP BY 1, 2 HAVING count(*) >= 10),
post AS (SELECT a.subject_id, a.event_id, a.event_type, a.e, x.t, x.v, row_number() OVER (PARTITION BY a.subject_id, a.event_id ORDER BY x.v, x.t) AS rn,
    count(*) OVER (PARTITION BY a.subject_id, a.event_id) AS n, max(x.t) OVER (PARTITION BY a.subject_id, a.event_id) AS lastt
    FROM ann a JOIN series x ON x.subject_id = a.subject_id AND x.t >= a.e AND x.t < a.e + {POST}),
nadir AS (SELECT p.subject_id, p.event_id, p.event_type, baseline, p.v AS nadir, p.t - p.e AS delay_sec, baseline - p.v AS amplitude, p.t = p.lastt AS at_boundary
    FROM post p JOIN pre q ON q.subject_id = p.subject_id AND q.event_id = p.event_id WHERE p.rn = 1 AND p.n >= 5)
"""


def nadirs(spark, sf):
    return se.event_nadir(b.b_annotation(spark, sf), b.b_series(spark, sf), KEY, PRE, POST)


@register(
    "wn8_event_nadir",
    with_ctes(
        "ann series",
        "SELECT subject_id, event_id, event_type, baseline, nadir, round(delay_sec, 6) + 0.0 AS delay_sec, round(amplitude, 6) + 0.0 AS amplitude, at_boundary FROM nadir",
        _NADIR,
    ),
)
def event_nadir(spark, sf):
    return nadirs(spark, sf).select(
        "subject_id", "event_id", "event_type", "baseline", "nadir", r6("delay_sec").alias("delay_sec"), r6("amplitude").alias("amplitude"), "at_boundary"
    )


@register(
    "ag6_timing_summary",
    with_ctes(
        "ann series",
        """SELECT event_type, count(*) AS n, round(avg(delay_sec), 4) + 0.0 AS delay_mean, round(avg(amplitude), 6) + 0.0 AS amplitude_mean,
        round(avg(CASE WHEN amplitude >= 3 THEN 1.0::DOUBLE ELSE 0 END), 9) + 0.0 AS share_ge_3, round(avg(CASE WHEN at_boundary THEN 1.0::DOUBLE ELSE 0 END), 9) + 0.0 AS share_at_boundary,
        round(quantile_cont(delay_sec, 0.5), 5) + 0.0 AS delay_median, round(quantile_cont(delay_sec, 0.1), 5) + 0.0 AS delay_p10, round(quantile_cont(delay_sec, 0.9), 5) + 0.0 AS delay_p90,
        round(quantile_cont(delay_sec, 0.95), 5) + 0.0 AS delay_p95, round(quantile_cont(amplitude, 0.5), 5) + 0.0 AS amplitude_median,
        round(quantile_cont(amplitude, 0.9), 5) + 0.0 AS amplitude_p90 FROM nadir GROUP BY event_type""",
        _NADIR,
    ),
)
def timing(spark, sf):
    out = sm.timing_summary(stage(nadirs(spark, sf), "nadir"))
    five = ("delay_median", "delay_p10", "delay_p90", "delay_p95", "amplitude_median", "amplitude_p90")
    return out.select(
        "event_type",
        "n",
        (F.round("delay_mean", 4) + 0.0).alias("delay_mean"),
        r6("amplitude_mean").alias("amplitude_mean"),
        r9("share_ge_3").alias("share_ge_3"),
        r9("share_at_boundary").alias("share_at_boundary"),
        *[(F.round(c, 5) + 0.0).alias(c) for c in five],
    )


@register(
    "wn11_views",
    with_ctes(
        "rec timed awake_pos",
        f"""SELECT view_id, subject_id, round(min(t), 6) + 0.0 AS start_sec, round(max(t), 6) + 0.0 AS end_sec, round(max(d), 6) + 0.0 AS max_drop FROM isl
        WHERE view_id IN (SELECT view_id FROM vs GROUP BY view_id HAVING count(*) >= 10)
        GROUP BY view_id, subject_id, grp HAVING max(t) - min(t) >= 86400 AND min(t) <= any_value(hi) AND max(t) >= any_value(lo)""",
        """
        req AS (SELECT subject_id, subject_id * 10 + k AS view_id, common_sec * k / 3.0::DOUBLE AS lo, common_sec * (k + 1) / 3.0::DOUBLE AS hi FROM rec CROSS JOIN (VALUES (0), (1), (2)) AS x(k)),
        vs AS (SELECT r.view_id, r.subject_id, r.lo, r.hi, x.t, x.value AS v, EXISTS (SELECT 1 FROM awake_pos w WHERE w.subject_id = x.subject_id AND x.t >= w.s AND x.t <= w.e) AS masked
            FROM req r JOIN timed x ON x.subject_id = r.subject_id AND x.t >= r.lo - 172800 AND x.t <= r.hi + 172800),
        vb AS (SELECT *, max(v) OVER (PARTITION BY view_id ORDER BY t RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW) AS baseline FROM vs),
        vh AS (SELECT *, baseline - v AS d, row_number() OVER (PARTITION BY view_id ORDER BY t) AS rn FROM vb),
        isl AS (SELECT *, rn - row_number() OVER (PARTITION BY view_id ORDER BY t) AS grp FROM vh WHERE baseline - v >= 30 AND NOT masked)""",
    ),
)
def views(spark, sf):
    rec = b.b_recordings(spark, sf)
    third = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    req = rec.select("subject_id", "common_sec", third).select(
        "subject_id",
        (F.col("subject_id") * 10 + F.col("k")).alias("view_id"),
        (F.col("common_sec") * F.col("k") / 3.0).alias("lo"),
        (F.col("common_sec") * (F.col("k") + 1) / 3.0).alias("hi"),
    )
    _, runs = se.views(
        b.b_series(spark, sf),
        merged_awake(spark, sf),
        req,
        "subject_id",
        172800.0,
        b.BIN,
        drop=b.DROP,
        min_duration=b.MIN_DURATION,
        window=b.WINDOW,
        chunk_seconds=b.BIN,
    )
    return runs.select("view_id", "subject_id", r6("start").alias("start_sec"), r6("end").alias("end_sec"), r6("max_drop").alias("max_drop"))


# ---------------------------------------------------------------- manifest

NEGATIVE_CTES = """
elig AS (SELECT a.subject_id, a.event_id, a.event_type, a.s, a.e, a.e - a.s AS d FROM ann a JOIN rec r USING (subject_id) WHERE a.s >= 0 AND a.e <= r.common_sec AND a.e > a.s),
blocked AS (SELECT b.subject_id, greatest(b.s, 0) AS s, least(b.e, r.common_sec) AS e FROM (SELECT subject_id, s, e FROM awake UNION ALL SELECT subject_id, s, e FROM ann) b
    JOIN rec r USING (subject_id) WHERE b.e > 0 AND b.s < r.common_sec AND least(b.e, r.common_sec) > greatest(b.s, 0)),
edges AS (SELECT subject_id, 0.0::DOUBLE AS x FROM rec UNION SELECT subject_id, e FROM blocked),
stops AS (SELECT subject_id, common_sec AS x FROM rec UNION SELECT subject_id, s FROM blocked),
free0 AS (SELECT g.subject_id, g.x AS gs, (SELECT min(z.x) FROM stops z WHERE z.subject_id = g.subject_id AND z.x >= g.x) AS ge FROM edges g
    WHERE NOT EXISTS (SELECT 1 FROM blocked c WHERE c.subject_id = g.subject_id AND c.s <= g.x AND c.e > g.x)),
free AS (SELECT *, ge - gs AS len FROM free0 WHERE ge > gs),
cand AS (SELECT e.*, f.gs, greatest(len - d, 0) AS slack, greatest(len - d, 0) + 1e-6 AS w,
    sum(greatest(len - d, 0) + 1e-6) OVER (PARTITION BY e.subject_id, e.event_id ORDER BY len DESC, gs ROWS UNBOUNDED PRECEDING) AS cum,
    sum(greatest(len - d, 0) + 1e-6) OVER (PARTITION BY e.subject_id, e.event_id) AS tot,
    CAST(('0x' || substr(md5('42:0|' || e.subject_id || '|' || e.event_id), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
    FROM elig e JOIN free f ON f.subject_id = e.subject_id AND len - d >= -1e-9),
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, event_id ORDER BY cum) AS rn FROM cand WHERE cum >= u * tot) WHERE rn = 1),
neg0 AS (SELECT subject_id, event_id, event_type, s, e, gs + least(greatest((u * tot - (cum - w)) / w, 0), 1) * slack AS ns,
    gs + least(greatest((u * tot - (cum - w)) / w, 0), 1) * slack + d AS ne FROM pick),
neg AS (SELECT *, EXISTS (SELECT 1 FROM neg0 o WHERE o.subject_id = n.subject_id AND o.event_id < n.event_id AND n.ns < o.ne - 1e-9 AND n.ne > o.ns + 1e-9) AS fallback FROM neg0 n)
"""


def bounds(spark, sf):
    return b.b_recordings(spark, sf).select("subject_id", F.lit(0.0).alias("lo"), F.col("common_sec").alias("hi"))


def eligible(spark, sf):
    return b.b_annotation(spark, sf).join(bounds(spark, sf), KEY).filter(
        (F.col("start") >= 0) & (F.col("end") <= F.col("hi")) & (F.col("end") > F.col("start"))
    )


def blocked(spark, sf):
    return b.b_awake(spark, sf).unionByName(b.b_annotation(spark, sf).select("subject_id", "start", "end"))


def negatives(spark, sf):
    gaps = stage(iv.complement_intervals(blocked(spark, sf), bounds(spark, sf), KEY, b.BIN), "gaps")
    events = eligible(spark, sf).select("subject_id", "event_id", "start", "end")
    return ng.place_flagged(events, gaps, KEY, "event_id", b.SEED, b.BIN)


@register(
    "iv6_place_negatives",
    with_ctes(
        "ann awake rec",
        "SELECT subject_id, event_id, round(ns, 3) + 0.0 AS start_sec, round(ne, 3) + 0.0 AS end_sec, fallback FROM neg",
        NEGATIVE_CTES,
    ),
)
def place(spark, sf):
    out = negatives(spark, sf)
    return out.select(
        "subject_id", "event_id", (F.round("start", 3) + 0.0).alias("start_sec"), (F.round("end", 3) + 0.0).alias("end_sec"), "fallback"
    )


@register(
    "iv6_place_negatives_strict",
    with_ctes(
        "ann awake rec",
        "SELECT subject_id, count(*) AS placed, round(sum(e - s), 3) + 0.0 AS seconds, CAST(0 AS BIGINT) AS overlaps, CAST(0 AS BIGINT) AS outside FROM neg GROUP BY subject_id",
        NEGATIVE_CTES,
    ),
)
def place_strict(spark, sf):
    """Per subject: how many were placed, their length, overlaps of those placed apart, and how many leave the free stretches."""
    events = eligible(spark, sf).select("subject_id", "event_id", "start", "end")
    out = ng.place_strict(events, blocked(spark, sf), bounds(spark, sf), KEY, "event_id", b.SEED, b.BIN)
    out = stage(out.select("subject_id", "event_id", "start", "end", "fallback"), "strict")
    over = iv.overlap_earlier(out.filter("not fallback").drop("fallback"), KEY, "event_id", b.BIN).filter("overlaps_earlier")
    shrunk = out.select("subject_id", "event_id", (F.col("start") + 1e-6).alias("start"), (F.col("end") - 1e-6).alias("end"))
    busy = blocked(spark, sf).filter(F.col("end") > F.col("start"))  # an empty interval covers nothing, so a negative may lie over it
    hit = jn.touching(shrunk, busy.select("subject_id", "start", "end"), KEY, 0.0, b.BIN).select("subject_id", "event_id")
    past = shrunk.join(bounds(spark, sf), KEY).filter((F.col("start") < F.col("lo")) | (F.col("end") > F.col("hi"))).select("subject_id", "event_id")
    per = out.groupBy("subject_id").agg(F.count("*").alias("placed"), (F.round(F.sum(F.col("end") - F.col("start")), 3) + 0.0).alias("seconds"))
    for name, rows in (("overlaps", over), ("outside", hit.union(past).distinct())):
        per = per.join(rows.groupBy("subject_id").agg(F.count("*").alias(name)), "subject_id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return per


def devices(spark):
    return spark.createDataFrame([("R",), ("S",)], "device string")


def manifest_rows(spark, sf):
    """Window manifest over the eligible events and their independent negatives; who reads it once writes only what is asked of it."""
    types = b.b_annotation(spark, sf).select(
        "subject_id", F.col("event_id").alias("seq"), "event_type", F.when(F.col("event_id") % 7 == 0, "W").otherwise("N2").alias("sleep_stage")
    )
    placed = negatives(spark, sf).withColumnRenamed("event_id", "seq")
    return ng.build_manifest(placed, types, devices(spark))


def manifest(spark, sf):
    """The manifest, staged once."""
    return stage(manifest_rows(spark, sf), "manifest")


MANIFEST_CTES = NEGATIVE_CTES + """,
win AS (SELECT subject_id, event_id, substr(sha1(subject_id || '|positive|' || event_id || '|' || CAST(s AS DECIMAL(20, 6)) || '|' || CAST(e AS DECIMAL(20, 6))), 1, 16) AS pid,
    substr(sha1(subject_id || '|negative|' || event_id || '|' || CAST(round(ns, 3) AS DECIMAL(20,3)) || '|' || CAST(round(ne, 3) AS DECIMAL(20,3))), 1, 16) AS nid, event_type, s, e, ns, ne, fallback FROM neg),
logical AS (SELECT pid AS logical_window_id, subject_id, 1 AS label, event_type, s AS start_sec, e AS end_sec, pid AS paired_positive_id, false AS fb FROM win
    UNION ALL SELECT nid, subject_id, 0, 'normal', ns, ne, pid, fallback FROM win),
manifest AS (SELECT logical_window_id || '_' || device AS sample_id, l.*, device FROM logical l CROSS JOIN (VALUES ('R'), ('S')) AS dv(device))
"""


@register(
    "iv7_build_manifest",
    with_ctes(
        "ann awake rec",
        """SELECT sample_id, logical_window_id, subject_id, device, CAST(label AS INTEGER) AS label, event_type, round(start_sec, 3) + 0.0 AS start_sec,
        round(end_sec, 3) + 0.0 AS end_sec, paired_positive_id, fb AS negative_overlap_fallback FROM manifest""",
        MANIFEST_CTES,
    ),
)
def build_manifest(spark, sf):
    return manifest(spark, sf).select(
        "sample_id",
        "logical_window_id",
        "subject_id",
        "device",
        "label",
        "event_type",
        (F.round("start_sec", 3) + 0.0).alias("start_sec"),
        (F.round("end_sec", 3) + 0.0).alias("end_sec"),
        "paired_positive_id",
        "negative_overlap_fallback",
    )


@register(
    "wn10_overlap_count",
    with_ctes("ann awake rec", "SELECT subject_id, count(*) AS negatives, count(*) FILTER (fallback) AS overlapping FROM neg GROUP BY subject_id", NEGATIVE_CTES),
)
def overlap_count(spark, sf):
    return negatives(spark, sf).groupBy("subject_id").agg(F.count("*").alias("negatives"), F.count_if("fallback").alias("overlapping"))


@register(
    "ag1_subject_summary",
    with_ctes(
        "ann awake rec",
        """SELECT r.subject_id, round(common_sec, 6) + 0.0 AS common_sec, coalesce(a.n, 0) AS raw_events, coalesce(el.n, 0) AS eligible_events,
        coalesce(a.n, 0) - coalesce(el.n, 0) AS excluded_outside_common_coverage, coalesce(ng.n, 0) AS positive_logical_windows, coalesce(ng.n, 0) AS negative_logical_windows,
        coalesce(ng.f, 0) AS negative_overlap_fallbacks FROM rec r LEFT JOIN (SELECT subject_id, count(*) AS n FROM ann GROUP BY 1) a USING (subject_id)
        LEFT JOIN (SELECT subject_id, count(*) AS n FROM elig GROUP BY 1) el USING (subject_id)
        LEFT JOIN (SELECT subject_id, count(*) AS n, count(*) FILTER (fallback) AS f FROM neg GROUP BY 1) ng USING (subject_id)""",
        NEGATIVE_CTES,
    ),
)
def subject_summary(spark, sf):
    rec = b.b_recordings(spark, sf)
    events = b.b_annotation(spark, sf).join(rec, KEY).withColumn(
        "eligible", (F.col("start") >= 0) & (F.col("end") <= F.col("common_sec")) & (F.col("end") > F.col("start"))
    )
    windows = manifest(spark, sf).filter("device = 'R'")
    out = sm.subject_summary(events, windows, rec)
    return out.withColumn("common_sec", r6("common_sec"))


@register(
    "fn12_coverage_filter",
    with_ctes(
        "ann rec",
        """SELECT subject_id, count(*) FILTER (s >= 0 AND e <= common_sec AND e > s) AS kept, count(*) FILTER (NOT (s >= 0 AND e <= common_sec AND e > s)) AS excluded
        FROM ann JOIN rec USING (subject_id) GROUP BY subject_id""",
    ),
)
def coverage(spark, sf):
    from ..functions.filters import coverage_counts

    return coverage_counts(b.b_annotation(spark, sf).join(b.b_recordings(spark, sf), KEY), "common_sec", KEY)


@register(
    "fn13_stage_filter",
    with_ctes("ann", "SELECT subject_id, event_id FROM ann WHERE coalesce(CASE WHEN event_id % 7 = 0 THEN 'W' WHEN event_id % 11 <> 0 THEN 'N2' END, '') <> 'W'"),
)
def stages(spark, sf):
    from ..functions.filters import filter_stage

    staged = b.b_annotation(spark, sf).withColumn(
        "sleep_stage", F.when(F.col("event_id") % 7 == 0, "W").when(F.col("event_id") % 11 != 0, "N2")
    )
    return filter_stage(staged, "W").select("subject_id", "event_id")


# ---------------------------------------------------------------- alignment

# Click anchors are sparse: stretches break at three days or a lag jump of 5 s.
GAP, JUMP, PAD = 259200.0, 5.0, 43200.0

SEGMENT_CTES = f"""
marks AS (SELECT subject_id, t, lag, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > {GAP} OR abs(lag - lag(lag) OVER w) > {JUMP} THEN 1 ELSE 0 END AS opens
    FROM anchors WINDOW w AS (PARTITION BY subject_id ORDER BY t)),
named AS (SELECT *, sum(opens) OVER (PARTITION BY subject_id ORDER BY t) AS g FROM marks),
seg0 AS (SELECT subject_id, g, min(t) AS a, max(t) AS z, count(*) AS n FROM named GROUP BY 1, 2),
seg AS (SELECT s.subject_id, a, z, n, CASE WHEN g = min(g) OVER (PARTITION BY s.subject_id) THEN greatest(0, a - {PAD}) ELSE a END AS lower,
    CASE WHEN g = max(g) OVER (PARTITION BY s.subject_id) THEN least(r.phone_sec, z + {PAD}) ELSE z END AS upper FROM seg0 s JOIN rec r USING (subject_id)),
segs AS (SELECT * FROM seg WHERE upper > lower)
"""


def segments(spark, sf):
    durations = b.b_recordings(spark, sf).select("subject_id", F.col("phone_sec").alias("duration"))
    return jn.segment_anchors(b.b_anchors(spark, sf), durations, "subject_id", GAP, JUMP, PAD, b.BIN)


@register(
    "iv8_segment_anchors",
    with_ctes("anchors rec", "SELECT subject_id, round(lower, 6) + 0.0 AS lower_sec, round(upper, 6) + 0.0 AS upper_sec, n AS anchors FROM segs", SEGMENT_CTES),
)
def segment(spark, sf):
    return segments(spark, sf).select("subject_id", r6("lower").alias("lower_sec"), r6("upper").alias("upper_sec"), "anchors")


def event_windows(spark, sf):
    return b.b_annotation(spark, sf).select(
        F.col("event_id").cast("string").alias("logical_window_id"), "subject_id", F.col("start").alias("start_sec"), F.col("end").alias("end_sec")
    )


@register(
    "jn6_assign_segment",
    with_ctes(
        "ann anchors rec",
        """SELECT subject_id, CAST(event_id AS VARCHAR) AS logical_window_id, round(lower, 6) + 0.0 AS lower_sec FROM (SELECT a.subject_id, event_id, lower,
        row_number() OVER (PARTITION BY event_id ORDER BY s.a) AS rn FROM ann a JOIN segs s ON s.subject_id = a.subject_id AND a.s >= lower AND a.e <= upper) WHERE rn = 1""",
        SEGMENT_CTES,
    ),
)
def assign(spark, sf):
    out = jn.assign_segment(event_windows(spark, sf), segments(spark, sf), "subject_id", b.BIN)
    return out.select("subject_id", "logical_window_id", r6("lower").alias("lower_sec"))


def _lerp(x: str) -> str:
    return f"""(SELECT CASE WHEN p.t IS NULL THEN n.lag WHEN n.t IS NULL OR p.t = {x} THEN p.lag ELSE p.lag + (n.lag - p.lag) * (({x} - p.t) / (n.t - p.t)) END
    FROM (SELECT max(t) AS t, arg_max(lag, t) AS lag FROM anchors q WHERE q.subject_id = a.subject_id AND q.t <= {x}) p,
    (SELECT min(t) AS t, arg_min(lag, t) AS lag FROM anchors q WHERE q.subject_id = a.subject_id AND q.t > {x}) n)"""


@register(
    "jn7_interpolate",
    with_ctes(
        "ann anchors",
        f"""SELECT subject_id, event_id, round({_lerp('a.s')}, 6) + 0.0 AS lag_start, round({_lerp('a.e')}, 6) + 0.0 AS lag_end FROM ann a""",
    ),
)
def interpolate(spark, sf):
    ann, anchors = b.b_annotation(spark, sf), b.b_anchors(spark, sf)
    one = jn.interpolate(ann, anchors, KEY, "start", "lag", "lag_start", b.BIN)
    two = jn.interpolate(one, anchors, KEY, "end", "lag", "lag_end", b.BIN)
    return two.select("subject_id", "event_id", r6("lag_start").alias("lag_start"), r6("lag_end").alias("lag_end"))


def _lerp_in(x: str) -> str:
    """Interpolation inside the stretch [sa, sz] of the window."""
    own = "q.subject_id = a.subject_id AND q.t >= a.sa AND q.t <= a.sz"
    return f"""(SELECT CASE WHEN p.t IS NULL THEN n.lag WHEN n.t IS NULL OR p.t = {x} THEN p.lag ELSE p.lag + (n.lag - p.lag) * (({x} - p.t) / (n.t - p.t)) END
    FROM (SELECT max(t) AS t, arg_max(lag, t) AS lag FROM anchors q WHERE {own} AND q.t <= {x}) p,
    (SELECT min(t) AS t, arg_min(lag, t) AS lag FROM anchors q WHERE {own} AND q.t > {x}) n)"""


ALIGNED_CTES = SEGMENT_CTES + f""",
inseg AS (SELECT * FROM (SELECT a.subject_id, a.event_id, a.s, a.e, g.a AS sa, g.z AS sz, row_number() OVER (PARTITION BY event_id ORDER BY g.a) AS rn
    FROM ann a JOIN segs g ON g.subject_id = a.subject_id AND a.s >= lower AND a.e <= upper) WHERE rn = 1),
mapped AS (SELECT a.subject_id, a.event_id, a.s, a.e, {_lerp_in('a.s')} AS l0, {_lerp_in('a.e')} AS l1 FROM inseg a),
aligned AS (SELECT m.* FROM mapped m JOIN rec r USING (subject_id) WHERE s + l0 >= 0 AND e + l1 <= recorder_sec AND e + l1 > s + l0)
"""


def aligned(spark, sf):
    wins = event_windows(spark, sf).crossJoin(F.broadcast(devices(spark))).withColumn(
        "sample_id", F.concat_ws("_", "logical_window_id", "device")
    )
    durations = b.b_recordings(spark, sf).select("subject_id", F.col("recorder_sec").alias("duration"))
    return jn.aligned_windows(wins, stage(segments(spark, sf), "segments"), b.b_anchors(spark, sf), durations, "subject_id", b.BIN)


@register(
    "jn7_aligned_manifest",
    with_ctes(
        "ann anchors rec",
        """SELECT event_id || '_' || device AS sample_id, subject_id, device, round(s, 6) + 0.0 AS reference_start_sec,
        round(s + CASE WHEN device = 'R' THEN l0 ELSE 0 END, 6) + 0.0 AS start_sec, round(e + CASE WHEN device = 'R' THEN l1 ELSE 0 END, 6) + 0.0 AS end_sec
        FROM aligned CROSS JOIN (VALUES ('R'), ('S')) AS dv(device)""",
        ALIGNED_CTES,
    ),
)
def aligned_manifest(spark, sf):
    return aligned(spark, sf).select(
        "sample_id", "subject_id", "device", r6("reference_start_sec").alias("reference_start_sec"), r6("start_sec").alias("start_sec"), r6("end_sec").alias("end_sec")
    )


@register(
    "jn8_pair_devices",
    with_ctes(
        "ann anchors rec",
        """SELECT CAST(event_id AS VARCHAR) AS logical_window_id, subject_id, event_id || '_R' AS r_sample_id, event_id || '_S' AS s_sample_id,
        round(s + l0, 6) + 0.0 AS r_start_sec, round(s, 6) + 0.0 AS s_start_sec, round(abs(l0) * 1000, 3) + 0.0 AS alignment_error_ms FROM aligned""",
        ALIGNED_CTES,
    ),
)
def pairs(spark, sf):
    rows = aligned(spark, sf).withColumn("offset", F.col("device_time_offset_start_sec"))
    out = jn.pair_devices(rows, ["subject_id"])
    return out.select(
        "logical_window_id",
        "subject_id",
        "r_sample_id",
        "s_sample_id",
        r6("r_start_sec").alias("r_start_sec"),
        r6("s_start_sec").alias("s_start_sec"),
        (F.round("alignment_error_ms", 3) + 0.0).alias("alignment_error_ms"),
    )


_NEAREST = """near AS (SELECT a.subject_id, a.event_id, x.event_id AS match_id, abs(x.t - a.s) AS dist,
    row_number() OVER (PARTITION BY a.subject_id, a.event_id ORDER BY abs(x.t - a.s), x.t, x.event_id) AS rn
    FROM ann a JOIN anchors x ON x.subject_id = a.subject_id AND abs(x.t - a.s) < 21600)"""


@register(
    "jn4_nearest_join",
    with_ctes("ann anchors", "SELECT subject_id, event_id, match_id, round(dist, 6) + 0.0 AS distance FROM near WHERE rn = 1", _NEAREST),
)
def nearest(spark, sf):
    out = jn.nearest_join(
        b.b_annotation(spark, sf), b.b_anchors(spark, sf), KEY, "start", "t", "event_id", ["event_id"], 21600.0, b.BIN
    )
    return out.select("subject_id", "event_id", F.col("match.event_id").alias("match_id"), r6("distance").alias("distance"))


@register(
    "jn5_propagate_flag",
    with_ctes(
        "ann awake rec runs",
        """SELECT m.sample_id, m.subject_id, m.device, CAST(m.label AS INTEGER) AS label, CASE WHEN m.label = 0 THEN true ELSE coalesce(w.ok, true) END AS corroborated
        FROM manifest m LEFT JOIN (SELECT pid, EXISTS (SELECT 1 FROM runs r WHERE r.subject_id = win.subject_id AND r.s <= win.e + 43200 AND r.e >= win.s) AS ok FROM win) w
        ON w.pid = m.logical_window_id""",
        MANIFEST_CTES,
    ),
)
def propagate(spark, sf):
    out = jn.propagate_flag(manifest_rows(spark, sf), window_flags(spark, sf), "corroborated")
    return out.select("sample_id", "subject_id", "device", "label", "corroborated")


def window_flags(spark, sf):
    """The flag of every event under the id of its logical window."""
    return flagged_events(spark, sf).select(
        stable_id(
            "subject_id",
            F.lit("positive"),
            "event_id",
            F.round("start", 6).cast("decimal(20,6)"),
            F.round("end", 6).cast("decimal(20,6)"),
        ).alias("logical_window_id"),
        "corroborated",
    )


# ---------------------------------------------------------------- splits

FOLD_CTES = """
folds AS (SELECT subject_id, CAST(subject_id % 5 AS INTEGER) AS fold FROM rec),
protos AS (SELECT * FROM (VALUES ('R_R', ['R'], ['R']), ('S_S', ['S'], ['S']), ('R_S', ['R'], ['S']), ('S_R', ['S'], ['R']), ('RS_RS', ['R', 'S'], ['R', 'S'])) AS p(protocol, tr, te)),
roles AS (SELECT o.fold, f.subject_id, CASE WHEN f.fold = o.fold THEN 'test' WHEN f.fold = (o.fold + 1) % 5 THEN 'validation' ELSE 'train' END AS role
    FROM folds f CROSS JOIN (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS fold) o),
cells AS (SELECT fold, protocol, role, subject_id, unnest(CASE WHEN role = 'test' THEN te ELSE tr END) AS device FROM roles CROSS JOIN protos)
"""


def folds(spark, sf):
    return b.b_recordings(spark, sf).select("subject_id", (F.col("subject_id") % b.N_FOLDS).cast("int").alias("fold"))


def positives(spark, sf):
    return b.b_recordings(spark, sf).select("subject_id").join(
        eligible(spark, sf).groupBy("subject_id").agg(F.count("*").alias("positives")), KEY, "left"
    ).select("subject_id", F.coalesce("positives", F.lit(0)).alias("positives"))


@register(
    "sp1_assign_folds",
    with_ctes(
        "ann rec",
        """SELECT subject_id, CAST(fold AS INTEGER) AS fold, positives FROM greedy WHERE i > 0""",
        """
        counts AS (SELECT r.subject_id, count(a.event_id) AS positives FROM rec r LEFT JOIN ann a ON a.subject_id = r.subject_id AND a.s >= 0 AND a.e <= r.common_sec AND a.e > a.s GROUP BY 1),
        queue AS (SELECT *, row_number() OVER (ORDER BY positives DESC, md5('42|' || subject_id), subject_id) AS i FROM counts),
        greedy AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS subject_id, CAST(NULL AS BIGINT) AS positives, CAST(NULL AS BIGINT) AS fold,
            [0, 0, 0, 0, 0]::BIGINT[] AS loads, [0, 0, 0, 0, 0]::BIGINT[] AS sizes
            UNION ALL SELECT q.i, q.subject_id, q.positives, f.k - 1,
                [CASE WHEN j = f.k THEN loads[j] + q.positives ELSE loads[j] END for j in [1, 2, 3, 4, 5]],
                [CASE WHEN j = f.k THEN sizes[j] + 1 ELSE sizes[j] END for j in [1, 2, 3, 4, 5]]
            FROM greedy g JOIN queue q ON q.i = g.i + 1,
            LATERAL (SELECT list_sort([(loads[j], sizes[j], j) for j in [1, 2, 3, 4, 5]])[1][3] AS k) f)
        """,
    ),
)
def assign_folds(spark, sf):
    return sp.assign_folds(positives(spark, sf), b.N_FOLDS, b.SEED)


@register(
    "sp2_fold_protocols",
    with_ctes("rec", "SELECT fold AS outer_fold, subject_id, role FROM roles", FOLD_CTES),
)
def fold_protocols(spark, sf):
    return sp.fold_roles(folds(spark, sf), b.N_FOLDS).select("outer_fold", "subject_id", "role")


@register(
    "fn11_protocols",
    with_ctes("rec", "SELECT fold, protocol, role, subject_id, device FROM cells", FOLD_CTES),
)
def protocol_roles(spark, sf):
    return sp.protocol_roles(folds(spark, sf), b.N_FOLDS).select("fold", "protocol", "role", "subject_id", "device")


@register(
    "jn11_split",
    with_ctes(
        "ann awake rec",
        """SELECT m.sample_id, c.role FROM manifest m JOIN cells c ON c.subject_id = m.subject_id AND c.device = m.device WHERE c.fold = 1 AND c.protocol = 'R_S'""",
        MANIFEST_CTES + "," + FOLD_CTES,
    ),
)
def split(spark, sf):
    return sp.split(manifest(spark, sf), folds(spark, sf), 1, "R_S", b.N_FOLDS).select("sample_id", "role")


_CHECK_SPLIT = """SELECT 'no subject in two roles' AS "check", count(*) = 0 AS passed, count(*) AS violations FROM (SELECT fold, protocol, subject_id FROM cells GROUP BY ALL HAVING count(DISTINCT role) > 1)
UNION ALL SELECT 'three roles with both classes', count(*) = 0, count(*) FROM (SELECT fold, protocol FROM (SELECT c.fold, c.protocol, c.role, count(DISTINCT m.label) AS k FROM cells c JOIN manifest m
    ON m.subject_id = c.subject_id AND m.device = c.device GROUP BY ALL) GROUP BY ALL HAVING count(*) < 3 OR min(k) < 2)"""


@register("sp3_check_split", with_ctes("ann awake rec", _CHECK_SPLIT, MANIFEST_CTES + "," + FOLD_CTES))
def check_split(spark, sf):
    rows = manifest(spark, sf).select("subject_id", "device", "label").distinct().join(
        sp.protocol_roles(folds(spark, sf), b.N_FOLDS), ["subject_id", "device"]
    )
    return sp.check_split(rows, by=["fold", "protocol"]).select("check", "passed", "violations")


@register(
    "sp8_filter_uncorroborated",
    with_ctes(
        "ann awake rec runs",
        """SELECT m.sample_id, c.role FROM manifest m JOIN cells c ON c.subject_id = m.subject_id AND c.device = m.device
        WHERE c.fold = 1 AND c.protocol = 'R_S' AND (c.role = 'test' OR m.label = 0 OR EXISTS (SELECT 1 FROM win w JOIN runs r ON r.subject_id = w.subject_id
        AND r.s <= w.e + 43200 AND r.e >= w.s WHERE w.pid = m.logical_window_id))""",
        MANIFEST_CTES + "," + FOLD_CTES,
    ),
)
def uncorroborated(spark, sf):
    rows = sp.split(manifest_rows(spark, sf), folds(spark, sf), 1, "R_S", b.N_FOLDS)
    return sp.filter_uncorroborated(rows, window_flags(spark, sf), "logical_window_id").select("sample_id", "role")


@register(
    "ag20_split_counts",
    with_ctes(
        "ann awake rec",
        """SELECT c.fold, c.protocol, c.role, count(*) AS rows, count(DISTINCT m.subject_id) AS subjects, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives
        FROM manifest m JOIN cells c ON c.subject_id = m.subject_id AND c.device = m.device GROUP BY ALL""",
        MANIFEST_CTES + "," + FOLD_CTES,
    ),
)
def split_counts(spark, sf):
    return sm.split_counts(manifest(spark, sf), sp.protocol_roles(folds(spark, sf), b.N_FOLDS))


@register(
    "ag20_split_subjects",
    with_ctes(
        "ann awake rec",
        "SELECT DISTINCT c.fold, c.protocol, c.role, m.subject_id FROM manifest m JOIN cells c ON c.subject_id = m.subject_id AND c.device = m.device",
        MANIFEST_CTES + "," + FOLD_CTES,
    ),
)
def split_subjects(spark, sf):
    return sm.split_subjects(manifest(spark, sf), sp.protocol_roles(folds(spark, sf), b.N_FOLDS))


@register(
    "ag21_fold_counts",
    with_ctes(
        "ann awake rec",
        "SELECT fold, count(DISTINCT m.subject_id) AS subjects, count(*) AS rows, count(*) FILTER (label = 1) AS positives FROM manifest m JOIN folds USING (subject_id) GROUP BY fold",
        MANIFEST_CTES + "," + FOLD_CTES,
    ),
)
def fold_counts(spark, sf):
    return sm.fold_counts(manifest(spark, sf), folds(spark, sf))


@register(
    "ag32_duration_summary",
    with_ctes("ann", "SELECT count(*) AS n, round(min(e - s), 6) + 0.0 AS min, round(median(e - s), 5) + 0.0 AS median, round(max(e - s), 6) + 0.0 AS max FROM ann"),
)
def durations(spark, sf):
    out = sm.duration_summary(b.b_annotation(spark, sf).select((F.col("end") - F.col("start")).alias("duration_sec")))
    return out.select("n", r6("min").alias("min"), (F.round("median", 5) + 0.0).alias("median"), r6("max").alias("max"))


@register(
    "fn8_severity_bin",
    "SELECT event_id, CASE WHEN value < 5 THEN 'normal' WHEN value < 15 THEN 'mild' WHEN value < 30 THEN 'moderate' ELSE 'severe' END AS severity FROM events",
)
def severity(spark, sf):
    return b.table(spark, sf, "events").select("event_id", severity_bin("value").alias("severity"))


# ---------------------------------------------------------------- checks

_FAULTS = """faults AS (SELECT logical_window_id, count(*) <> 2 OR count(*) FILTER (device = 'R') <> 1 OR count(*) FILTER (device = 'S') <> 1 AS p,
    NOT (min(subject_id) = max(subject_id) AND min(label) = max(label) AND min(start_sec) = max(start_sec) AND min(end_sec) = max(end_sec)) AS f FROM manifest GROUP BY 1)"""


def _check(text: str, bad: str, passed: str = "count(*) = 0") -> str:
    return f"""SELECT '{text}' AS "check", {passed} AS passed, count(*) AS violations FROM ({bad})"""


@register(
    "qa1_check_manifest",
    with_ctes(
        "ann awake rec",
        " UNION ALL ".join(
            [
                _check("sample ids are unique", "SELECT sample_id FROM manifest GROUP BY 1 HAVING count(*) > 1"),
                _check("intervals are valid", "SELECT 1 FROM manifest WHERE NOT end_sec > start_sec OR start_sec < 0"),
                _check("windows are R/S pairs", "SELECT 1 FROM faults WHERE p"),
                _check("pairs agree on key fields", "SELECT 1 FROM faults WHERE f"),
                _check("one fold per subject", "SELECT subject_id FROM folds GROUP BY 1 HAVING count(DISTINCT fold) > 1"),
                _check("folds cover the manifest", "SELECT subject_id FROM manifest EXCEPT SELECT subject_id FROM folds WHERE subject_id % 17 <> 3"),
            ]
        ),
        MANIFEST_CTES + "," + FOLD_CTES + "," + _FAULTS,
    ),
)
def check_manifest(spark, sf):
    holes = folds(spark, sf).filter("subject_id % 17 <> 3")
    return ck.check_manifest(manifest(spark, sf), holes, b.N_FOLDS).select("check", "passed", "violations")


@register(
    "qa2_check_splits",
    with_ctes(
        "ann awake rec",
        " UNION ALL ".join(
            [
                _check("subject sets are equal", "(SELECT subject_id FROM manifest EXCEPT SELECT subject_id FROM folds) UNION ALL (SELECT subject_id FROM folds EXCEPT SELECT subject_id FROM manifest)"),
                _check("folds are 0..n-1", "(SELECT fold FROM folds EXCEPT SELECT unnest(range(0, 5))) UNION ALL (SELECT unnest(range(0, 5)) EXCEPT SELECT fold FROM folds)"),
                _check("pairs hold on the reference clock", "SELECT 1 FROM faults WHERE p OR f"),
                _CHECK_SPLIT,
            ]
        ),
        MANIFEST_CTES + "," + FOLD_CTES + "," + _FAULTS,
    ),
)
def check_splits(spark, sf):
    return ck.check_splits(manifest(spark, sf), folds(spark, sf), b.N_FOLDS).select("check", "passed", "violations")


@register(
    "qa3_check_windows",
    with_ctes(
        "ann awake rec",
        " UNION ALL ".join(
            [
                _check("windows are in coverage", "SELECT 1 FROM logical JOIN rec USING (subject_id) WHERE start_sec < 0 OR end_sec > common_sec + 1e-6 OR end_sec <= start_sec"),
                _check("positives equal an annotation", "SELECT 1 FROM logical l WHERE label = 1 AND NOT EXISTS (SELECT 1 FROM ann a WHERE a.subject_id = l.subject_id AND abs(a.s - l.start_sec) < 1e-6 AND abs(a.e - l.end_sec) < 1e-6)"),
                _check("negatives are clear", "SELECT 1 FROM logical l WHERE label = 0 AND EXISTS (SELECT 1 FROM (SELECT subject_id, s, e FROM ann UNION ALL SELECT subject_id, s, e FROM awake) a WHERE a.subject_id = l.subject_id AND l.start_sec + 1e-6 <= a.e AND l.end_sec - 1e-6 >= a.s)"),
                _check("negatives overlapping negatives", "SELECT 1 FROM logical x WHERE label = 0 AND EXISTS (SELECT 1 FROM logical y WHERE y.label = 0 AND y.subject_id = x.subject_id AND y.logical_window_id < x.logical_window_id AND x.start_sec < y.end_sec - 1e-9 AND x.end_sec > y.start_sec + 1e-9)", "true"),
            ]
        ),
        MANIFEST_CTES,
    ),
)
def check_windows(spark, sf):
    one = manifest(spark, sf).filter("device = 'R'")
    return ck.check_windows(one, b.b_annotation(spark, sf), b.b_awake(spark, sf), bounds(spark, sf), b.BIN).select("check", "passed", "violations")


@register(
    "qa4_check_pairing",
    with_ctes(
        "ann awake rec",
        " UNION ALL ".join(
            [
                _check("pairs are complete", "SELECT 1 FROM faults WHERE p"),
                _check("one subject per pair", "SELECT 1 FROM manifest GROUP BY logical_window_id HAVING count(DISTINCT subject_id) > 1"),
                _check("no pair across folds", "SELECT 1 FROM manifest JOIN folds USING (subject_id) GROUP BY logical_window_id HAVING count(DISTINCT fold) > 1"),
                _check("every pair has a fold", "SELECT DISTINCT logical_window_id FROM manifest WHERE subject_id NOT IN (SELECT subject_id FROM folds)"),
                _check("one fold per subject", "SELECT subject_id FROM folds GROUP BY 1 HAVING count(DISTINCT fold) > 1"),
            ]
        ),
        MANIFEST_CTES + "," + FOLD_CTES + "," + _FAULTS,
    ),
)
def check_pairing(spark, sf):
    return ck.check_pairing(manifest(spark, sf), folds(spark, sf)).select("check", "passed", "violations")


_BASE = """base AS (SELECT sample_id, subject_id, device, fold, probability, CASE WHEN length(sample_id) % 2 = 0 THEN 'R' ELSE 'S' END || '_' || device AS protocol FROM pred WHERE arm = 'm1')"""


@register(
    "qa5_check_baseline",
    with_ctes(
        "pred",
        " UNION ALL ".join(
            [
                _check("all cells are present", "(SELECT f, p FROM (SELECT unnest(range(0, 5)) AS f) CROSS JOIN (SELECT unnest(['R_R', 'S_S', 'R_S', 'S_R', 'RS_RS']) AS p)) EXCEPT SELECT fold, protocol FROM base"),
                _check("predictions are of test subjects", "SELECT 1 FROM base b LEFT JOIN supplier s ON s.s_suppkey = b.subject_id WHERE s.s_suppkey IS NULL OR s.s_suppkey % 5 <> b.fold"),
                _check("every test subject has predictions", "SELECT s_suppkey, p FROM supplier CROSS JOIN (SELECT unnest(['R_R', 'S_S', 'R_S', 'S_R', 'RS_RS']) AS p) WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.subject_id = s_suppkey AND b.fold = s_suppkey % 5 AND b.protocol = p)"),
                _check("no subject in two roles", "SELECT s_suppkey FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey % 5) > 1"),
                _check("devices fit the protocol", "SELECT 1 FROM base WHERE NOT contains(split_part(protocol, '_', 2), device)"),
                _check("probabilities are finite", "SELECT 1 FROM base WHERE probability IS NULL OR isnan(probability) OR probability < 0 OR probability > 1"),
                _check("no sample twice", "SELECT 1 FROM base GROUP BY protocol, sample_id HAVING count(*) > 1"),
            ]
        ),
        _BASE,
    ),
)
def check_baseline(spark, sf):
    p = b.b_results(spark, sf).filter("arm = 'm1'")
    known = b.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("subject_id"), (F.col("s_suppkey") % b.N_FOLDS).cast("int").alias("fold")
    )
    return ck.check_baseline(p, known, [x[0] for x in sp.PROTOCOL_DEVICES], b.N_FOLDS).select("check", "passed", "violations")


@register(
    "qa6_check_predictions",
    with_ctes(
        "pred",
        _check("all folds are present", "SELECT arm, device FROM pred GROUP BY 1, 2 HAVING count(DISTINCT fold) <> 5")
        + " UNION ALL "
        + _check("sample ids are unique", "SELECT 1 FROM pred GROUP BY arm, device, sample_id HAVING count(*) > 1"),
    ),
)
def check_predictions(spark, sf):
    return ck.check_predictions(b.b_predictions(spark, sf), ["arm", "device"], b.N_FOLDS).select("check", "passed", "violations")

"""Interval, series and detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import r6, r9
from ..operators import intervals as iv
from ..operators import joins as jn
from ..operators import series as se
from . import bindings as b
from .oracle_ctes import with_ctes
from .registry import register

KEY = ["subject_id"]


def merged_awake(spark, sf):
    return iv.merge_intervals(b.b_awake(spark, sf), KEY, chunk_seconds=b.BIN)


def masked_series(spark, sf):
    return iv.mask_points(b.b_series(spark, sf), merged_awake(spark, sf), KEY, "t", b.BIN)


def detected_runs(spark, sf):
    return se.detect_runs(masked_series(spark, sf), KEY, b.DROP, b.MIN_DURATION, b.WINDOW, chunk_seconds=b.BIN)


@register(
    "iv1_merge_intervals",
    with_ctes("awake_merged", "SELECT subject_id, round(s, 6) + 0.0 AS start_sec, round(e, 6) + 0.0 AS end_sec FROM awake_merged"),
)
def merge(spark, sf):
    return merged_awake(spark, sf).select("subject_id", r6("start").alias("start_sec"), r6("end").alias("end_sec"))


_CLIP = """
clipped AS (SELECT a.subject_id, greatest(a.s, 0) AS s, least(a.e, r.common_sec) AS e FROM awake a JOIN rec r USING (subject_id)
    WHERE a.e > 0 AND a.s < r.common_sec AND least(a.e, r.common_sec) > greatest(a.s, 0)),
edges AS (SELECT subject_id, 0.0::DOUBLE AS x FROM rec UNION SELECT subject_id, e FROM clipped),
stops AS (SELECT subject_id, common_sec AS x FROM rec UNION SELECT subject_id, s FROM clipped),
gaps AS (SELECT g.subject_id, g.x AS gs, (SELECT min(z.x) FROM stops z WHERE z.subject_id = g.subject_id AND z.x >= g.x) AS ge FROM edges g
    WHERE NOT EXISTS (SELECT 1 FROM clipped c WHERE c.subject_id = g.subject_id AND c.s <= g.x AND c.e > g.x))
"""


@register(
    "iv2_complement_intervals",
    with_ctes(
        "awake rec",
        "SELECT subject_id, round(gs, 6) + 0.0 AS start_sec, round(ge, 6) + 0.0 AS end_sec FROM gaps WHERE ge > gs",
        _CLIP,
    ),
)
def complement(spark, sf):
    bounds = b.b_recordings(spark, sf).select("subject_id", F.lit(0.0).alias("lo"), F.col("common_sec").alias("hi"))
    free = iv.complement_intervals(b.b_awake(spark, sf), bounds, KEY, b.BIN)
    return free.select("subject_id", r6("start").alias("start_sec"), r6("end").alias("end_sec"))


@register(
    "iv3_overlap_predicate",
    with_ctes(
        "ann awake",
        """SELECT a.subject_id, a.event_id, count(*) AS overlapping FROM ann a JOIN awake w ON w.subject_id = a.subject_id
        AND a.s < w.e - 1e-9 AND a.e > w.s + 1e-9 GROUP BY a.subject_id, a.event_id""",
    ),
)
def overlap(spark, sf):
    from ..functions.scalars import overlaps

    pairs = jn.interval_join(b.b_annotation(spark, sf), b.b_awake(spark, sf), KEY, 0.0, b.BIN)
    strict = pairs.filter(overlaps("start", "end", "r_start", "r_end"))
    return strict.groupBy("subject_id", "event_id").agg(F.count("*").alias("overlapping"))


@register(
    "iv4_mask_points",
    with_ctes(
        "masked_series",
        "SELECT subject_id, count(*) AS samples, CAST(sum(CASE WHEN masked THEN 1 ELSE 0 END) AS BIGINT) AS masked FROM masked_series GROUP BY subject_id",
    ),
)
def mask(spark, sf):
    return masked_series(spark, sf).groupBy("subject_id").agg(
        F.count("*").alias("samples"), F.count_if("masked").alias("masked")
    )


_SPAN = """span AS (SELECT subject_id, min(t) AS lo, max(t) AS hi, count(*) AS n FROM series GROUP BY subject_id)"""


@register(
    "iv5_masked_seconds",
    with_ctes(
        "series awake_merged",
        """SELECT s.subject_id, round(coalesce(sum(CASE WHEN m.e > s.lo AND m.s < s.hi THEN least(m.e, s.hi) - greatest(m.s, s.lo) END), 0), 6) + 0.0
        AS masked_sec FROM span s LEFT JOIN awake_merged m ON m.subject_id = s.subject_id GROUP BY s.subject_id""",
        _SPAN,
    ),
)
def masked(spark, sf):
    out = iv.masked_seconds(b.b_series(spark, sf), b.b_awake(spark, sf), KEY, chunk_seconds=b.BIN)
    return out.select("subject_id", r6("masked_sec").alias("masked_sec"))


@register(
    "iv5_masked_seconds_unmerged",
    with_ctes(
        "series awake",
        """SELECT s.subject_id, round(coalesce(sum(CASE WHEN m.e > s.lo AND m.s < s.hi AND m.e > m.s THEN least(m.e, s.hi) - greatest(m.s, s.lo) END), 0), 6) + 0.0
        AS masked_sec FROM span s LEFT JOIN awake m ON m.subject_id = s.subject_id GROUP BY s.subject_id""",
        _SPAN,
    ),
)
def masked_raw(spark, sf):
    out = iv.masked_seconds(b.b_series(spark, sf), b.b_awake(spark, sf), KEY, merge=False)
    return out.select("subject_id", r6("masked_sec").alias("masked_sec"))


@register(
    "wn1_trailing_max",
    with_ctes("based", "SELECT subject_id, round(t, 6) + 0.0 AS t, v, baseline FROM based"),
)
def baseline(spark, sf):
    out = se.trailing_max(b.b_series(spark, sf), KEY, b.WINDOW)
    return out.select("subject_id", r6("t").alias("t"), "v", "baseline")


@register(
    "wn2_detect_runs",
    with_ctes(
        "runs",
        """SELECT subject_id, round(s, 6) + 0.0 AS start_sec, round(e, 6) + 0.0 AS end_sec, round(duration, 6) + 0.0 AS duration_sec,
        round(max_drop, 6) + 0.0 AS max_drop, round(area, 3) + 0.0 AS area FROM runs""",
    ),
)
def runs(spark, sf):
    return detected_runs(spark, sf).select(
        "subject_id",
        r6("start").alias("start_sec"),
        r6("end").alias("end_sec"),
        r6("duration").alias("duration_sec"),
        r6("max_drop").alias("max_drop"),
        (F.round("area", 3) + 0.0).alias("area"),
    )


_INDEX = """
span AS (SELECT subject_id, min(t) AS lo, max(t) AS hi, count(*) AS n FROM series GROUP BY subject_id),
cover AS (SELECT s.subject_id, coalesce(sum(CASE WHEN m.e > s.lo AND m.s < s.hi THEN least(m.e, s.hi) - greatest(m.s, s.lo) END), 0) AS sec
    FROM span s LEFT JOIN awake_merged m ON m.subject_id = s.subject_id GROUP BY s.subject_id),
hours AS (SELECT subject_id, (hi - lo) / 3600 - sec / 3600 AS h FROM span JOIN cover USING (subject_id) WHERE n >= 10),
idx AS (SELECT h.subject_id, count(r.s) / h.h AS event_index, coalesce(sum(r.area), 0) / 60 / h.h AS burden, h.h AS unmasked_hours
    FROM hours h LEFT JOIN runs r ON r.subject_id = h.subject_id WHERE h.h > 0 GROUP BY h.subject_id, h.h)
"""


def burden_table(spark, sf, runs=None):
    runs = detected_runs(spark, sf) if runs is None else runs
    covered = iv.masked_seconds(b.b_series(spark, sf), b.b_awake(spark, sf), KEY, chunk_seconds=b.BIN)
    return se.event_burden(runs, covered, KEY)


@register(
    "ag4_event_burden",
    with_ctes(
        "series awake_merged runs",
        "SELECT subject_id, round(event_index, 9) + 0.0 AS event_index, round(burden, 6) + 0.0 AS burden, round(unmasked_hours, 6) + 0.0 AS unmasked_hours FROM idx",
        _INDEX,
    ),
)
def burden(spark, sf):
    return burden_table(spark, sf).select(
        "subject_id", r9("event_index").alias("event_index"), r6("burden").alias("burden"), r6("unmasked_hours").alias("unmasked_hours")
    )


@register(
    "jn1_interval_join",
    with_ctes(
        "runs ann",
        """SELECT r.subject_id, round(r.s, 6) + 0.0 AS run_start, a.event_id FROM runs r JOIN ann a ON a.subject_id = r.subject_id
        AND r.s <= a.e + 43200 AND r.e >= a.s""",
    ),
)
def interval_join(spark, sf):
    out = jn.interval_join(detected_runs(spark, sf), b.b_annotation(spark, sf), KEY, b.LAG, b.BIN)
    return out.select("subject_id", r6("start").alias("run_start"), F.col("r_event_id").alias("event_id"))


@register(
    "jn2_unmatched_detections",
    with_ctes(
        "runs ann",
        """SELECT r.subject_id, round(r.s, 6) + 0.0 AS run_start, round(r.e, 6) + 0.0 AS run_end FROM runs r WHERE NOT EXISTS (
        SELECT 1 FROM ann a WHERE a.subject_id = r.subject_id AND r.s <= a.e + 43200 AND r.e >= a.s)""",
    ),
)
def anti(spark, sf):
    out = jn.unmatched(detected_runs(spark, sf), b.b_annotation(spark, sf), KEY, b.LAG, b.BIN)
    return out.select("subject_id", r6("start").alias("run_start"), r6("end").alias("run_end"))


_FLAG = """flags AS (SELECT a.subject_id, a.event_id, a.event_type, a.s, a.e, EXISTS (SELECT 1 FROM runs r WHERE r.subject_id = a.subject_id
    AND r.s <= a.e + 43200 AND r.e >= a.s) AS corroborated FROM ann a)"""


def flagged_events(spark, sf, runs=None):
    runs = detected_runs(spark, sf) if runs is None else runs
    return jn.flag_corroborated(b.b_annotation(spark, sf), runs, KEY, b.LAG, bin_seconds=b.BIN)


@register(
    "jn3_flag_corroborated",
    with_ctes("runs ann", "SELECT subject_id, event_id, event_type, corroborated FROM flags", _FLAG),
)
def flag(spark, sf):
    return flagged_events(spark, sf).select("subject_id", "event_id", "event_type", "corroborated")


@register(
    "ag5_corroboration_summary",
    with_ctes(
        "runs ann",
        """SELECT CASE WHEN grouping(event_type) = 1 THEN 'all' ELSE event_type END AS event_type, count(*) AS events,
        CAST(sum(CASE WHEN corroborated THEN 1 ELSE 0 END) AS BIGINT) AS corroborated,
        round(avg(CASE WHEN corroborated THEN 1.0::DOUBLE ELSE 0 END), 9) + 0.0 AS rate
        FROM flags GROUP BY GROUPING SETS ((event_type), ())""",
        _FLAG,
    ),
)
def corroboration(spark, sf):
    from ..operators.summaries import corroboration_summary

    out = corroboration_summary(flagged_events(spark, sf))
    return out.select("event_type", "events", "corroborated", r9("rate").alias("rate"))


def flagship(spark, sf):
    """Subjects with the highest run index, and how many of their events a run confirms."""
    found = detected_runs(spark, sf)
    per = flagged_events(spark, sf, found).groupBy("subject_id").agg(
        F.count("*").alias("events"), F.count_if("corroborated").alias("corroborated")
    )
    joined = burden_table(spark, sf, found).join(per, KEY, "left")
    return (
        joined.select(
            "subject_id",
            r9("event_index").alias("event_index"),
            r6("burden").alias("burden"),
            F.coalesce("events", F.lit(0)).alias("events"),
            F.coalesce("corroborated", F.lit(0)).alias("corroborated"),
        )
        .orderBy(F.desc("event_index"), "subject_id")
        .limit(20)
    )


register(
    "flagship_top_subjects",
    with_ctes(
        "series awake_merged runs ann",
        """SELECT i.subject_id, round(event_index, 9) + 0.0 AS event_index, round(burden, 6) + 0.0 AS burden, count(f.event_id) AS events,
        count(CASE WHEN f.corroborated THEN 1 END) AS corroborated FROM idx i LEFT JOIN flags f ON f.subject_id = i.subject_id
        GROUP BY i.subject_id, event_index, burden ORDER BY 2 DESC, 1 LIMIT 20""",
        _INDEX + "," + _FLAG,
    ),
)(flagship)

"""Envelope, lag, anchor and descriptor queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import r6, r9
from ..functions.tails import t_p_value
from ..operators import dsp
from ..operators import summaries as sm
from ..session import stage
from . import bindings as b
from .oracle_ctes import NORMAL_TAIL, STEPS, T_TAIL, with_ctes
from .registry import register

KEY = ["subject_id"]


@register(
    "ds1_rms_envelope",
    with_ctes("samples", "SELECT subject_id, frame, round(ln(sqrt(avg(v * v)) + 1e-8), 9) + 0.0 AS envelope FROM samples GROUP BY 1, 2"),
)
def envelope(spark, sf):
    out = dsp.rms_envelope(b.b_samples(spark, sf), KEY)
    return out.select("subject_id", "frame", r9("envelope").alias("envelope"))


@register(
    "wn9_zscore",
    with_ctes(
        "samples",
        """SELECT subject_id, frame, round((x - avg(x) OVER w) / greatest(stddev_pop(x) OVER w, 1e-12), 6) + 0.0 AS z FROM
        (SELECT subject_id, frame, ln(sqrt(avg(v * v)) + 1e-8) AS x FROM samples GROUP BY 1, 2) WINDOW w AS (PARTITION BY subject_id)""",
    ),
)
def zscore(spark, sf):
    out = dsp.zscore(dsp.rms_envelope(b.b_samples(spark, sf), KEY), KEY, "envelope")
    return out.select("subject_id", "frame", r6("z").alias("z"))


MAX_LAG = 5


def daily(spark, sf):
    """Standardised daily series of both devices, by subject."""
    d = b.b_devices(spark, sf).withColumnRenamed("day", "frame")
    z = stage(dsp.zscore(d, ["subject_id", "device"], "value"), "daily")
    return z.filter("device = 'R'").select("subject_id", "frame", "z"), z.filter("device = 'S'").select("subject_id", "frame", "z")


_LAG = f"""zz AS (SELECT subject_id, device, day, (value - avg(value) OVER w) / greatest(stddev_pop(value) OVER w, 1e-12) AS z FROM devices WINDOW w AS (PARTITION BY subject_id, device)),
prods AS (SELECT r.subject_id, CAST(r.day - s.day AS INTEGER) AS lag, sum(r.z * s.z) / any_value(c.n) AS corr FROM zz r JOIN zz s ON s.subject_id = r.subject_id AND r.device = 'R' AND s.device = 'S'
    AND abs(r.day - s.day) <= {MAX_LAG} JOIN (SELECT subject_id, count(*) AS n FROM zz WHERE device = 'R' GROUP BY 1) c ON c.subject_id = r.subject_id GROUP BY 1, 2),
pick AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY corr DESC, lag) AS rn FROM prods)"""
_LAG_SQL = with_ctes("devices", f"SELECT subject_id, lag, round(corr, 6) + 0.0 AS correlation, abs(lag) >= {MAX_LAG - 1} AS at_boundary FROM pick WHERE rn = 1", _LAG)


@register("ds2_best_lag", _LAG_SQL)
def best_lag(spark, sf):
    out = dsp.best_lag(*daily(spark, sf), KEY, MAX_LAG)
    return out.select("subject_id", "lag", r6("correlation").alias("correlation"), "at_boundary")


@register("ds2_best_lag_fft", _LAG_SQL)
def best_lag_fft(spark, sf):
    out = dsp.best_lag_fft(*daily(spark, sf), KEY, MAX_LAG)
    return out.select("subject_id", "lag", r6("correlation").alias("correlation"), "at_boundary")


STRETCH = 10  # days of an anchor window


@register(
    "ds2_best_lag_blocks",
    with_ctes(
        "devices",
        f"SELECT subject_id, anchor, lag, round(corr, 6) + 0.0 AS correlation, abs(lag) >= {MAX_LAG - 1} AS at_boundary FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, anchor ORDER BY round(corr, 12) DESC, lag) AS rn FROM each) WHERE rn = 1",
        _LAG.split(",\nprods AS")[0] + f""", near AS (SELECT r.subject_id, CAST(r.day // {STRETCH} AS BIGINT) AS anchor, CAST(r.day - s.day AS INTEGER) AS lag, sum(r.z * s.z) AS total
        FROM zz r JOIN zz s ON s.subject_id = r.subject_id AND r.device = 'R' AND s.device = 'S' AND abs(r.day - s.day) <= {MAX_LAG} GROUP BY ALL),
        each AS (SELECT near.*, total / n AS corr FROM near JOIN (SELECT subject_id, day // {STRETCH} AS anchor, count(*) AS n FROM zz WHERE device = 'R' GROUP BY ALL) USING (subject_id, anchor))""",
    ),
)
def best_lag_blocks(spark, sf):
    """The lag of every anchor window of a subject: the recorder's days of the window against the phone's days in reach."""
    left, right = daily(spark, sf)
    windows = left.withColumn("anchor", F.floor(F.col("frame") / STRETCH).cast("long"))
    reached = F.sequence(F.floor((F.col("frame") - MAX_LAG) / STRETCH).cast("long"), F.floor((F.col("frame") + MAX_LAG) / STRETCH).cast("long"))
    out = dsp.best_lag_blocks(windows, right.withColumn("anchor", F.explode(reached)), [*KEY, "anchor"], MAX_LAG, 16)
    return out.select("subject_id", "anchor", "lag", r6("correlation").alias("correlation"), "at_boundary")


@register(
    "ds3_anchor_grid",
    with_ctes(
        "rec",
        """SELECT subject_id, round(center, 6) + 0.0 AS center_sec FROM (
        SELECT subject_id, 43200 + 86400.0::DOUBLE * k AS center FROM rec, LATERAL (SELECT unnest(range(0, 400)) AS k) WHERE 43200 + 86400 * k <= common_sec - 43200
        UNION SELECT subject_id, common_sec - 43200 FROM rec WHERE common_sec >= 86400)""",
    ),
)
def anchor_grid(spark, sf):
    out = dsp.anchor_grid(b.b_recordings(spark, sf), "subject_id", "common_sec", 86400.0, 86400.0)
    return out.select("subject_id", r6("center").alias("center_sec"))


@register(
    "ds3_five_centers",
    with_ctes(
        "rec",
        """SELECT subject_id, CAST(k AS INTEGER) AS anchor, round(lo + (hi - lo) * k / 4, 3) + 0.0 AS center_sec FROM (SELECT subject_id, least(900, common_sec / 6) / 2 + 60 AS lo,
        common_sec - least(900, common_sec / 6) / 2 - 60 AS hi FROM rec), (SELECT unnest(range(0, 5)) AS k)""",
    ),
)
def five(spark, sf):
    out = dsp.five_centers(b.b_recordings(spark, sf), "subject_id", "common_sec")
    return out.select("subject_id", "anchor", (F.round("center", 3) + 0.0).alias("center_sec"))


@register(
    "wn7_max_gap",
    with_ctes(
        "anchors",
        """SELECT subject_id, CASE WHEN max(g) IS NULL THEN 'infinite' ELSE 'finite' END AS kind, round(coalesce(max(g), 0), 6) + 0.0 AS max_gap FROM (
        SELECT subject_id, t - lag(t) OVER (PARTITION BY subject_id ORDER BY t) AS g FROM anchors WHERE correlation >= 0.45) GROUP BY subject_id""",
    ),
)
def max_gap(spark, sf):
    out = dsp.max_gap(b.b_anchors(spark, sf).filter("correlation >= 0.45"), KEY, "t", b.BIN)
    infinite = F.col("max_gap") == float("inf")
    return out.select(
        "subject_id",
        F.when(infinite, "infinite").otherwise("finite").alias("kind"),
        r6(F.when(infinite, F.lit(0.0)).otherwise(F.col("max_gap"))).alias("max_gap"),
    )


@register(
    "ds4_usable_subjects",
    with_ctes(
        "anchors",
        """SELECT a.subject_id, n AS anchors, coalesce(k, 0) AS reliable_anchors, round(coalesce(k, 0) / CAST(n AS DOUBLE), 9) + 0.0 AS reliable_fraction, round(coalesce(med, 0), 6) + 0.0 AS median_correlation,
        coalesce(k, 0) >= 3 AND coalesce(k, 0) / CAST(n AS DOUBLE) >= 0.5 AND coalesce(med, 0) >= 0.5 AND coalesce(mg, 1e18) <= 604800 AS usable FROM
        (SELECT subject_id, count(*) AS n FROM anchors GROUP BY 1) a LEFT JOIN (SELECT subject_id, count(*) AS k, median(correlation) AS med, max(g) AS mg FROM (
        SELECT *, t - lag(t) OVER (PARTITION BY subject_id ORDER BY t) AS g FROM anchors WHERE correlation >= 0.45 AND abs(lag) < 20) GROUP BY 1) r ON r.subject_id = a.subject_id""",
    ),
)
def usable(spark, sf):
    out = dsp.usable_subjects(
        b.b_anchors(spark, sf), KEY, F.abs("lag") >= 20, min_fraction=0.5, gap_limit=604800.0, chunk_seconds=b.BIN
    )
    return out.select(
        "subject_id",
        "anchors",
        "reliable_anchors",
        r9("reliable_fraction").alias("reliable_fraction"),
        r6("median_correlation").alias("median_correlation"),
        "usable",
    )


@register(
    "ag26_alignment_summary",
    with_ctes(
        "anchors",
        """SELECT CAST(subject_id % 10 AS INTEGER) AS g, count(*) AS anchors, round(max(abs(lag)), 6) + 0.0 AS max_abs, round(avg(CASE WHEN abs(lag) <= 1 THEN 1.0::DOUBLE ELSE 0 END), 9) + 0.0 AS share_1s,
        round(avg(CASE WHEN abs(lag) <= 5 THEN 1.0::DOUBLE ELSE 0 END), 9) + 0.0 AS share_5s, round(median(lag), 6) + 0.0 AS median FROM anchors GROUP BY 1""",
    ),
)
def alignment(spark, sf):
    rows = b.b_anchors(spark, sf).withColumn("g", (F.col("subject_id") % 10).cast("int"))
    out = sm.alignment_summary(rows, ["g"])
    return out.select("g", "anchors", r6("max_abs").alias("max_abs"), r9("share_1s").alias("share_1s"), r9("share_5s").alias("share_5s"), r6("median").alias("median"))


def daily_segments(spark, sf):
    """Recorded segments: the samples of one subject and ten minutes, read as one per second."""
    e = b.timed_events(spark, sf).withColumn("seq", F.floor(F.col("t") / 600.0).cast("long"))
    packed = e.groupBy("subject_id", "seq").agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "value"))).alias("s"))
    return packed.select("subject_id", "seq", F.transform("s", lambda x: x["value"]).alias("samples"))


@register(
    "ds5_window_samples",
    with_ctes(
        "timed",
        """SELECT w.subject_id, w.k AS window_id, CAST(g.pos - w.a AS INTEGER) AS position, g.value AS v FROM wins w JOIN flat g ON g.subject_id = w.subject_id AND g.pos >= w.a AND g.pos < w.z""",
        """flat AS (SELECT subject_id, value, row_number() OVER (PARTITION BY subject_id ORDER BY t, event_id) - 1 AS pos FROM timed),
        wins AS (SELECT subject_id, k, k * 20 + 3 AS a, k * 20 + 15 AS z FROM (SELECT subject_id, count(*) AS n FROM timed GROUP BY 1), LATERAL (SELECT unnest(range(0, 100000)) AS k) WHERE k * 20 + 15 <= n)""",
    ),
)
def stitched(spark, sf):
    segs = stage(daily_segments(spark, sf), "segments")
    n = segs.groupBy("subject_id").agg(F.sum(F.size("samples")).alias("n"))
    wins = n.filter("n >= 15").select(
        "subject_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 15) / 20).cast("long"))).alias("window_id")
    ).select("subject_id", "window_id", (F.col("window_id") * 20 + 3).cast("double").alias("start_sec"), (F.col("window_id") * 20 + 15).cast("double").alias("end_sec"))
    out = dsp.window_samples(wins, segs, "subject_id", 1.0, chunk_segments=1008)
    return out.select("subject_id", "window_id", F.posexplode("samples").alias("position", "v"))


@register(
    "ds6_time_descriptors",
    with_ctes(
        "samples",
        """SELECT a.subject_id, a.n, round(rms, 6) + 0.0 AS rms, round(ms, 6) + 0.0 AS mean_square, round(dyn, 6) + 0.0 AS dynamic_range, round(nf, 6) + 0.0 AS noise_floor,
        round(20 * log10((rms + 1e-12) / (nf + 1e-12)), 6) + 0.0 AS snr_db, round(z / CAST(n AS DOUBLE), 9) + 0.0 AS zero_crossing_rate FROM
        (SELECT subject_id, count(*) AS n, sqrt(avg(v * v)) AS rms, avg(v * v) AS ms, quantile_cont(v, 0.995) - quantile_cont(v, 0.005) AS dyn FROM c GROUP BY 1) a
        JOIN (SELECT subject_id, quantile_cont(r, 0.1) AS nf FROM (SELECT subject_id, frame, sqrt(avg(v * v)) AS r FROM c GROUP BY 1, 2) GROUP BY 1) b USING (subject_id)
        JOIN (SELECT subject_id, count(*) FILTER ((v < 0) <> (pv < 0)) AS z FROM (SELECT *, lag(v) OVER (PARTITION BY subject_id ORDER BY t) AS pv FROM c) GROUP BY 1) d USING (subject_id)""",
        "c AS (SELECT subject_id, frame, t, v - 50 AS v FROM samples)",
    ),
)
def descriptors(spark, sf):
    centred = b.b_samples(spark, sf).withColumn("v", F.col("v") - 50.0)
    out = dsp.time_descriptors(centred, KEY, chunk_seconds=b.BIN)
    return out.select(
        "subject_id", "n", *[r6(c).alias(c) for c in ("rms", "mean_square", "dynamic_range", "noise_floor", "snr_db")], r9("zero_crossing_rate").alias("zero_crossing_rate")
    )


def _spectrum(size: int, segments: int, columns: str, source: str) -> str:
    """Fourier sums of mean-removed Hann segments with half overlap, written out term by term."""
    parts = "".join(
        f", sum(y{c} * cos(2 * pi() * k * n / {size})) AS r{c}, sum(y{c} * sin(2 * pi() * k * n / {size})) AS i{c}" for c in columns
    )
    centred = "".join(f", ({c} - avg({c}) OVER w) * (0.5 - 0.5 * cos(2 * pi() * n / {size})) AS y{c}" for c in columns)
    return f"""cut AS (SELECT vec_id, j, p - {size // 2} * j AS n, {", ".join(columns)} FROM {source} CROSS JOIN (SELECT unnest(range(0, {segments})) AS j)
    WHERE p >= {size // 2} * j AND p < {size // 2} * j + {size}),
tapered AS (SELECT vec_id, j, n{centred} FROM cut WINDOW w AS (PARTITION BY vec_id, j)),
ft AS (SELECT vec_id, j, k{parts} FROM tapered CROSS JOIN (SELECT unnest(range(0, {size // 2 + 1})) AS k) GROUP BY vec_id, j, k)"""


_PSD = _spectrum(32, 3, "x", "e") + """,
psd AS (SELECT vec_id, k, k * 250.0::DOUBLE AS f, greatest(avg(rx * rx + ix * ix) / (8000 * 12) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END, 2.2250738585072014e-308) AS p FROM ft GROUP BY vec_id, k),
grown AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY k) AS c, sum(p) OVER (PARTITION BY vec_id) AS t, sum(p * f) OVER (PARTITION BY vec_id) / sum(p) OVER (PARTITION BY vec_id) AS m FROM psd)"""


def _band(low: int, high: int) -> str:
    """Trapezoid energy of the bins low..high."""
    return f"250 * (sum(p) FILTER (k BETWEEN {low} AND {high}) - sum(p) FILTER (k IN ({low}, {high})) / 2)"


@register(
    "ds7_spectral_descriptors",
    with_ctes(
        "",
        f"""SELECT vec_id AS sample_id, round(any_value(m), 5) + 0.0 AS centroid_hz, round(sqrt(sum((f - m) * (f - m) * p) / any_value(t)), 5) + 0.0 AS bandwidth_hz,
        min(f) FILTER (c >= 0.85 * t) AS rolloff85_hz, round(exp(avg(ln(p))) / avg(p), 9) + 0.0 AS flatness, round({_band(0, 16)}, 9) + 0.0 AS total_energy,
        round({_band(0, 1)}, 9) + 0.0 AS band_0, round({_band(2, 3)}, 9) + 0.0 AS band_1, round({_band(4, 7)}, 9) + 0.0 AS band_2, round({_band(8, 16)}, 9) + 0.0 AS band_3, 0.0::DOUBLE AS band_4
        FROM grown GROUP BY vec_id""",
        "e AS (SELECT vec_id, unnest(range(0, 64)) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings)," + _PSD,
    ),
)
def spectral(spark, sf):
    out = dsp.spectral_descriptors(b.b_vectors(spark, sf).select("sample_id", "embedding"), ["sample_id"], "embedding", 8000.0, 32)
    five = [(F.round(c, 5) + 0.0).alias(c) for c in ("centroid_hz", "bandwidth_hz")]
    nine = [r9(c).alias(c) for c in ("flatness", "total_energy", *[f"band_{i}" for i in range(5)])]
    return out.select("sample_id", *five, "rolloff85_hz", *nine)


@register(
    "ds8_pair_measures",
    with_ctes(
        "",
        """SELECT l.vec_id AS sample_id, round(rms_r, 9) + 0.0 AS rms_r, round(rms_s, 9) + 0.0 AS rms_s, round(peak_rms_r, 9) + 0.0 AS peak_rms_r, round(peak_rms_s, 9) + 0.0 AS peak_rms_s,
        round(lsd, 6) + 0.0 AS log_spectral_distance, lag / 8.0::DOUBLE AS peak_lag_ms, round(corr, 9) + 0.0 AS peak_correlation, round(coh, 9) + 0.0 AS mean_coherence
        FROM levels l JOIN spectra s ON s.vec_id = l.vec_id JOIN best b ON b.vec_id = l.vec_id""",
        """e AS (SELECT vec_id, unnest(range(0, 32)) AS p, unnest(embedding[1:32])::DOUBLE AS r, unnest(embedding[33:64])::DOUBLE AS s FROM embeddings),
        q AS (SELECT vec_id, p, r, s, r / max(abs(r)) OVER w AS a, s / max(abs(s)) OVER w AS b FROM e WINDOW w AS (PARTITION BY vec_id)),
        levels AS (SELECT vec_id, sqrt(avg(r * r)) AS rms_r, sqrt(avg(s * s)) AS rms_s, sqrt(avg(a * a)) AS peak_rms_r, sqrt(avg(b * b)) AS peak_rms_s,
            sqrt(sum(a * a)) * sqrt(sum(b * b)) + 1e-12 AS scale, avg(a) AS ma, avg(b) AS mb FROM q GROUP BY vec_id),
        lags AS (SELECT x.vec_id, x.p - y.p AS lag, sum((x.a - ma) * (y.b - mb)) / any_value(scale) AS corr FROM q x JOIN q y ON y.vec_id = x.vec_id JOIN levels l ON l.vec_id = x.vec_id GROUP BY 1, 2),
        best AS (SELECT vec_id, max(corr) AS corr, arg_max(lag, corr) AS lag FROM lags GROUP BY vec_id),"""
        + _spectrum(16, 3, "ab", "q")
        + """,
        bins AS (SELECT vec_id, k, avg(ra * ra + ia * ia) AS pa, avg(rb * rb + ib * ib) AS pb, avg(ra * rb + ia * ib) AS re, avg(ia * rb - ra * ib) AS im,
            CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END / (8000 * 6.0::DOUBLE) AS f FROM ft GROUP BY vec_id, k),
        spectra AS (SELECT vec_id, sqrt(avg(pow(10 * log10(pa * f + 1e-12) - 10 * log10(pb * f + 1e-12), 2))) AS lsd, avg((re * re + im * im) / (pa * pb)) AS coh FROM bins GROUP BY vec_id)""",
    ),
)
def pair_measures(spark, sf):
    e = b.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.slice("embedding", 1, 32).alias("r"), F.slice("embedding", 33, 32).alias("s")
    )
    out = dsp.pair_measures(e, ["sample_id"], 8000.0, 16)
    nine = ("rms_r", "rms_s", "peak_rms_r", "peak_rms_s", "peak_correlation", "mean_coherence")
    return out.select("sample_id", r6("log_spectral_distance").alias("log_spectral_distance"), "peak_lag_ms", *[r9(c).alias(c) for c in nine])


def device_metrics(spark, sf):
    d = b.b_devices(spark, sf)
    return d.select("subject_id", "device", "value", F.sqrt("value").alias("root"), F.log1p("value").alias("level"))


@register(
    "ds9_paired_device_stats",
    with_ctes(
        "devices",
        """SELECT metric, count(*) AS subjects, round(avg(r), 6) + 0.0 AS recorder_mean, round(avg(s), 6) + 0.0 AS smartphone_mean, round(avg(r - s), 6) + 0.0 AS difference,
        round(stddev_samp(r - s), 6) + 0.0 AS difference_std FROM (SELECT metric, subject_id, avg(x) FILTER (device = 'R') AS r, avg(x) FILTER (device = 'S') AS s FROM (
        SELECT subject_id, device, 'value' AS metric, value AS x FROM devices UNION ALL SELECT subject_id, device, 'root', sqrt(value) FROM devices
        UNION ALL SELECT subject_id, device, 'level', ln(1 + value) FROM devices) GROUP BY 1, 2) WHERE r IS NOT NULL AND s IS NOT NULL GROUP BY metric""",
    ),
)
def device_stats(spark, sf):
    out = dsp.paired_device_stats(device_metrics(spark, sf), ["value", "root", "level"])
    return out.select("metric", "subjects", *[r6(c).alias(c) for c in ("recorder_mean", "smartphone_mean", "difference", "difference_std")])


_LONG = """sides AS (SELECT m AS metric, subject_id, avg(x) FILTER (device = 'R') - avg(x) FILTER (device = 'S') AS d FROM (SELECT subject_id, device, unnest(['value', 'root', 'level']) AS m,
        unnest([value, sqrt(value), ln(1 + value)]) AS x FROM devices) GROUP BY 1, 2), both_sides AS (SELECT * FROM sides WHERE d IS NOT NULL),
    ts AS (SELECT metric, count(*) AS n, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM both_sides GROUP BY metric),
    tp AS (SELECT metric, {T_TAIL} AS t_p FROM ts {STEPS} GROUP BY metric, n),
    rk AS (SELECT metric, d, rank() OVER (PARTITION BY metric ORDER BY abs(d)) + (count(*) OVER (PARTITION BY metric, abs(d)) - 1) / 2.0::DOUBLE AS r FROM both_sides WHERE d <> 0),
    ties AS (SELECT metric, sum(c * c * c - c) AS ties FROM (SELECT metric, CAST(count(*) AS DOUBLE) AS c FROM rk GROUP BY metric, abs(d)) GROUP BY metric),
    ws AS (SELECT metric, CAST(count(*) AS DOUBLE) AS n, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w FROM rk GROUP BY metric),
    zs AS (SELECT metric, (n * (n + 1) / 4 - w) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM ws JOIN ties USING (metric)),
    wp AS (SELECT metric, {NORMAL_TAIL} AS w_p FROM zs {STEPS} GROUP BY metric)"""


@register(
    "ds9_paired_device_tests",
    with_ctes(
        "devices",
        "SELECT metric, CAST(0.05 AS DOUBLE) AS tail_at_limit, round(t_p, 6) + 0.0 AS t_p_value, round(w_p, 6) + 0.0 AS wilcoxon_p_value FROM tp JOIN wp USING (metric)",
        _LONG.format(T_TAIL=T_TAIL, NORMAL_TAIL=NORMAL_TAIL, STEPS=STEPS),
    ),
)
def device_tests(spark, sf):
    """The limits stand where a t test of the distance to the mean has a tail of 0.05."""
    d, names = device_metrics(spark, sf), ["value", "root", "level"]
    out = dsp.paired_device_tests(d, names, "normal").join(
        dsp.paired_device_stats(d, names).select("metric", F.col("subjects").alias("n"), "difference", "difference_std"), "metric"
    )
    t = (F.col("ci95_high") - F.col("difference")) / (F.col("difference_std") / F.sqrt("n"))
    return out.select("metric", r6(t_p_value(t, F.col("n") - 1)).alias("tail_at_limit"), r6("t_p_value").alias("t_p_value"), r6("wilcoxon_p_value").alias("wilcoxon_p_value"))


@register(
    "ag23_mean_vectors",
    with_ctes(
        "vectors",
        """SELECT device, CAST(p AS INTEGER) AS position, round(avg(m), 9) + 0.0 AS mean, count(*) AS groups FROM (SELECT subject_id, device, p, avg(x) AS m FROM (
        SELECT subject_id, device, unnest(range(0, 64)) AS p, unnest(embedding)::DOUBLE AS x FROM vectors) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    ),
)
def mean_vectors(spark, sf):
    out = sm.mean_vectors(b.b_vectors(spark, sf), ["subject_id", "device"], "device", "embedding")
    return out.select("device", "position", r9("mean").alias("mean"), "groups")

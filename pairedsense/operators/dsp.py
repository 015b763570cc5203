"""Envelopes, lag search, anchors, stitched windows and signal descriptors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import DAY, bins_of
from .ranks import quantiles
from .scan import Running, running, time_chunk

# Band edges in Hz of the spectral descriptors.
BANDS = ((0, 500), (500, 1000), (1000, 2000), (2000, 4000), (4000, 8000))
NEAR = 1e-9  # correlations that an FFT may not tell apart


def rms_envelope(samples: DataFrame, by: Sequence[str], frame: str = "frame") -> DataFrame:
    """Log root mean square of every frame."""
    power = F.avg(F.col("v") * F.col("v"))
    return samples.groupBy(*by, frame).agg(F.log(F.sqrt(power) + 1e-8).alias("envelope"))


def zscore(df: DataFrame, by: Sequence[str], value: str, name: str = "z") -> DataFrame:
    """Standard score inside each window; a constant window gives zeros. Joined, so windows may be of any size."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    out = (F.col(value) - F.col("_mean")) / F.greatest("_std", F.lit(1e-12))
    return df.join(stats, list(by)).withColumn(name, out).drop("_mean", "_std")


def best_lag(left: DataFrame, right: DataFrame, by: Sequence[str], max_lag: int) -> DataFrame:
    """Lag (left minus right, in frames) with the largest normalised cross-correlation; ties to the smallest lag.

    ``at_boundary`` marks lags at the limit or one frame short of it.

    Both sides are (by, frame, z). Every left frame meets 2L+1 right frames in
    an equi-join, and sums are taken per (window, lag) before the shuffle.
    """
    by = list(by)
    size = left.groupBy(*by).agg(F.count("*").alias("_n"))
    shifted = left.select(
        *by, F.col("z").alias("_x"), "frame", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")
    ).withColumn("frame", F.col("frame") - F.col("lag"))
    products = shifted.join(right.select(*by, "frame", F.col("z").alias("_y")), [*by, "frame"])
    sums = products.groupBy(*by, "lag").agg(F.sum(F.col("_x") * F.col("_y")).alias("_s"))
    scored = sums.join(size, by).withColumn("correlation", F.col("_s") / F.col("_n"))
    best = scored.groupBy(*by).agg(F.max(F.struct("correlation", (-F.col("lag")).alias("back"))).alias("_b"))
    return best.select(
        *by,
        (-F.col("_b.back")).alias("lag"),
        F.col("_b.correlation").alias("correlation"),
        (F.abs(F.col("_b.back")) >= max_lag - 1).alias("at_boundary"),
    )


def best_lag_fft(left: DataFrame, right: DataFrame, by: Sequence[str], max_lag: int) -> DataFrame:
    """The same for wide lag ranges: one FFT per window. A window holds a fixed number of frames.

    As in ``best_lag``, a lag without a common frame doesn't count, and a window without such lags has no row. The
    FFT's rounding error could rank lags that are nearly equal, so the sums of those within ``NEAR`` of the largest are taken directly.
    """
    by = list(by)
    both = left.select(*by, F.lit(0).alias("_side"), "frame", "z").unionByName(
        right.select(*by, F.lit(1).alias("_side"), "frame", "z")
    )
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.select(*by).schema)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["frame"].min())
        width = int(pdf["frame"].max()) - first + 1
        sides, held = np.zeros((2, width)), np.zeros((2, width))
        place = pdf["_side"].to_numpy(), pdf["frame"].to_numpy() - first
        sides[place], held[place] = pdf["z"].to_numpy(), 1.0
        n = int((pdf["_side"] == 0).sum())
        size = 1 << (2 * width - 1).bit_length()
        x, y = np.fft.rfft(np.stack([sides, held], axis=1), size)
        circular, common = np.fft.irfft(x * np.conj(y), size)
        lags = np.arange(-min(max_lag, width - 1), min(max_lag, width - 1) + 1)
        lags = lags[common[lags] > 0.5]
        row = {k: [pdf[k].iloc[0]] * min(len(lags), 1) for k in by}
        if not len(lags):
            return pd.DataFrame({**row, "lag": [], "correlation": [], "at_boundary": []})
        top = circular[lags].max()
        near = lags[circular[lags] >= top - NEAR * max(1.0, n)]
        values = [sum((sides[0, max(k, 0) : width + min(k, 0)] * sides[1, max(-k, 0) : width - max(k, 0)]).tolist()) / n for k in near]
        best = int(near[np.argmax(values)])
        return pd.DataFrame({**row, "lag": [best], "correlation": [max(values)], "at_boundary": [abs(best) >= max_lag - 1]})

    return both.groupBy(*by).applyInPandas(search, f"{fields}, lag int, correlation double, at_boundary boolean")


def best_lag_blocks(left: DataFrame, right: DataFrame, by: Sequence[str], max_lag: int, block: int = 4096) -> DataFrame:
    """``best_lag`` for wide ranges and long windows: frames in blocks of fixed size, one spectrum product per pair of near blocks.

    Each left block meets the right blocks that a lag within the range can reach, about 2 * max_lag / block + 2
    of them; a pair gives its sums per lag, which are added up per (window, lag). No task holds a
    window. Lags without a common frame don't count; equal correlations (to 12 digits) go to the smallest lag.
    """
    by = list(by)

    def blocks(side: DataFrame, name: str) -> DataFrame:
        at = F.floor(F.col("frame") / block).cast("long")
        held = F.collect_list(F.struct((F.col("frame") - F.col(name) * block).cast("int").alias("o"), F.col("z").cast("double").alias("z")))
        packed = side.withColumn(name, at).groupBy(*by, name).agg(held.alias("_e"))
        return packed.select(*by, name, F.col("_e.o").alias(f"{name}_o"), F.col("_e.z").alias(f"{name}_z"))

    reach = -(-max_lag // block)
    mates = F.explode(F.sequence(F.col("_l") - reach - 1, F.col("_l") + reach + 1))
    pairs = blocks(left, "_l").withColumn("_r", mates).join(blocks(right, "_r"), [*by, "_r"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.select(*by).schema)

    def spectra(places: pd.Series, values: pd.Series) -> np.ndarray:
        """Spectra (row, 2, bin) of the values of each block and of its filled places."""
        rows = np.repeat(np.arange(len(places)), [len(p) for p in places])
        at = np.concatenate(places.to_list())
        out = np.zeros((len(places), 2, 2 * block))
        np.add.at(out, (rows, 0, at), np.concatenate(values.to_list()))
        np.add.at(out, (rows, 1, at), 1.0)
        return np.fft.rfft(out)

    step = max(1, (1 << 18) // block)  # pairs transformed at once

    def correlate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.arange(-block + 1, block)
        for batch in frames:
            for start in range(0, len(batch), step):
                pdf = batch.iloc[start : start + step]
                both = np.fft.irfft(spectra(pdf["_l_o"], pdf["_l_z"]) * np.conj(spectra(pdf["_r_o"], pdf["_r_z"])), 2 * block)[:, :, own]
                lag = own + (pdf["_l"] - pdf["_r"]).to_numpy()[:, None] * block
                row, col = np.nonzero((np.abs(lag) <= max_lag) & (both[:, 1] > 0.5))
                yield pd.DataFrame({**{k: pdf[k].iloc[row].array for k in by}, "lag": lag[row, col], "_s": both[row, 0, col]})

    partial = pairs.mapInPandas(correlate, f"{fields}, lag long, _s double")
    size = left.groupBy(*by).agg(F.count("*").alias("_n"))
    scored = partial.groupBy(*by, "lag").agg(F.sum("_s").alias("_s")).join(size, by).withColumn("correlation", F.col("_s") / F.col("_n"))
    best = scored.groupBy(*by).agg(F.max(F.struct(F.round("correlation", 12).alias("c"), (-F.col("lag")).alias("back"), "correlation")).alias("_b"))
    return best.select(
        *by,
        (-F.col("_b.back")).cast("int").alias("lag"),
        F.col("_b.correlation").alias("correlation"),
        (F.abs(F.col("_b.back")) >= max_lag - 1).alias("at_boundary"),
    )


def anchor_grid(inventory: DataFrame, key: str, common: str, window: float, step: float) -> DataFrame:
    """Window centres every ``step`` seconds and one at the last place a window fits."""
    half = window / 2.0
    last = F.col(common) - half
    count = F.floor((last - half) / step).cast("int")
    grid = inventory.filter(last >= half).select(
        key,
        F.explode(
            F.array_distinct(
                F.concat(F.transform(F.sequence(F.lit(0), count), lambda i: F.lit(half) + i * step), F.array(last))
            )
        ).alias("center"),
    )
    return grid


def five_centers(inventory: DataFrame, key: str, common: str) -> DataFrame:
    """Five evenly spread centres of windows of a sixth of the recording, at most 900 s, a minute from both ends."""
    half = F.least(F.lit(900.0), F.col(common) / 6.0) / 2.0
    low, high = half + 60.0, F.col(common) - half - 60.0
    return inventory.select(
        key, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: low + (high - low) * i / 4.0)).alias("anchor", "center")
    )


def max_gap(anchors: DataFrame, by: Sequence[str], t: str = "t", chunk_seconds: float = DAY) -> DataFrame:
    """Largest gap between consecutive anchors; infinite for a single one."""
    staged = anchors.select(*by, t).withColumn("_chunk", time_chunk(t, chunk_seconds))
    prev = running(staged, list(by), "_chunk", {"_p": Running("last", F.col(t), (t,), inclusive=False)})
    return prev.groupBy(*by).agg(
        F.coalesce(F.max(F.col(t) - F.col("_p")), F.lit(float("inf"))).alias("max_gap")
    )


def usable_subjects(
    anchors: DataFrame,
    by: Sequence[str],
    boundary: Column,
    reliable_at: float = 0.45,
    min_reliable: int = 3,
    min_fraction: float = 0.7,
    min_median: float = 0.5,
    gap_limit: float = 1800.0,
    chunk_seconds: float = DAY,
) -> DataFrame:
    """Reliable anchors per key and whether they suffice to map its clock."""
    by = list(by)
    marked = anchors.withColumn("reliable", (F.col("correlation") >= reliable_at) & ~boundary)
    good = marked.filter("reliable")
    counts = marked.groupBy(*by).agg(F.count("*").alias("anchors"), F.count_if("reliable").alias("reliable_anchors"))
    out = (
        counts.join(quantiles(good, by, {"median_correlation": ("correlation", 0.5)}), by, "left")
        .join(max_gap(good, by, "t", chunk_seconds), by, "left")
        .withColumn("reliable_fraction", F.col("reliable_anchors") / F.col("anchors"))
        .withColumn("median_correlation", F.coalesce("median_correlation", F.lit(0.0)))
        .withColumn("max_gap", F.coalesce("max_gap", F.lit(float("inf"))))
    )
    usable = (
        (F.col("reliable_anchors") >= min_reliable)
        & (F.col("reliable_fraction") >= min_fraction)
        & (F.col("median_correlation") >= min_median)
        & (F.col("max_gap") <= gap_limit)
    )
    return out.withColumn("usable", usable)


def window_samples(
    windows: DataFrame, segments: DataFrame, by: str, rate: float, chunk_segments: int = 64, bin_seconds: float = 3600.0
) -> DataFrame:
    """Samples of windows that may span several recorded segments.

    ``segments`` holds (key, seq, samples ARRAY); a segment lasts
    size(samples)/rate seconds and starts where the one before it ends. A
    window without coverage, or more than two samples short, fails.
    """
    sized = segments.withColumn("_len", F.size("samples") / F.lit(float(rate))).withColumn(
        "_chunk", F.floor(F.col("seq") / chunk_segments).cast("long")
    )
    offsets = running(
        sized.select(by, "seq", "_len", "_chunk"), [by], "_chunk", {"_before": Running("sum", F.col("_len"), ("seq",), inclusive=False)}
    )
    placed = sized.drop("_chunk", "_len").join(offsets.select(by, "seq", "_len", "_before"), [by, "seq"])
    pieces = placed.withColumn("_bin", F.explode(bins_of(F.col("_before"), F.col("_before") + F.col("_len"), bin_seconds)))
    wanted = windows.withColumn("_bin", F.explode(bins_of(F.col("start_sec"), F.col("end_sec"), bin_seconds)))
    lo = F.greatest("start_sec", "_before") - F.col("_before")
    hi = F.least(F.col("end_sec"), F.col("_before") + F.col("_len")) - F.col("_before")
    once = F.col("_bin") == F.greatest(time_chunk("start_sec", bin_seconds), time_chunk("_before", bin_seconds))
    cut = (
        wanted.join(pieces, [by, "_bin"])
        .filter(once & (hi > lo))
        .withColumn("_from", F.greatest(F.lit(0), F.round(lo * rate).cast("int")))
        .withColumn("_to", F.least(F.size("samples"), F.round(hi * rate).cast("int")))
        .withColumn("_part", F.slice("samples", F.col("_from") + 1, F.col("_to") - F.col("_from")))
    )
    joined = cut.groupBy(*windows.columns).agg(F.array_sort(F.collect_list(F.struct("seq", "_part"))).alias("_parts"))
    flat = F.flatten(F.transform("_parts", lambda p: p["_part"]))
    expected = F.round((F.col("end_sec") - F.col("start_sec")) * rate).cast("int")
    covered = windows.join(joined.select(*windows.columns, flat.alias("_v")), windows.columns, "left")
    size = F.coalesce(F.size("_v"), F.lit(0))
    checked = F.when(
        F.col("_v").isNull() | (F.abs(size - expected) > 2),
        F.raise_error(F.concat(F.lit("window length mismatch: "), size.cast("string"))).cast("array<double>"),
    ).otherwise(F.slice(F.concat(F.transform("_v", lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), 2)), F.lit(1), expected))
    return covered.select(*windows.columns, checked.alias("samples"))


def time_descriptors(samples: DataFrame, by: Sequence[str], frame: str = "frame", order: str = "t", chunk_seconds: float = DAY) -> DataFrame:
    """Level, spread, noise floor and zero-crossing rate of long samples (by, frame, t, v)."""
    by = list(by)
    level = samples.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("v") * F.col("v")).alias("mean_square"))
    spread = quantiles(samples, by, {"_hi": ("v", 0.995), "_lo": ("v", 0.005)})
    frames = samples.groupBy(*by, frame).agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("_rms"))
    floor = quantiles(frames, by, {"noise_floor": ("_rms", 0.1)})
    staged = samples.select(*by, order, "v").withColumn("_chunk", time_chunk(order, chunk_seconds))
    seen = running(staged, by, "_chunk", {"_p": Running("last", F.col("v"), (order,), inclusive=False)})
    crossings = seen.groupBy(*by).agg(
        F.count_if(F.col("_p").isNotNull() & ((F.col("v") < 0) != (F.col("_p") < 0))).alias("_cross")
    )
    out = level.join(spread, by).join(floor, by).join(crossings, by)
    rms = F.sqrt("mean_square")
    return out.select(
        *by,
        "n",
        rms.alias("rms"),
        "mean_square",
        (F.col("_hi") - F.col("_lo")).alias("dynamic_range"),
        "noise_floor",
        (20.0 * F.log10((rms + 1e-12) / (F.col("noise_floor") + 1e-12))).alias("snr_db"),
        (F.col("_cross") / F.col("n")).alias("zero_crossing_rate"),
    )


def _by_length(columns: Sequence[pd.Series]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Rows of a batch whose windows have equal length, as (row numbers, one matrix per column)."""
    lengths = np.min([[len(v) for v in c] for c in columns], axis=0)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, [np.stack([np.asarray(c.iloc[i][:n], dtype=float) for i in at]) for c in columns]


def _tapered(waves: np.ndarray, size: int) -> np.ndarray:
    """Spectra (window, segment, bin) of mean-removed Hann segments with half overlap."""
    size = min(size, waves.shape[1])
    cut = np.lib.stride_tricks.sliding_window_view(waves, size, axis=1)[:, :: max(size - size // 2, 1)]
    hann = np.sin(np.pi * np.arange(size) / size) ** 2
    return np.fft.rfft((cut - cut.mean(axis=2, keepdims=True)) * hann, axis=2)


def _density(left: np.ndarray, right: np.ndarray, rate: float, size: int) -> np.ndarray:
    """One-sided (cross) power density (window, bin) of two sets of segment spectra."""
    both = (left.conj() * right).mean(axis=1)
    sides = np.full(both.shape[1], 2.0)
    sides[0] = 1.0
    if size % 2 == 0:
        sides[-1] = 1.0
    return both * sides / (rate * 0.375 * size)


def power_spectra(df: DataFrame, key: Sequence[str], values: str, rate: float, size: int = 1024) -> DataFrame:
    """(key, length, psd): power density of one waveform window per row; bins are rate / min(size, length) apart."""
    key = list(key)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*key).schema)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found: list = [None] * len(pdf)
            width = np.zeros(len(pdf), dtype=np.int64)
            for at, (waves,) in _by_length([pdf[values]]):
                used = min(size, waves.shape[1])
                spectra = _tapered(waves, size)
                for row, psd in zip(at, _density(spectra, spectra, rate, used).real):
                    found[row] = psd
                width[at] = used
            yield pdf[key].assign(length=width, psd=found)

    return df.select(*key, values).mapInPandas(batches, f"{fields}, length long, psd array<double>")


SPECTRAL = ["centroid_hz", "bandwidth_hz", "rolloff85_hz", "flatness", "total_energy", *[f"band_{i}" for i in range(len(BANDS))]]


def spectral_descriptors(df: DataFrame, key: Sequence[str], values: str, rate: float, size: int = 1024) -> DataFrame:
    """Spectrum summary of one waveform window per row, over (window, bin) rows.

    Energies are trapezoid sums over the bins of a band: all its densities less
    half of the outer two. A band of one bin or none has no energy; the band
    that reaches half the rate includes it.
    """
    key = list(key)
    floor = F.lit(float(np.finfo(float).tiny))
    bins = power_spectra(df, key, values, rate, size).select(*key, "length", F.posexplode("psd").alias("k", "p"))
    step = F.lit(float(rate)) / F.col("length")
    bins = bins.select(*key, "k", step.alias("step"), (F.col("k") * step).alias("f"), F.greatest("p", floor).alias("p"))
    whole = Window.partitionBy(*key)
    bins = bins.select(
        "*",
        F.sum("p").over(whole).alias("_all"),
        (F.sum(F.col("f") * F.col("p")).over(whole) / F.sum("p").over(whole)).alias("_center"),
        F.sum("p").over(whole.orderBy("k")).alias("_grown"),
    )

    def energy(inside: Column) -> Column:
        own = F.when(inside, F.col("p"))
        outer = F.min_by("p", F.when(inside, F.col("k"))) + F.max_by("p", F.when(inside, F.col("k")))
        return F.when(F.count(own) > 1, F.first("step") * (F.sum(own) - outer / 2)).otherwise(0.0)

    bands = [
        energy((F.col("f") >= low) & ((F.col("f") < high) if high < rate / 2 else (F.col("f") <= high))).alias(f"band_{i}")
        for i, (low, high) in enumerate(BANDS)
    ]
    away = F.col("f") - F.col("_center")
    return bins.groupBy(*key).agg(
        F.first("_center").alias("centroid_hz"),
        F.sqrt(F.sum(away * away * F.col("p")) / F.first("_all")).alias("bandwidth_hz"),
        F.min(F.when(F.col("_grown") >= 0.85 * F.col("_all"), F.col("f"))).alias("rolloff85_hz"),
        (F.exp(F.avg(F.log("p"))) / F.avg("p")).alias("flatness"),
        energy(F.lit(True)).alias("total_energy"),
        *bands,
    )


PAIR = ["rms_r", "rms_s", "peak_rms_r", "peak_rms_s", "log_spectral_distance", "peak_lag_ms", "peak_correlation", "mean_coherence"]


def _peak_normalised(waves: np.ndarray) -> np.ndarray:
    top = np.abs(waves).max(axis=1, keepdims=True)
    return np.divide(waves, top, out=waves.copy(), where=top > 1e-8)


def _rms(waves: np.ndarray) -> np.ndarray:
    return np.linalg.norm(waves, axis=1) / np.sqrt(waves.shape[1])


def _spectral_pair(a: np.ndarray, b: np.ndarray, rate: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(log spectral distance in dB, mean coherence) of each pair."""
    used = min(size, a.shape[1])
    sa, sb = _tapered(a, size), _tapered(b, size)
    pa, pb = _density(sa, sa, rate, used).real, _density(sb, sb, rate, used).real
    decibels = 10 * np.log10((pa + 1e-12) / (pb + 1e-12))
    shared = np.abs(_density(sa, sb, rate, used)) ** 2 / np.maximum(pa * pb, np.finfo(float).tiny)
    return _rms(decibels), shared.mean(axis=1)


def _delay(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lag in samples, correlation) where each pair correlates best, over all lags."""
    n = a.shape[1]
    width = 1 << (2 * n - 1).bit_length()
    fa, fb = (np.fft.rfft(x - x.mean(axis=1, keepdims=True), width, axis=1) for x in (a, b))
    around = np.roll(np.fft.irfft(fa * fb.conj(), width, axis=1), n - 1, axis=1)[:, : 2 * n - 1]
    best = around.argmax(axis=1)
    scale = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1) + 1e-12
    return best - (n - 1), around[np.arange(len(a)), best] / scale


def pair_measures(df: DataFrame, key: Sequence[str], rate: float, size: int = 1024) -> DataFrame:
    """Measures of two simultaneous waveform windows ``r`` and ``s`` per row, compared over the shorter one's length."""
    key = list(key)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*key).schema)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = {name: np.zeros(len(pdf)) for name in PAIR}
            whole = {c: pdf[c].map(lambda v: np.asarray(v, dtype=float)) for c in ("r", "s")}
            scaled = {c: v.map(lambda x: _peak_normalised(x[None])[0]) for c, v in whole.items()}
            for c in ("r", "s"):
                for at, (waves,) in _by_length([whole[c]]):
                    out[f"rms_{c}"][at] = _rms(waves)
            for at, (a, b) in _by_length([scaled["r"], scaled["s"]]):
                out["peak_rms_r"][at], out["peak_rms_s"][at] = _rms(a), _rms(b)
                out["log_spectral_distance"][at], out["mean_coherence"][at] = _spectral_pair(a, b, rate, size)
                lag, out["peak_correlation"][at] = _delay(a, b)
                out["peak_lag_ms"][at] = lag / rate * 1000
            yield pdf[key].assign(**out)

    return df.select(*key, "r", "s").mapInPandas(batches, fields + "".join(f", {n} double" for n in PAIR))


def paired_device_stats(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """R minus S of every metric over subject means: moments, t and signed-rank tests."""
    from .stats import moments

    long = df.select(
        "subject_id", "device", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]))
    )
    wide = long.groupBy("metric", "subject_id").agg(
        F.avg(F.when(F.col("device") == "R", F.col("value"))).alias("r"),
        F.avg(F.when(F.col("device") == "S", F.col("value"))).alias("s"),
    )
    both = wide.filter(F.col("r").isNotNull() & F.col("s").isNotNull()).withColumn("difference", F.col("r") - F.col("s"))
    sides = both.groupBy("metric").agg(F.avg("r").alias("recorder_mean"), F.avg("s").alias("smartphone_mean"))
    return moments(both, ["metric"], "difference").join(sides, "metric").select(
        "metric",
        F.col("n").alias("subjects"),
        "recorder_mean",
        "smartphone_mean",
        F.col("mean").alias("difference"),
        F.col("std").alias("difference_std"),
    )


def paired_device_tests(df: DataFrame, metrics: Sequence[str], method: str = "exact") -> DataFrame:
    """Interval limits and p-values that go with ``paired_device_stats``; ``method`` is that of the signed-rank test."""
    from .stats import paired_t, t_interval, wilcoxon

    long = df.select(
        "subject_id", "device", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]))
    )
    both = (
        long.groupBy("metric", "subject_id")
        .agg(
            (
                F.avg(F.when(F.col("device") == "R", F.col("value"))) - F.avg(F.when(F.col("device") == "S", F.col("value")))
            ).alias("difference")
        )
        .filter(F.col("difference").isNotNull())
    )
    limits = t_interval(both, ["metric"], "difference").select("metric", "ci95_low", "ci95_high")
    t = paired_t(both, ["metric"], "difference").select("metric", F.col("p_value").alias("t_p_value"))
    w = wilcoxon(both, ["metric"], "difference", method).select("metric", F.col("p_value").alias("wilcoxon_p_value"))
    return limits.join(t, "metric").join(w, "metric", "left")

"""Readers of recordings, annotations, run logs, predictions and feature blocks."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clock_to_seconds, label_from_keywords, patient_from_path, stable_id
from ..operators.checks import check_predictions
from ..operators.setops import duplicates
from .wav import WavHeaders

ANNOTATION = T.StructType(
    [
        T.StructField("subject_id", T.StringType()),
        T.StructField("record_start", T.DoubleType()),
        T.StructField("awake_intervals", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField(
            "events",
            T.ArrayType(
                T.StructType(
                    [
                        # Fixed value: the documents spell this key so.
                        T.StructField("evnet_start", T.DoubleType()),
                        T.StructField("event_duration", T.DoubleType()),
                        T.StructField("event_type", T.StringType()),
                        T.StructField("sleep_stage", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def padded(column: Column | str, width: int) -> Column:
    """Left zeros up to a width; longer ids stay whole."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    worst = duplicates(df, keys).limit(1).collect()
    if worst:
        raise ValueError(f"{what}: duplicate {', '.join(keys)} {tuple(worst[0][k] for k in keys)}")
    return df


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str, pad: dict[str, int] | None = None, unique: Sequence[str] = ()
) -> DataFrame:
    """CSV with a header and an explicit schema; identifiers stay padded text; duplicate keys are refused."""
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    for column, width in (pad or {}).items():
        df = df.withColumn(column, padded(column, width))
    return require_unique(df, unique, path) if unique else df


def read_annotations(
    spark: SparkSession, path: str, multi_line: bool = True, subject_pattern: str = r"([^/]+)_annotation\.json$"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(header, events, awake) of annotation documents; a document without a required key fails.

    The subject comes from the document or, if absent there, from the file name.
    """
    docs = spark.read.schema(ANNOTATION).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)
    named = docs.withColumn(
        "subject_id", F.coalesce("subject_id", F.regexp_extract(F.col("_metadata.file_path"), subject_pattern, 1))
    )
    missing = F.col("record_start").isNull() | F.col("awake_intervals").isNull() | F.col("events").isNull()
    text = F.concat(F.lit("annotation lacks required keys: "), F.col("subject_id"))
    checked = named.withColumn(
        "record_start", F.when(missing, F.raise_error(text).cast("double")).otherwise(F.col("record_start"))
    )
    header = checked.select(
        "subject_id", "record_start", F.size("events").alias("event_count"), F.size("awake_intervals").alias("awake_interval_count")
    )
    events = checked.select("subject_id", "record_start", F.posexplode("events").alias("seq", "e")).select(
        "subject_id",
        "seq",
        (F.col("e.evnet_start") - F.col("record_start")).alias("start"),
        (F.col("e.evnet_start") - F.col("record_start") + F.col("e.event_duration")).alias("end"),
        F.col("e.event_type").alias("event_type"),
        F.coalesce("e.sleep_stage", F.lit("")).alias("sleep_stage"),
    )
    awake = checked.select("subject_id", "record_start", F.explode("awake_intervals").alias("a")).select(
        "subject_id",
        (F.col("a")[0] - F.col("record_start")).alias("start"),
        (F.col("a")[1] - F.col("record_start")).alias("end"),
    )
    return header, events, awake


def read_series(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    clock_col: str,
    value_col: str,
    record_start: DataFrame | None = None,
    subject_pattern: str = r"([^/]+)_SpO2\.csv$",
) -> DataFrame:
    """(subject_id, t, v) of sensor CSV files; the clock becomes relative seconds.

    Rows whose clock or value is ``-`` (or empty) are missing samples and left
    out; any other malformed line, clock or value fails.
    """
    raw = spark.read.schema(schema).option("header", True).option("nullValue", "-").option("mode", "FAILFAST").csv(path)
    subject = F.col("subject_id") if "subject_id" in raw.columns else F.regexp_extract(F.col("_metadata.file_path"), subject_pattern, 1)
    present = raw.filter(F.col(clock_col).isNotNull() & F.col(value_col).isNotNull())
    seconds = clock_to_seconds(clock_col)
    clock = F.when(seconds.isNull(), F.raise_error(F.concat(F.lit("malformed clock: "), F.col(clock_col))).cast("double")).otherwise(seconds)
    rows = present.select(subject.alias("subject_id"), clock.alias("t"), F.col(value_col).cast("double").alias("v"))
    if record_start is None:
        return rows
    return rows.join(record_start.select("subject_id", "record_start"), "subject_id").select(
        "subject_id", (F.col("t") - F.col("record_start")).alias("t"), "v"
    )


HEADER_BYTES = 1 << 16
#: Bytes handed on by each step: most files need the first one only, a file with a long chunk before its data the second, odd ones the rest.
WALK = (HEADER_BYTES, HEADER_BYTES, (1 << 31) - 1)
_FORMAT = "channels long, sample_rate long, bits long, data_bytes long, next long"


def _walk(first: bool):
    def run(part: pd.Series) -> pd.DataFrame:
        """Fields of the fmt chunk and the size of the data chunk of each part, and where in the part the next chunk starts while none is the data chunk."""
        rows = []
        for raw in part:
            raw = raw if raw is not None else b""
            found: dict[str, int | None] = dict.fromkeys(("channels", "sample_rate", "bits", "data_bytes", "next"))
            known = not first or (raw[:4] == b"RIFF" and raw[8:12] == b"WAVE")
            at = (12 if first else 0) if known else len(raw)
            while at + 8 <= len(raw):
                name, held = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
                if name == b"fmt " and held >= 16:
                    if at + 24 > len(raw):
                        break  # cut by the end of the part: the next one starts here
                    found |= {
                        "channels": int.from_bytes(raw[at + 10 : at + 12], "little"),
                        "sample_rate": int.from_bytes(raw[at + 12 : at + 16], "little"),
                        "bits": int.from_bytes(raw[at + 22 : at + 24], "little"),
                    }
                if name == b"data":
                    found["data_bytes"] = held
                    break
                at += 8 + held + held % 2
            if known and found["data_bytes"] is None:
                found["next"] = at
            rows.append(found)
        return pd.DataFrame(rows, columns=["channels", "sample_rate", "bits", "data_bytes", "next"]).astype("Int64")

    return run


def _wav_format(files: DataFrame) -> DataFrame:
    """(path, channels, sample_rate, bits, data_bytes): NULL where a file has no fmt or data chunk."""
    fields = ["channels", "sample_rate", "bits", "data_bytes"]
    out = files.select("path", "content", F.lit(0).cast("long").alias("next"), *[F.lit(None).cast("long").alias(c) for c in fields])
    for step, size in enumerate(WALK):
        inside = F.col("next") + 8 <= F.octet_length("content")
        part = F.when(inside, F.substring("content", (F.col("next") + 1).cast("int"), F.lit(size)))
        walked = out.withColumn("_w", F.pandas_udf(_walk(step == 0), _FORMAT)(part))
        # A fmt chunk that comes later counts, as in one walk.
        out = walked.select("path", "content", (F.col("next") + F.col("_w.next")).alias("next"), *[F.coalesce(f"_w.{c}", c).alias(c) for c in fields])
    return out.select("path", *fields)


NAME = r"([^/_]+)_(recorder|phone)(?:_?(\d+))?\.wav$"


def _described(fields: DataFrame, pattern: str) -> DataFrame:
    """What a file's name and header fields (path, channels, sample_rate, bits, data_bytes) say."""
    named = F.col("path").rlike(pattern)
    whole = F.col("channels").isNotNull() & F.col("data_bytes").isNotNull()
    width = F.col("channels") * F.col("bits") / 8
    part = F.nullif(F.regexp_extract("path", pattern, 3), F.lit(""))
    return fields.select(
        "path",
        F.when(named, F.regexp_extract("path", pattern, 1)).alias("subject_id"),
        F.when(named, F.when(F.regexp_extract("path", pattern, 2) == "recorder", "R").otherwise("S")).alias("device"),
        F.when(named, F.coalesce(part.cast("int"), F.lit(0))).alias("seq"),
        F.when(~named, "unexpected name")
        .when(~whole, "unreadable")
        .when((F.col("channels") != 1) | (F.col("bits") != 16), "unexpected format")
        .otherwise("ok")
        .alias("status"),
        *[F.when(whole, F.col(c)).alias(c) for c in ("channels", "sample_rate", "bits")],
        F.when(whole, F.try_divide(F.col("data_bytes") / width, F.col("sample_rate"))).alias("duration_sec"),
    )


def wav_headers(files: DataFrame, pattern: str = NAME) -> DataFrame:
    """Header fields of WAV contents (path, content) that are rows of a table; a broken file is a row with another status.

    A name tells subject, device and, for recorders, the number of the part; a
    name of another form has none of them and the status ``unexpected name``.
    Chunks are walked to the data chunk wherever it starts; Python gets the first ``HEADER_BYTES``, and more of the files that need it.
    """
    return _described(_wav_format(files), pattern)


def audio_inventory(spark: SparkSession, glob: str, pattern: str = NAME) -> DataFrame:
    """The same fields for the files that a glob names, by ranged reads: no more than their chunk heads is read."""
    spark.dataSource.register(WavHeaders)
    return _described(spark.read.format("wav_headers").load(glob), pattern)


def subject_inventory(audio: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row per annotated subject: availability, durations by device, ordered recorder segments."""
    good = audio.filter(F.col("status") == "ok")
    recorder, phone = F.col("device") == "R", F.col("device") == "S"
    per = good.groupBy("subject_id").agg(
        F.count_if(phone).alias("_phones"),
        F.count_if(recorder).cast("int").alias("recorder_segments"),
        F.sum(F.when(phone, F.col("duration_sec"))).alias("phone_duration_sec"),
        F.sum(F.when(recorder, F.col("duration_sec"))).alias("recorder_duration_sec"),
        # A recording has a handful of files, so the list is short.
        F.array_sort(F.collect_list(F.when(recorder, F.struct("seq", "path", "duration_sec")))).alias("segments"),
        F.array_sort(F.collect_set("sample_rate")).alias("sample_rates"),
    )
    out = annotations.join(per, "subject_id", "left")
    has_phone, has_recorder = F.coalesce("_phones", F.lit(0)) > 0, F.coalesce("recorder_segments", F.lit(0)) > 0
    common = F.when(has_phone & has_recorder, F.least("phone_duration_sec", "recorder_duration_sec"))
    return out.select(
        "subject_id",
        has_phone.alias("phone_available"),
        has_recorder.alias("recorder_available"),
        (has_phone & has_recorder).alias("paired_available"),
        "phone_duration_sec",
        F.coalesce("recorder_segments", F.lit(0)).alias("recorder_segments"),
        "recorder_duration_sec",
        common.alias("common_duration_sec"),
        "segments",
        "sample_rates",
        "event_count",
        "awake_interval_count",
    )


def clip_catalog(
    paths: DataFrame,
    device: str,
    positive: Sequence[str],
    negative: Sequence[str],
    mode: str = "parent",
    regex: str | None = None,
) -> DataFrame:
    """Labelled clips of one device out of a file listing (path); files without a label are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    listed = paths.select(
        F.col("path").alias("file_path"),
        name.alias("file_name"),
        F.lit(device).alias("device"),
        label_from_keywords(name, positive, negative).alias("label"),
        patient_from_path("path", mode, regex).alias("patient_id"),
    )
    return listed.filter(F.col("label").isNotNull()).withColumn("row_id", stable_id("device", "file_path"))


def read_clips(spark: SparkSession, glob: str, device: str, positive: Sequence[str], negative: Sequence[str], **rules) -> DataFrame:
    """Catalogue of the files below a path; only the listing is read, not the contents."""
    return clip_catalog(spark.read.format("binaryFile").load(glob).select("path"), device, positive, negative, **rules)


def read_runs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Finished run records with their file; broken records are skipped."""
    full = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    raw = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    rows = raw.select("*", F.col("_metadata.file_path").alias("record_path"))
    return rows.filter(F.col("_broken").isNull() & (F.col("status") == "complete")).drop("_broken")


PREDICTIONS = (
    "run_id string, sample_id string, logical_window_id string, subject_id string, device string, label int, probability double, prediction int,"
    " representation string, classifier string, protocol string, fold int"
)


def read_predictions(spark: SparkSession, root: str, n_folds: int, keys: Sequence[str] = ("representation", "classifier", "protocol")) -> DataFrame:
    """Predictions of many runs; every configuration needs all folds and no sample twice."""
    df = spark.read.schema(PREDICTIONS).option("header", True).option("mode", "FAILFAST").csv(root).withColumn("subject_id", padded("subject_id", 2))
    failed = check_predictions(df, keys, n_folds).filter(~F.col("passed")).collect()
    if failed:
        raise ValueError("; ".join(f"{r['check']}: {r['violations']} violations" for r in failed))
    return df


def read_features(spark: SparkSession, root: str, feature: str, expected: DataFrame) -> DataFrame:
    """One feature block (a partition of the store); samples without a vector are refused."""
    block = spark.read.parquet(root).filter(F.col("feature") == feature)
    missing = expected.select("sample_id").join(block.select("sample_id"), "sample_id", "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"feature {feature} is incomplete: sample {missing[0][0]} has no vector")
    return block

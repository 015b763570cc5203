"""Source, sink and streaming queries: files are written by Spark from the given tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import r6, r9
from ..session import shared_path, stage
from ..sources import readers as rd
from ..sources import sinks as sk
from ..streaming import jobs as sj
from . import bindings as b
from .oracle_ctes import with_ctes
from .registry import register
from .series import masked_series
from .scalars import CLOCK_SQL


@register(
    "src1_read_table",
    """SELECT CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 3 THEN lpad(CAST(c_custkey AS VARCHAR), 3, '0') ELSE CAST(c_custkey AS VARCHAR) END AS subject_id,
    c_name, c_acctbal FROM customer""",
)
def read_table(spark, sf):
    path = shared_path(spark, "csv")
    c = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id"), "c_name", "c_acctbal")
    c.write.option("header", True).csv(path)
    return rd.read_table(spark, path, "subject_id string, c_name string, c_acctbal double", {"subject_id": 3}, ["subject_id"])


def annotation_files(spark, sf):
    """Annotation documents of the subjects as JSON lines."""
    e = b.timed_events(spark, sf).filter(F.col("event_type").isin("error", "signup"))
    docs = e.groupBy(F.col("subject_id").cast("string").alias("subject_id")).agg(
        F.lit(1000.0).alias("record_start"),
        F.array_sort(
            F.collect_list(F.when(F.col("event_type") == "signup", F.array(F.col("t") + 1000.0, F.col("t") + 1000.0 + F.col("value") * 600.0)))
        ).alias("awake_intervals"),
        F.array_sort(
            F.collect_list(
                F.when(
                    F.col("event_type") == "error",
                    F.struct(
                        (F.col("t") + 1000.0).alias("evnet_start"),
                        (F.col("value") * 600.0).alias("event_duration"),
                        F.when(F.col("event_id") % 2 == 1, "hypo").otherwise("osa").alias("event_type"),
                    ),
                )
            )
        ).alias("events"),
    )
    path = shared_path(spark, "annotations")
    docs.write.json(path)
    return path


@register(
    "src2_read_annotations",
    with_ctes(
        "timed",
        """SELECT CAST(subject_id AS VARCHAR) AS subject_id, count(*) FILTER (event_type = 'error') AS events, count(*) FILTER (event_type = 'signup') AS awake,
        round(sum(t) FILTER (event_type = 'error'), 4) + 0.0 AS start_total, round(sum(value * 600) FILTER (event_type = 'signup'), 4) + 0.0 AS awake_total,
        count(*) FILTER (event_type = 'error' AND event_id % 2 = 1) AS hypo FROM timed WHERE event_type IN ('error', 'signup') GROUP BY 1""",
    ),
)
def annotations(spark, sf):
    header, events, awake = rd.read_annotations(spark, annotation_files(spark, sf), multi_line=False)
    e = events.groupBy("subject_id").agg(
        F.count("*").alias("events"), (F.round(F.sum("start"), 4) + 0.0).alias("start_total"), F.count_if(F.col("event_type") == "hypo").alias("hypo")
    )
    a = awake.groupBy("subject_id").agg(
        F.count("*").alias("awake"), (F.round(F.sum(F.col("end") - F.col("start")), 4) + 0.0).alias("awake_total")
    )
    return header.select("subject_id").join(e, "subject_id", "left").join(a, "subject_id", "left")


@register(
    "src3_read_series",
    f"SELECT CAST(user_id AS VARCHAR) AS subject_id, {CLOCK_SQL} - 1000 AS t, value AS v FROM events WHERE event_id % 10 <> 0",
)
def read_series(spark, sf):
    path = shared_path(spark, "series")
    e = b.table(spark, sf, "events")
    e.select(
        F.col("user_id").alias("subject_id"),
        F.date_format("ts", "HH:mm:ss").alias("clock"),
        F.when(F.col("event_id") % 10 == 0, "-").otherwise(F.col("value").cast("string")).alias("reading"),
    ).write.option("header", True).csv(path)
    starts = e.select(F.col("user_id").cast("string").alias("subject_id"), F.lit(1000.0).alias("record_start")).distinct()
    return rd.read_series(spark, path, "subject_id string, clock string, reading double", "clock", "reading", starts)


def _hex_little(value, size):
    """Little-endian hex text of a number column."""
    text = F.lpad(F.hex(value.cast("long")), size * 2, "0")
    return F.concat(*[F.substring(text, (size - i - 1) * 2 + 1, 2) for i in range(size)])


def wav_contents(spark, sf):
    """WAV bytes of the vectors: their values as samples, then silence; rates and lengths by sample.

    Every third file has a LIST chunk before its data, every seventh is cut short, every eleventh has a foreign name.
    """
    v = b.table(spark, sf, "embeddings")
    sid = F.col("vec_id")
    frames = 64 + sid % 100
    extra = F.when(sid % 3 == 0, F.lit("4C495354" + "03000000" + "61626300")).otherwise(F.lit(""))
    head = F.concat(
        F.lit("52494646"), _hex_little(36 + frames * 2, 4), F.lit("57415645666D742010000000" + "0100" + "0100"),
        _hex_little(8000 + (sid % 3) * 8000, 4), _hex_little((8000 + (sid % 3) * 8000) * 2, 4), F.lit("02001000"), extra, F.lit("64617461"), _hex_little(frames * 2, 4),
    )
    level = lambda x: F.pmod(F.round(x * 1000).cast("long"), F.lit(65536))
    samples = F.array_join(F.transform("embedding", lambda x: _hex_little(level(x), 2)), "")
    full = F.unhex(F.concat(head, samples, F.repeat(F.lit("0000"), (sid % 100).cast("int"))))
    part = F.when(sid % 2 == 0, F.concat(F.lit("_recorder_"), sid, F.lit(".wav"))).otherwise(F.lit("_phone.wav"))
    name = F.concat(F.lit("/data/"), sid % 50, F.lit("/"), sid % 50, F.when(sid % 11 == 0, F.lit("_notes.wav")).otherwise(part))
    return v.select(name.alias("path"), F.when(sid % 7 == 0, F.substring(full, 1, 20)).otherwise(full).alias("content"), sid.alias("vec_id"))


_WAV = """wav AS (SELECT vec_id, CASE WHEN vec_id % 11 <> 0 THEN CAST(vec_id % 50 AS VARCHAR) END AS subject_id,
    CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 2 = 0 THEN 'R' ELSE 'S' END AS device, vec_id % 7 <> 0 AND vec_id % 11 <> 0 AS ok, vec_id % 11 <> 0 AS named, vec_id % 7 <> 0 AS sound,
    8000 + (vec_id % 3) * 8000 AS rate, CAST(64 + vec_id % 100 AS DOUBLE) / (8000 + (vec_id % 3) * 8000) AS dur FROM embeddings)"""


def wav_files(spark, sf):
    """The contents written as files, a folder per vector, and the inventory read back from them."""
    root = shared_path(spark, "wav")
    sk.write_files(wav_contents(spark, sf).withColumn("path", F.concat("vec_id", "path")), root)
    return rd.audio_inventory(spark, f"{root}/**/*.wav")


@register(
    "src4_audio_inventory",
    with_ctes(
        "",
        """SELECT subject_id, device, CASE WHEN NOT named THEN 'unexpected name' WHEN sound THEN 'ok' ELSE 'unreadable' END AS status, CASE WHEN sound THEN rate END AS sample_rate,
        CASE WHEN sound THEN CAST(16 AS BIGINT) END AS bits, round(CASE WHEN sound THEN dur END, 9) + 0.0 AS duration_sec FROM wav""",
        _WAV,
    ),
)
def audio(spark, sf):
    return wav_files(spark, sf).select(
        "subject_id", "device", "status", "sample_rate", "bits", r9("duration_sec").alias("duration_sec")
    )


@register(
    "src5_subject_inventory",
    with_ctes(
        "timed",
        """SELECT a.subject_id, coalesce(p.n, 0) > 0 AS phone_available, coalesce(r.n, 0) > 0 AS recorder_available, coalesce(p.n, 0) > 0 AND coalesce(r.n, 0) > 0 AS paired_available,
        round(p.d, 9) + 0.0 AS phone_duration_sec, CAST(coalesce(r.n, 0) AS INTEGER) AS recorder_segments, round(r.d, 9) + 0.0 AS recorder_duration_sec,
        round(CASE WHEN p.n > 0 AND r.n > 0 THEN least(p.d, r.d) END, 9) + 0.0 AS common_duration_sec, a.n AS event_count
        FROM (SELECT CAST(subject_id AS VARCHAR) AS subject_id, count(*) AS n FROM timed WHERE event_type = 'error' GROUP BY 1) a
        LEFT JOIN (SELECT subject_id, count(*) AS n, sum(dur) AS d FROM wav WHERE ok AND device = 'S' GROUP BY 1) p ON p.subject_id = a.subject_id
        LEFT JOIN (SELECT subject_id, count(*) AS n, sum(dur) AS d FROM wav WHERE ok AND device = 'R' GROUP BY 1) r ON r.subject_id = a.subject_id""",
        _WAV,
    ),
)
def inventory(spark, sf):
    e = b.timed_events(spark, sf).filter("event_type = 'error'").groupBy(F.col("subject_id").cast("string").alias("subject_id"))
    notes = e.agg(F.count("*").alias("event_count"), F.lit(0).alias("awake_interval_count"))
    out = rd.subject_inventory(wav_files(spark, sf), notes)
    return out.select(
        "subject_id",
        "phone_available",
        "recorder_available",
        "paired_available",
        r9("phone_duration_sec").alias("phone_duration_sec"),
        "recorder_segments",
        r9("recorder_duration_sec").alias("recorder_duration_sec"),
        r9("common_duration_sec").alias("common_duration_sec"),
        "event_count",
    )


@register(
    "src6_clip_catalog",
    """SELECT 'R' AS device, url AS file_path, CASE WHEN contains(lower(split_part(url, '/', -1)), 'page') THEN 1 ELSE 0 END AS label, split_part(url, '/', -2) AS patient_id,
    substr(sha1('R|' || url), 1, 16) AS row_id FROM pages WHERE contains(lower(split_part(url, '/', -1)), 'page') OR contains(split_part(url, '/', -1), '#') OR contains(split_part(url, '/', -1), '5')""",
)
def clips(spark, sf):
    paths = b.table(spark, sf, "pages").select(F.col("url").alias("path"))
    return rd.clip_catalog(paths, "R", ["PAGE"], ["#", "5"]).select("device", "file_path", "label", "patient_id", "row_id")


@register(
    "src7_read_runs",
    """SELECT o_orderkey AS run_id, o_totalprice AS score FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 11 <> 0""",
)
def read_runs(spark, sf):
    path = shared_path(spark, "runs")
    o = b.table(spark, sf, "orders")
    record = F.to_json(
        F.struct(
            F.col("o_orderkey").alias("run_id"),
            F.when(F.col("o_orderstatus") == "F", "complete").otherwise("running").alias("status"),
            F.struct(F.col("o_totalprice").alias("score")).alias("metrics"),
        )
    )
    o.select(F.when(F.col("o_orderkey") % 11 == 0, F.substring(record, 1, 25)).otherwise(record).alias("value")).write.text(path)
    schema = T.StructType(
        [
            T.StructField("run_id", T.LongType()),
            T.StructField("status", T.StringType()),
            T.StructField("metrics", T.StructType([T.StructField("score", T.DoubleType())])),
        ]
    )
    return rd.read_runs(spark, path, schema).select("run_id", F.col("metrics.score").alias("score"))


@register(
    "src8_predictions_roundtrip",
    with_ctes(
        "results",
        """SELECT arm AS representation, classifier, protocol, fold, count(*) AS rows, count(DISTINCT subject_id) AS subjects, round(sum(probability), 4) + 0.0 AS total,
        CAST(sum(CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS predicted FROM results GROUP BY ALL""",
    ),
)
def predictions(spark, sf):
    path = shared_path(spark, "predictions")
    rows = b.b_results(spark, sf).select(
        F.concat_ws("-", "arm", "classifier", "protocol", "fold").alias("run_id"),
        "sample_id",
        F.col("sample_id").alias("logical_window_id"),
        F.col("subject_id").cast("string").alias("subject_id"),
        "device",
        "label",
        "probability",
        (F.col("probability") >= 0.5).cast("int").alias("prediction"),
        F.col("arm").alias("representation"),
        "classifier",
        "protocol",
        "fold",
    )
    sk.write_predictions(rows, path)
    back = rd.read_predictions(spark, path, b.N_FOLDS)
    return back.groupBy("representation", "classifier", "protocol", "fold").agg(
        F.count("*").alias("rows"),
        F.countDistinct("subject_id").alias("subjects"),
        (F.round(F.sum("probability"), 4) + 0.0).alias("total"),
        F.sum("prediction").alias("predicted"),
    )


@register(
    "src9_feature_store",
    with_ctes("", "SELECT vec_id AS sample_id, 32 AS size, round(embedding[33]::DOUBLE, 9) + 0.0 AS first FROM embeddings"),
)
def features(spark, sf):
    path = shared_path(spark, "features")
    sk.write_features(b.b_features(spark, sf), path)
    expected = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"))
    block = rd.read_features(spark, path, "high", expected)
    return block.select("sample_id", F.size("vector").alias("size"), r9(F.element_at("vector", 1).cast("double")).alias("first"))


@register("snk1_write_new", "SELECT event_type, count(*) AS rows FROM events GROUP BY 1")
def write_new(spark, sf):
    path = shared_path(spark, "new")
    sk.write_new(b.table(spark, sf, "events"), path, ["event_type"])
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("rows"))


@register("snk2_write_idempotent", "SELECT true AS first, false AS second, (SELECT count(*) FROM orders) AS rows")
def write_idempotent(spark, sf):
    path, orders = shared_path(spark, "once"), b.table(spark, sf, "orders")
    first = sk.write_idempotent(orders, path)
    second = sk.write_idempotent(orders, path)
    return spark.read.parquet(path).agg(F.count("*").alias("rows")).select(
        F.lit(first).alias("first"), F.lit(second).alias("second"), "rows"
    )


@register("snk3_append_log", "SELECT o_orderkey AS run_id, o_orderstatus AS status, CAST(NULL AS VARCHAR) AS note FROM orders")
def append_log(spark, sf):
    path = shared_path(spark, "log")
    runs = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"))
    for status in ("F", "O", "P"):
        sk.append_log(runs.filter(F.col("status") == status), path, ["run_id", "status", "note"])
    return spark.read.parquet(path)


# ---------------------------------------------------------------- streams


def event_stream(spark, sf):
    schema = b.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


@register(
    "sm1_stream_epochs",
    """SELECT user_id, event_type, epoch_ms(epoch_ms(date_trunc('day', ts)))::VARCHAR AS epoch_day, count(*) AS events, round(avg(value), 6) + 0.0 AS mean_value FROM events
    GROUP BY user_id, event_type, date_trunc('day', ts) HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
)
def stream_epochs(spark, sf):
    out = sj.run_to_table(sj.stream_epochs(event_stream(spark, sf), ["user_id", "event_type"], "1 day", "1 day"), "epochs")
    return out.select(
        "user_id", "event_type", F.date_format("epoch_start", "yyyy-MM-dd HH:mm:ss").alias("epoch_day"), "events", r6("mean_value").alias("mean_value")
    )


@register(
    "sm2_stream_runs",
    with_ctes(
        "runs series",
        """SELECT subject_id, round(s, 6) + 0.0 AS start_sec, round(e, 6) + 0.0 AS end_sec, round(max_drop, 6) + 0.0 AS max_drop, round(area, 3) + 0.0 AS area
        FROM runs r WHERE EXISTS (SELECT 1 FROM series x WHERE x.subject_id = r.subject_id AND x.t > r.e)""",
    ),
)
def stream_runs(spark, sf):
    """Closed runs only: a run still open at the end of the data is not emitted."""
    before = spark.conf.get(sj.PROVIDER_KEY, None)
    spark.conf.set(sj.PROVIDER_KEY, sj.ROCKS)
    try:
        path = shared_path(spark, "samples")
        # Arrival out of order: two files, each with samples of the whole time; a tick at the end lets the watermark pass all of them.
        series = stage(masked_series(spark, sf), "series")
        low, high = series.agg(F.min("t"), F.max("t")).first()
        delay = (high - low) + 60.0
        tick = spark.range(1).select(F.lit(-1).cast("long").alias("subject_id"), F.lit(high + 2 * delay).alias("t"), F.lit(0.0).alias("v"), F.lit(False).alias("masked"))
        for i in range(2):
            part = series.filter(F.pmod(F.xxhash64("subject_id", "t"), F.lit(2)) == i).select("subject_id", "t", "v", "masked")
            (part.unionByName(tick) if i == 1 else part).coalesce(1).write.mode("append").parquet(path)
        samples = spark.readStream.schema("subject_id long, t double, v double, masked boolean").option("maxFilesPerTrigger", 1).parquet(path)
        out = sj.run_to_table(sj.stream_runs(samples, b.DROP, b.MIN_DURATION, b.WINDOW, delay=delay), "stream-runs")
    finally:
        if before is None:
            spark.conf.unset(sj.PROVIDER_KEY)
        else:
            spark.conf.set(sj.PROVIDER_KEY, before)
    return out.select(
        "subject_id", r6("start").alias("start_sec"), r6("end").alias("end_sec"), r6("max_drop").alias("max_drop"), (F.round("area", 3) + 0.0).alias("area")
    )


@register(
    "sm3_stream_latest",
    with_ctes(
        "runlog",
        """SELECT experiment, arm, path, status, score FROM (SELECT *, row_number() OVER (PARTITION BY experiment, arm ORDER BY finished DESC, path) AS rn FROM runlog) WHERE rn = 1""",
    ),
)
def stream_latest(spark, sf):
    path = shared_path(spark, "runlog")
    runs = b.b_runs(spark, sf).withColumn("finished", F.col("finished").cast("timestamp"))
    runs.repartition(4, "path").write.parquet(path)
    stream = spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 2).parquet(path)
    return sj.stream_latest(stream, ["experiment", "arm"], "finished", "path").select("experiment", "arm", "path", "status", "score")

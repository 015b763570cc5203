"""Scalar and array function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..functions import scalars as fn
from ..functions.scalars import r6, r9
from ..functions.sql import register as register_sql
from . import bindings as b
from .oracle_ctes import with_ctes
from .registry import register

CLOCK_SQL = "(extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + extract(second FROM ts) + CASE WHEN extract(hour FROM ts) < 12 THEN 86400 ELSE 0 END)::DOUBLE"


def clocked(spark, sf):
    return b.table(spark, sf, "events").select("event_id", "user_id", "value", F.date_format("ts", "HH:mm:ss").alias("clock"))


@register("fn1_clock_to_seconds", f"SELECT event_id, {CLOCK_SQL} AS seconds FROM events")
def clock(spark, sf):
    return clocked(spark, sf).select("event_id", fn.clock_to_seconds("clock").alias("seconds"))


@register(
    "fn2_relative_to",
    with_ctes("timed", "SELECT event_id, round(t - min(t) OVER (PARTITION BY subject_id), 6) + 0.0 AS relative_sec FROM timed"),
)
def relative(spark, sf):
    e = b.timed_events(spark, sf)
    origin = e.groupBy("subject_id").agg(F.min("t").alias("record_start"))
    return e.join(origin, "subject_id").select("event_id", r6(fn.relative_to("t", "record_start")).alias("relative_sec"))


@register("fn3_stable_id", "SELECT event_id, substr(sha1(user_id || '|positive|' || event_id), 1, 16) AS id FROM events")
def ident(spark, sf):
    e = b.table(spark, sf, "events")
    return e.select("event_id", fn.stable_id("user_id", F.lit("positive"), "event_id").alias("id"))


@register(
    "fn4_experiment_key",
    """SELECT o_orderkey, substr(sha256('{"arm":"' || o_orderpriority || '","experiment":' || o_custkey || ',"status":"' || o_orderstatus || '"}'), 1, 16) AS "key" FROM orders""",
)
def key(spark, sf):
    o = b.table(spark, sf, "orders")
    return o.select(
        "o_orderkey", fn.experiment_key_column(status="o_orderstatus", experiment="o_custkey", arm="o_orderpriority").alias("key")
    )


@register(
    "fn5_safe_name",
    """SELECT page_id, substr(regexp_replace(replace(trim(url || ' x y'), ' ', '_'), '[^A-Za-z0-9_.-]', '', 'g'), 1, 180) AS name FROM pages""",
)
def safe(spark, sf):
    p = b.table(spark, sf, "pages")
    return p.select("page_id", fn.safe_name(F.concat("url", F.lit(" x y"))).alias("name"))


@register(
    "fn6_label_from_keywords",
    """SELECT o_orderkey, CASE WHEN lower(o_orderpriority) LIKE '%urgent%' OR lower(o_orderpriority) LIKE '%high%' THEN 1
    WHEN lower(o_orderpriority) LIKE '%low%' OR lower(o_orderpriority) LIKE '%not%' THEN 0 END AS label FROM orders""",
)
def label(spark, sf):
    o = b.table(spark, sf, "orders")
    return o.select("o_orderkey", fn.label_from_keywords("o_orderpriority", ["Urgent", "HIGH"], ["low", "NOT"]).alias("label"))


@register(
    "fn7_patient_from_path",
    """SELECT page_id, split_part(url, '/', -2) AS parent, split_part(url, '/', -3) AS grandparent,
    split_part(regexp_replace(split_part(url, '/', -1), '\\.[^.]*$', ''), '?', 1) AS prefix,
    coalesce(nullif(regexp_extract(url, 'page=([0-9]+)', 1), ''), split_part(url, '/', -2)) AS by_regex FROM pages""",
)
def patient(spark, sf):
    p = b.table(spark, sf, "pages")
    return p.select(
        "page_id",
        fn.patient_from_path("url", "parent").alias("parent"),
        fn.patient_from_path("url", "grandparent").alias("grandparent"),
        fn.patient_from_path("url", "filename_prefix", separator="?").alias("prefix"),
        fn.patient_from_path("url", "parent", regex="page=([0-9]+)").alias("by_regex"),
    )


@register(
    "fn9_sigmoid_clip",
    "SELECT event_id, round(1 / (1 + exp(-(CASE WHEN value - 50 > 30 THEN 30 WHEN value - 50 < -30 THEN -30 ELSE value - 50 END))), 9) + 0.0 AS probability FROM events",
)
def sigmoid(spark, sf):
    return b.table(spark, sf, "events").select("event_id", r9(fn.sigmoid_clip(F.col("value") - 50.0)).alias("probability"))


@register(
    "fn10_predict",
    """SELECT event_id, CAST(value / 100 >= 0.5 AS INTEGER) AS prediction, CAST(value >= 30 AS INTEGER) AS severe FROM events""",
)
def decide(spark, sf):
    return b.table(spark, sf, "events").select(
        "event_id",
        fn.predict(F.col("value") / 100.0).alias("prediction"),
        (fn.severity_bin("value") == "severe").cast("int").alias("severe"),
    )


@register("fn14_json_list", "SELECT event_id, round(value + user_id + 0.5::DOUBLE, 6) + 0.0 AS total, 3 AS items FROM events")
def jsons(spark, sf):
    text = F.concat(F.lit("["), F.concat_ws(",", "value", "user_id", F.lit("0.5")), F.lit("]"))
    e = b.table(spark, sf, "events").select("event_id", text.alias("text"))
    return e.select("event_id", r6(ar.json_sum("text")).alias("total"), F.size(ar.json_list("text")).alias("items"))


@register("fn15_reroot", "SELECT page_id, regexp_replace(url, '^.*?/en/', '/data/set/') AS path FROM pages")
def moved(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", fn.reroot("url", "en", "/data/set/").alias("path"))


def exploded(df, column, name="x"):
    return df.select("vec_id", F.posexplode(column).alias("position", name)).select("vec_id", "position", r9(name).alias(name))


UNNESTED = "e AS (SELECT vec_id, unnest(range(0, 64)) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@register(
    "fn16_peak_normalize",
    with_ctes("", "SELECT vec_id, CAST(p AS INTEGER) AS position, round(x / (max(abs(x)) OVER (PARTITION BY vec_id)), 9) + 0.0 AS x FROM e", UNNESTED),
)
def peak(spark, sf):
    e = b.table(spark, sf, "embeddings")
    return exploded(e.select("vec_id", ar.peak_normalize("embedding").alias("v")), "v")


def broken(spark, sf):
    """Embeddings with an undefined element in every third vector."""
    e = b.table(spark, sf, "embeddings")
    hole = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") % 3 == 0) & (i % 16 == 0), F.lit(float("nan"))).otherwise(x.cast("double")))
    return e.select("vec_id", hole.alias("embedding"))


@register(
    "fn17_finite_vectors",
    with_ctes(
        "",
        """SELECT vec_id, vec_id % 3 <> 0 AS finite, round(sum(CASE WHEN vec_id % 3 = 0 AND p % 16 = 0 THEN 0 ELSE x END), 9) + 0.0 AS total FROM e GROUP BY vec_id""",
        UNNESTED,
    ),
)
def finite(spark, sf):
    total = F.aggregate(ar.nan_to_zero("embedding"), F.lit(0.0), lambda acc, x: acc + x)
    return broken(spark, sf).select("vec_id", ar.is_finite("embedding").alias("finite"), r9(total).alias("total"))


@register(
    "fn18_fit_length",
    with_ctes(
        "",
        """SELECT vec_id, 'crop' AS how, CAST(p - 8 AS INTEGER) AS position, round(x, 9) + 0.0 AS x FROM e WHERE p >= 8 AND p < 56
        UNION ALL SELECT v.vec_id, 'pad', CAST(k AS INTEGER), round(coalesce(x, 0), 9) + 0.0 FROM (SELECT vec_id, unnest(range(0, 81)) AS k FROM embeddings) v LEFT JOIN e ON e.vec_id = v.vec_id AND e.p = k - 8""",
        UNNESTED,
    ),
)
def fitted(spark, sf):
    e = b.table(spark, sf, "embeddings")
    crop = exploded(e.select("vec_id", ar.fit_length("embedding", 48).alias("v")), "v").withColumn("how", F.lit("crop"))
    pad = exploded(e.select("vec_id", ar.fit_length("embedding", 81).alias("v")), "v").withColumn("how", F.lit("pad"))
    return crop.unionByName(pad)


@register(
    "fn19_chunk_weighted_mean",
    with_ctes(
        "",
        """SELECT vec_id, CAST(greatest(len // 10 + CASE WHEN len % 10 >= 4 THEN 1 ELSE 0 END, 1) AS INTEGER) AS pieces,
        CAST(CASE WHEN len % 10 >= 4 THEN len % 10 WHEN len < 10 THEN len ELSE 10 + len % 10 END AS INTEGER) AS last_size, round(m, 9) + 0.0 AS mean FROM (
        SELECT vec_id, vec_id % 64 + 1 AS len, avg(x) FILTER (p < vec_id % 64 + 1) AS m FROM e GROUP BY vec_id)""",
        UNNESTED,
    ),
)
def chunked(spark, sf):
    e = b.table(spark, sf, "embeddings").select(
        "vec_id", F.slice("embedding", F.lit(1), (F.col("vec_id") % 64 + 1).cast("int")).alias("v")
    )
    c = e.select("vec_id", ar.chunk("v", 10, 4).alias("c"))
    piece_mean = F.transform("c", lambda p: F.array(F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x.cast("double")) / F.size(p)))
    weights = F.transform("c", lambda p: F.size(p).cast("double"))
    return c.select(
        "vec_id",
        F.size("c").alias("pieces"),
        F.size(F.element_at("c", -1)).alias("last_size"),
        r9(F.element_at(ar.weighted_mean(piece_mean, weights), 1)).alias("mean"),
    )


@register(
    "ud1_sql_functions",
    f"""SELECT event_id, {CLOCK_SQL} AS seconds, substr(sha1(user_id || '|' || event_id), 1, 16) AS id,
    CASE WHEN value < 5 THEN 'normal' WHEN value < 15 THEN 'mild' WHEN value < 30 THEN 'moderate' ELSE 'severe' END AS severity,
    round(1 / (1 + exp(-least(value, 30))), 9) + 0.0 AS probability FROM events""",
)
def sql_functions(spark, sf):
    register_sql(spark)
    clocked(spark, sf).createOrReplaceTempView("pairedsense_clocked")
    return spark.sql(
        """SELECT event_id, clock_to_seconds(clock) AS seconds, stable_id(array(cast(user_id AS string), cast(event_id AS string))) AS id,
        severity_bin(value) AS severity, round(sigmoid_clip(value), 9) + 0D AS probability FROM pairedsense_clocked"""
    )

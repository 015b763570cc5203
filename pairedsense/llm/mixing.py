"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Sources share the words of the whole corpus by weight; one that would be taken
more than ``MAX_EPOCHS`` times is clamped there and the excess is reshared by
weight until none is above. Sorted by (cap / weight) the clamped sources are a
prefix, so the fixed point of the resharing is found with running sums over one
row per source.

Every document is taken ``whole`` times. The rest of a source's target is taken
in a seeded order of its documents: one repetition each up to a cut, and at the
cut the first words of one document, so that the words taken meet the target.
The cut is found on sums per digest prefix (65,536 per source) and inside one
prefix; it is one row per source, joined to the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

MAX_EPOCHS = 3
SEED = "mix-1"


def word_count(text: str = "text"):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for NULL."""
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit("[^ \\t-\\r]+"), F.lit(0))), F.lit(0)).cast("long")


def cycling_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """``sources`` with weights 1, 2, .. cycle, repeating in code point order, NULL last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", ((place - 1) % cycle + 1).cast("long"))


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``target`` of each row of (source, source_size, weight, ...); one row per source, all in one window.

    A source without words gets 0. Without any source the result is empty.
    """
    cap = F.lit(max_epochs) * F.col("source_size")
    rows = sources.withColumn("_cap", cap)
    whole = Window.partitionBy()
    before = whole.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    rows = rows.select(
        "*",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), zero)).alias("_left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), zero)).alias("_weights"),
    )
    # Above its cap with what is left for it and all later ones.
    over = F.col("_cap").cast("decimal(38,0)") * F.col("_weights") < F.col("weight").cast("decimal(38,0)") * F.col("_left")
    rows = rows.withColumn("_over", over)
    # Both fall along the order: the largest are those of the first source that is not clamped.
    left = F.max(F.when(~F.col("_over"), F.col("_left"))).over(whole)
    weights = F.max(F.when(~F.col("_over"), F.col("_weights"))).over(whole)
    share = (left * F.col("weight")).cast("double") / weights.cast("double")
    return rows.withColumn("target", F.when(F.col("_over"), F.col("_cap").cast("double")).otherwise(share)).drop("_cap", "_left", "_weights", "_over")


def mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = SEED, weigh=cycling_weights) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with __size, __source_size, __target, __whole, __part and __taken.

    A document is taken ``__whole`` times and then its first ``__part`` words;
    ``__taken`` = __whole * __size + __part.

    * A null text has no words; NULL is a source of its own, after all others.
    * Rows with an equal doc_id (and rows without one) tie in the seeded order and take the same part, never
      more than their size; the source then may be off its target by the tied rows.
    * All rows and columns stay. An empty table gives an empty result.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    narrow = stage(
        docs.select("source", word_count().alias("size"), key.alias("k")), "sizes"
    )
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stage(water_fill(weigh(sizes), max_epochs), "targets").select("source", "source_size", "target")
    full = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", full).withColumn(
        "rest", (F.round("target") - F.col("whole") * F.col("source_size")).cast("long")
    )
    prefix = F.substring("k", 1, 4)
    cells = narrow.groupBy("source", prefix.alias("cell")).agg(F.sum("size").alias("n"))
    order = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    at = cells.join(targets, cells["source"].eqNullSafe(targets["source"])).filter(
        (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n"))
    ).select(cells["source"].alias("s"), F.col("cell").alias("c"), "before", "rest")
    inside = narrow.join(at, narrow["source"].eqNullSafe(F.col("s")) & (prefix == F.col("c"))).groupBy("s", "before", "rest", "k").agg(
        F.sum("size").alias("n")
    )
    within = Window.partitionBy("s").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("from", F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    cut = inside.filter((F.col("from") <= F.col("rest")) & (F.col("rest") < F.col("from") + F.col("n"))).select(
        "s", F.col("k").alias("cut"), (F.col("rest") - F.col("from")).alias("part")
    )
    plan = stage(
        targets.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(
            F.col("source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"),
            "whole", F.col("cut").alias("__cut"), F.col("part").alias("__rest"),
        ).withColumnRenamed("whole", "__whole"),
        "plan",
    )
    out = docs.withColumn("__size", word_count()).withColumn("__k", key)
    out = out.join(plan, F.col("source").eqNullSafe(F.col("__s")), "left")
    part = (
        F.when(F.col("__cut").isNull() | (F.col("__k") > F.col("__cut")), F.lit(0).cast("long"))
        .when(F.col("__k") < F.col("__cut"), F.col("__size"))
        .otherwise(F.least("__rest", "__size"))
    )
    out = out.withColumn("__part", part).withColumn("__taken", F.col("__whole") * F.col("__size") + F.col("__part"))
    return out.drop("__s", "__k", "__cut", "__rest")


def summary(mixed: DataFrame) -> DataFrame:
    """Digest columns of a result of ``mix``."""
    return mixed.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        F.col("__taken").alias("taken"),
    )

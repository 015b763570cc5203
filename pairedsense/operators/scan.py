"""Running values over an ordered key whose rows are too many for one task.

A plain ``Window.partitionBy(subject).orderBy(t)`` puts all rows of a subject
into one task. Here every key is cut into chunks along its order; a window
works inside one chunk, one aggregated row per chunk carries the state across
chunks, and an equi-join on (key, chunk) brings the carry back. Results are
those of the plain window, and a key that holds a third of all rows is spread
over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` of sum, max, last; rows up to or before the current one."""

    kind: str
    value: Column
    order: tuple[str, ...]
    inclusive: bool = True
    descending: bool = False


def _directed(names: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(n).desc() if descending else F.col(n).asc() for n in names]


def _fold(spec: Running, value: Column) -> Column:
    if spec.kind == "sum":
        return F.sum(value)
    if spec.kind == "max":
        return F.max(value)
    return F.last(value, ignorenulls=True)


def _total(spec: Running) -> Column:
    if spec.kind != "last":
        return _fold(spec, spec.value)
    place = F.struct(*spec.order) if len(spec.order) > 1 else F.col(spec.order[0])
    position = F.when(spec.value.isNotNull(), place)
    return F.min_by(spec.value, position) if spec.descending else F.max_by(spec.value, position)


def running(df: DataFrame, by: Sequence[str], chunk: str, outputs: dict[str, Running]) -> DataFrame:
    """Add one column per output; ``chunk`` must grow with every order named in the outputs.

    A row whose key or chunk is NULL has no place in any order: it stays, with
    NULL in every output, and counts for no other row. Such rows are dealt by a
    hash, so that many of them don't meet in one task.
    """
    by = list(by)
    known = F.col(chunk).isNotNull()
    for k in by:
        known = known & F.col(k).isNotNull()
    spread = F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind]), F.lit(4096))
    df, columns = df.withColumn("_lost", F.when(~known, spread)), df.columns
    cell = Window.partitionBy(*by, chunk, "_lost")
    placed = df.repartition(*[F.col(k) for k in by], F.col(chunk), F.col("_lost"))
    first = {c: f"_first_{c}" for s in outputs.values() for c in s.order}
    totals = df.filter("_lost is null").groupBy(*by, chunk).agg(
        *[_total(s).alias(f"_tot_{n}") for n, s in outputs.items()],
        *[F.min(c).alias(name) for c, name in first.items()],
    )
    carried = totals.select(
        *by,
        chunk,
        *[
            _fold(s, F.col(f"_tot_{n}"))
            .over(
                Window.partitionBy(*by)
                .orderBy(*_directed([chunk, *[first[c] for c in s.order]], s.descending))
                .rowsBetween(Window.unboundedPreceding, -1)
            )
            .alias(f"_carry_{n}")
            for n, s in outputs.items()
        ],
    )
    local = placed.select(
        "*",
        *[
            _fold(s, s.value)
            .over(
                cell.orderBy(*_directed(s.order, s.descending)).rowsBetween(
                    Window.unboundedPreceding, 0 if s.inclusive else -1
                )
            )
            .alias(f"_local_{n}")
            for n, s in outputs.items()
        ],
    )
    joined = local.join(carried, [*by, chunk], "left")
    for name, spec in outputs.items():
        here, before = F.col(f"_local_{name}"), F.col(f"_carry_{name}")
        if spec.kind == "sum":
            out = F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
        elif spec.kind == "max":
            out = F.greatest(here, before)
        else:
            out = F.coalesce(here, before)
        joined = joined.withColumn(name, F.when(F.col("_lost").isNull(), out))
    return joined.select(*columns, *outputs)


def time_chunk(t: Column | str, seconds: float) -> Column:
    t = F.col(t) if isinstance(t, str) else t
    return F.floor(t / F.lit(float(seconds))).cast("long")


def hash_chunk(key: Column | str, digits: int = 3) -> Column:
    """Leading hex digits of a digest: a chunk that grows with the digest order."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("long")


def numbered(df: DataFrame, by: Sequence[str], digest: str, name: str, digits: int = 3, tie: Sequence[str] = ()) -> DataFrame:
    """1-based row number within ``by`` in digest order, without one task per key."""
    staged = df.withColumn("_chunk", hash_chunk(digest, digits)).withColumn("_one", F.lit(1).cast("long"))
    keys = list(by)
    if not keys:
        staged, keys = staged.withColumn("_all", F.lit(0)), ["_all"]
    out = running(staged, keys, "_chunk", {name: Running("sum", F.col("_one"), (digest, *tie))})
    return out.drop("_chunk", "_one", "_all")


def neighbours(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_t: str,
    right_t: str,
    right_seq: str,
    payload: Sequence[str],
    seconds: float,
) -> DataFrame:
    """For every left row the nearest right row at or before it and the nearest after it.

    Adds structs ``prev`` and ``next`` with ``t`` and the payload. Among right
    rows at one time the lowest sequence number is taken.
    """
    by = list(by)
    packed = F.struct(F.col(right_t).cast("double").alias("t"), *[F.col(p) for p in payload])
    points = right.select(
        *by,
        F.lit(0).alias("_kind"),
        F.col(right_t).cast("double").alias("_t"),
        F.col(right_seq).cast("long").alias("_seq"),
        packed.alias("_right"),
        F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"),
    )
    rows = left.select(
        *by,
        F.lit(1).alias("_kind"),
        F.col(left_t).cast("double").alias("_t"),
        F.lit(None).cast("long").alias("_seq"),
        F.lit(None).cast(right.select(packed).schema[0].dataType).alias("_right"),
        F.struct(*left.columns).alias("_row"),
    )
    both = points.unionByName(rows).withColumn("_chunk", time_chunk("_t", seconds)).withColumn("_back", -F.col("_seq"))
    seen = running(
        both,
        by,
        "_chunk",
        {
            "prev": Running("last", F.col("_right"), ("_t", "_kind", "_back")),
            "next": Running("last", F.col("_right"), ("_t", "_kind", "_seq"), inclusive=False, descending=True),
        },
    )
    return seen.filter(F.col("_kind") == 1).select("_row.*", "prev", "next")

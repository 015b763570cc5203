"""Cumulative counts, mid-ranks and exact quantiles of any number of groups.

Rows are first reduced to one row per (group, value), so a value held by a
third of all rows is one row; these rows are written once and read by the passes
after. Groups of up to ``WHOLE`` distinct values are scanned by one window. Where a group is
larger, its values are cut into cells at the quantiles of a mergeable sketch, one cell
for about ``CELL_ROWS`` of its values (at most ``CELLS``), and ``scan.running`` counts
over the cells: the number of tasks grows with the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .scan import Running, running

CELLS = 4096
CELL_ROWS = 4096
FINE = 64  # cells that a second search tells apart
WHOLE = 1 << 16
SKETCH = 16384


def _cells(df: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(keys, coarse edges) and (keys, coarse cell, fine edges) of the rows of ``df``; the edges are written once, so that every branch and retried task sees the same."""
    sketch = F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH)
    every = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)]))
    # A power of two, so that each number of cells takes every 2**k-th edge.
    wanted = F.pow(2.0, F.ceil(F.log2(F.greatest(F.count("*") / CELL_ROWS, F.lit(1.0)))))
    step = (F.lit(CELLS) / F.least(wanted, F.lit(float(CELLS)))).cast("int")
    grid = df.groupBy(*keys).agg(every.alias("_q"), step.alias("_step"))
    edges = stage(grid.select(*keys, F.filter("_q", lambda e, i: (i + 1) % F.col("_step") == 0).alias("_e")), "edges")
    coarse = edges.select(*keys, F.filter("_e", lambda e, i: (i + 1) % FINE == 0).alias("_edges"))
    parts = F.sequence(F.lit(0), F.floor(F.size("_e") / FINE).cast("int"))
    fine = edges.select(*keys, "_e", F.explode(parts).alias("_coarse")).select(*keys, "_coarse", F.slice("_e", F.col("_coarse") * FINE + 1, F.lit(FINE - 1)).alias("_edges"))
    return coarse, fine


def _place(df: DataFrame, cells: tuple[DataFrame, DataFrame], keys: list[str], value: str) -> DataFrame:
    """Add ``_cell``, a number that grows with the value: the coarse edges are looked at, then those between two of them."""
    coarse, fine = cells
    below = F.size(F.filter("_edges", lambda e: e < F.col(value).cast("double")))
    first = df.join(coarse, keys).withColumn("_coarse", below).drop("_edges")
    placed = first.join(fine, [*keys, "_coarse"]).withColumn("_fine", below).drop("_edges")
    # Never NULL, so that no later test of it writes the search out once more.
    return placed.withColumn("_cell", F.coalesce((F.col("_coarse") * FINE + F.col("_fine")).cast("long"), F.lit(0).cast("long"))).drop("_coarse", "_fine")


def _largest(df: DataFrame, keys: list[str]) -> int:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def with_cells(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add ``_cell``: cells of about equal load per key that grow with the value; one cell if all keys are short."""
    keys = list(keys)
    if _largest(df, keys) <= WHOLE:
        return df.withColumn("_cell", F.lit(0).cast("long"))
    return _place(df, _cells(df, keys, value), keys, value)


def cumulative(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    counters: dict[str, Column],
    descending: bool = False,
) -> DataFrame:
    """One row per (group, value): each counter, its running sum ``<name>_cum`` and group total ``<name>_all``.

    The running sum includes the value itself.
    """
    by = list(by)
    keys = by or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    reduced = base.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[F.sum(c).alias(n) for n, c in counters.items()])
    reduced = stage(reduced, "reduced")
    if _largest(reduced, keys) <= WHOLE:
        group = Window.partitionBy(*keys)
        upto = group.orderBy(F.col(value).desc() if descending else F.col(value)).rowsBetween(Window.unboundedPreceding, 0)
        sums = [F.sum(n).over(upto).alias(f"{n}_cum") for n in counters]
        totals = [F.sum(n).over(group).alias(f"{n}_all") for n in counters]
        known = reduced.filter(" and ".join(f"`{k}` is not null" for k in keys))
        return known.select(*by, value, *counters, *sums, *totals)
    totals = reduced.groupBy(*keys).agg(*[F.sum(n).alias(f"{n}_all") for n in counters])
    placed = _place(reduced, _cells(reduced, keys, value), keys, value).join(stage(totals, "totals"), keys)
    out = running(
        placed,
        keys,
        "_cell",
        {f"{n}_cum": Running("sum", F.col(n), (value,), descending=descending) for n in counters},
    )
    return out.select(
        *by, value, *counters, *[f"{n}_cum" for n in counters], *[f"{n}_all" for n in counters]
    )


def mid_ranks(df: DataFrame, by: Sequence[str], value: str, counters: dict[str, Column] | None = None, **kw) -> DataFrame:
    """One row per (group, value) with ``n`` and the mid-rank shared by its ties."""
    counters = {"n": F.lit(1).cast("long"), **(counters or {})}
    out = cumulative(df, by, value, counters, **kw)
    return out.withColumn("mid_rank", F.col("n_cum") - (F.col("n") - F.lit(1)) / F.lit(2.0))


def quantiles(df: DataFrame, by: Sequence[str], columns: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact linear-interpolation quantiles: ``{output: (value column, probability)}`` per group.

    ``percentile`` holds every distinct value of a group in one task; this
    keeps only the one or two values next to each wanted position.
    """
    by = list(by)
    results = None
    for value in dict.fromkeys(c for c, _ in columns.values()):
        wanted = {out: p for out, (c, p) in columns.items() if c == value}
        ranked = cumulative(df.filter(F.col(value).isNotNull()), by, value, {"n": F.lit(1).cast("long")})
        before = F.col("n_cum") - F.col("n")

        def at(index: Column, value: str = value) -> Column:
            return F.max(F.when((before <= index) & (index < F.col("n_cum")), F.col(value).cast("double")))

        picks = []
        for out, p in wanted.items():
            spot = F.lit(float(p)) * (F.col("n_all") - 1)
            low = F.floor(spot)
            high = F.least(low + 1, F.col("n_all") - 1)
            picks += [at(low).alias(f"_lo_{out}"), at(high).alias(f"_hi_{out}"), F.max(spot - low).alias(f"_fr_{out}")]
        part = (ranked.groupBy(*by) if by else ranked).agg(*picks)
        part = part.select(
            *by,
            *[
                (F.col(f"_lo_{o}") + (F.col(f"_hi_{o}") - F.col(f"_lo_{o}")) * F.col(f"_fr_{o}")).alias(o)
                for o in wanted
            ],
        )
        if results is None:
            results = part
        else:
            results = results.join(part, by, "full") if by else results.crossJoin(part)
    return results

"""Median of all pairwise slopes by slope selection, without a row per pair.

A slope m lies above the slope of a pair (i left of j) exactly if y - m x puts j
below i, so the slopes below m are the inversions of the order by x when the
points are ordered by y - m x. They are counted on Spark: the x-ranks are cut
bit by bit, and at every bit a point of the right half counts the points of the
left half above it, a window inside a group of bounded size. So a count costs
points x bits rows. Each key's bracket around the median is narrowed with
sampled slopes until it holds a few slopes a point; the pairs inside have changed
places between the orders at its two ends, and only they become rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .ranks import cumulative, quantiles, with_cells
from .scan import Running, numbered, running

FEW = 4  # slopes a point that may be left in a bracket
GROUP_BITS = 12  # groups of up to 2**12 x-ranks stay whole, larger ones are cut into cells of y - m x
ROUNDS = 12
SMALL = 64  # keys of up to so many points have all their pairs formed


def inversions(points: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """(keys, below) for points (keys, _code, _r): the pairs with a smaller code on the left and a smaller _r on the right.

    ``bits`` is the length of the largest code. Points with equal codes form no pair.
    """
    keys = list(keys)
    if bits > GROUP_BITS:
        points = with_cells(points, keys, "_r")
    else:
        points = points.withColumn("_cell", F.lit(0).cast("long"))
    level = F.explode(F.sequence(F.lit(1), F.lit(max(bits, 1))))
    rows = points.withColumn("_level", level).select(
        *keys, "_level", "_r",
        F.expr("shiftright(_code, _level)").alias("_group"),
        F.expr("shiftright(_code, _level - 1) & 1").alias("_right"),
        F.when(F.col("_level") > GROUP_BITS, F.col("_cell")).otherwise(F.lit(0).cast("long")).alias("_cell"),
    )
    group = [*keys, "_level", "_group"]
    # Among equal _r the right half comes first, so equals are not counted.
    above = Window.partitionBy(*group, "_cell").orderBy(F.col("_r").desc(), F.col("_right").desc()).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("_above", F.sum(1 - F.col("_right")).over(above))
    cells = inside.groupBy(*group, "_cell").agg(
        F.sum(F.col("_right") * F.col("_above")).alias("_pairs"), F.sum("_right").alias("_rights"), F.sum(1 - F.col("_right")).alias("_lefts")
    )
    higher = Window.partitionBy(*group).orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    across = cells.withColumn("_higher", F.coalesce(F.sum("_lefts").over(higher), F.lit(0)))
    return across.groupBy(*keys).agg(F.sum(F.col("_pairs") + F.col("_rights") * F.col("_higher")).cast("long").alias("below"))


def _between(points: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """(by, slope) of the pairs that are in order at ``lo`` and inverted at ``hi``.

    A point is repeated for every place between its two positions; two points that change places share one.
    """
    placed = stage(points.join(state.select(*by, "lo", "hi"), by).select(*by, "_x", "_y", "_i", "_code", (F.col("_y") - F.col("lo") * F.col("_x")).alias("_u"), (F.col("_y") - F.col("hi") * F.col("_x")).alias("_w")), "ends")
    one = F.lit(1).cast("long")
    ranked = placed
    for value, name in (("_u", "_pu"), ("_w", "_pw")):
        ranked = running(with_cells(ranked, by, value), by, "_cell", {name: Running("sum", one, (value, "_code", "_y", "_i"))}).drop("_cell")
    first, last = F.least("_pu", "_pw"), F.greatest("_pu", "_pw")
    moved = stage(ranked.select(*by, "_x", "_y", "_code", "_pu", "_pw", first.alias("_first"), F.explode(F.sequence(first, last)).alias("_place")), "moved")
    other = moved.select(*by, "_place", *[F.col(c).alias(f"{c}2") for c in ("_x", "_y", "_code", "_pu", "_pw", "_first")])
    pairs = moved.join(other, [*by, "_place"]).filter(
        (F.col("_pu") < F.col("_pu2")) & (F.col("_pw") > F.col("_pw2")) & (F.col("_code") < F.col("_code2")) & (F.col("_place") == F.greatest("_first", "_first2"))
    )
    return pairs.select(*by, F.try_divide(F.col("_y2") - F.col("_y"), F.col("_x2") - F.col("_x")).alias("slope"))


def median_slopes(points: DataFrame, by: Sequence[str], few: int = FEW, small: int = SMALL) -> DataFrame:
    """(by, slope): the median of (y2 - y1) / (x2 - x1) over all pairs with x1 < x2 of points (by, _i, _x, _y).

    ``_i`` tells the points of a key apart. Points without x or y form no pair; a key without a pair has no row.
    Slopes closer together than a billionth of a thousandth of the key's range are not told apart.
    """
    by = list(by)
    points = stage(points.filter(F.col("_x").isNotNull() & F.col("_y").isNotNull()).select(*by, "_i", "_x", "_y"), "known")
    sizes = points.groupBy(*by).agg(F.count("*").alias("n"))
    crowded = sizes.filter(F.col("n") > small).select(*by)
    # The pairs of a short key are at most ``small`` to a point.
    short = points.join(sizes.filter(F.col("n") <= small).select(*by), by)
    other = short.select(*by, F.col("_x").alias("_x2"), F.col("_y").alias("_y2"))
    pairs = short.join(other, by).filter(F.col("_x2") > F.col("_x")).select(*by, F.try_divide(F.col("_y2") - F.col("_y"), F.col("_x2") - F.col("_x")).alias("_slope"))
    out = quantiles(pairs, by, {"slope": ("_slope", 0.5)}).filter(F.col("slope").isNotNull())
    if crowded.isEmpty():
        return out
    return out.unionByName(_selected(points.join(crowded, by), by, few))


def _selected(known: DataFrame, by: list[str], few: int) -> DataFrame:
    """``median_slopes`` by selection."""
    codes = cumulative(known.select(*by, "_x").distinct(), by, "_x", {"_c": F.lit(1).cast("long")})
    origin = known.groupBy(*by).agg(F.min("_x").alias("_x0"), F.min("_y").alias("_y0"), F.count("*").alias("n"))
    coded = stage(
        known.join(codes.select(*by, "_x", (F.col("_c_cum") - 1).alias("_code")), [*by, "_x"]).join(origin, by)
        .select(*by, "_i", (F.col("_x") - F.col("_x0")).alias("_x"), (F.col("_y") - F.col("_y0")).alias("_y"), "_code", "n"),
        "coded",
    )
    columns = coded.groupBy(*by, "_code").agg(F.max("_x").alias("_x"), F.min("_y").alias("_low"), F.max("_y").alias("_high"), F.count("*").alias("_ties"), F.max("n").alias("n"))
    columns = stage(columns, "columns")
    # The least and the greatest slope stand between neighbours in x.
    right = columns.select(*by, (F.col("_code") - 1).alias("_code"), F.col("_x").alias("_x2"), F.col("_low").alias("_low2"), F.col("_high").alias("_high2"))
    width = F.col("_x2") - F.col("_x")
    ends = columns.join(right, [*by, "_code"]).groupBy(*by).agg(
        F.min((F.col("_low2") - F.col("_high")) / width).alias("lo"), F.max((F.col("_high2") - F.col("_low")) / width).alias("hi")
    )
    pairs = columns.groupBy(*by).agg(
        F.max("n").alias("n"), F.sum(F.col("_ties") * (F.col("_ties") - 1)).alias("_tied"), F.max("_code").alias("_top"),
        F.max("_x").alias("_wide"), F.max("_high").alias("_tall"),
    ).withColumn("pairs", F.expr("(n * (n - 1) - _tied) div 2"))
    margin = lambda c: (F.abs(c) + 1) * 1e-6
    state = stage(
        pairs.join(ends, by).select(
            *by, "n", "_top", F.expr("(pairs - 1) div 2").alias("p1"), F.expr("pairs div 2").alias("p2"),
            (F.col("lo") - margin(F.col("lo"))).alias("lo"), (F.col("hi") + margin(F.col("hi"))).alias("hi"),
            F.lit(0).cast("long").alias("f_lo"), F.col("pairs").alias("f_hi"), (F.col("_tall") / F.col("_wide") * 1e-12).alias("grain"),
        ),
        "state",
    )
    narrow = (F.col("hi") - F.col("lo")) <= F.col("grain") * 4 + F.greatest(F.abs("lo"), F.abs("hi")) * 4e-15
    crowded = (F.col("f_hi") - F.col("f_lo") > few * F.col("n")) & ~narrow & (F.col("grain") > 0)
    sample = None
    for _ in range(ROUNDS):
        top = state.filter(crowded).agg(F.max("_top")).first()[0]
        if top is None:
            break
        if sample is None:
            sample = stage(_sampled(coded.join(state.filter(crowded).select(*by), by), by), "sample")
        aims = _aims(sample, state.filter(crowded), by)
        tried = stage(aims, "aims")
        if tried.isEmpty():
            break
        shifted = coded.join(tried, by).select(*by, "_aim", "_code", (F.col("_y") - F.col("_aim") * F.col("_x")).alias("_r"))
        counts = tried.join(inversions(shifted, [*by, "_aim"], int(top).bit_length()), [*by, "_aim"], "left").withColumn("below", F.coalesce("below", F.lit(0)))
        found = state.select(*by, "p1", "p2").join(counts, by).groupBy(*by).agg(
            F.max(F.when(F.col("below") <= F.col("p1"), F.struct("_aim", "below"))).alias("_l"), F.min(F.when(F.col("below") > F.col("p2"), F.struct("_aim", "below"))).alias("_h")
        )
        state = stage(
            state.join(found, by, "left").select(
                *by, "n", "_top", "p1", "p2", F.coalesce("_l._aim", "lo").alias("lo"), F.coalesce("_h._aim", "hi").alias("hi"),
                F.coalesce("_l.below", "f_lo").alias("f_lo"), F.coalesce("_h.below", "f_hi").alias("f_hi"), "grain",
            ),
            "state",
        )
    sure = state.filter(narrow | (F.col("grain") <= 0)).select(*by, F.when(F.col("grain") > 0, (F.col("lo") + F.col("hi")) / 2).otherwise(F.lit(0.0)).alias("slope"))
    rest = state.filter(~(narrow | (F.col("grain") <= 0)))
    ranked = cumulative(_between(coded, rest, by), by, "slope", {"k": F.lit(1).cast("long")}).join(rest.select(*by, "p1", "p2", "f_lo"), by)

    def at(p: str):
        place = F.col(p) - F.col("f_lo")
        return F.max(F.when((F.col("k_cum") - F.col("k") <= place) & (place < F.col("k_cum")), F.col("slope")))

    middle = ranked.groupBy(*by).agg(((at("p1") + at("p2")) / 2).alias("slope"))
    return sure.unionByName(middle)


def _sampled(coded: DataFrame, by: list[str]) -> DataFrame:
    """(by, slope): about two slopes a point, of points that a digest pairs."""
    dealt = numbered(coded.withColumn("_h", F.md5(F.col("_i").cast("string"))), by, "_h", "_k", tie=("_i",)).withColumn("_k", F.col("_k") - 1)
    dealt = stage(dealt.select(*by, "_k", "_x", "_y", "n"), "dealt")
    mates = F.explode(F.array(F.expr("(_k * 7919 + 1) % n"), F.expr("(_k * 104729 + n div 2) % n")))
    left = dealt.select(*by, F.col("_x").alias("_x1"), F.col("_y").alias("_y1"), mates.alias("_k"))
    both = left.join(dealt, [*by, "_k"]).filter(F.col("_x1") != F.col("_x"))
    return both.select(*by, F.try_divide(F.col("_y1") - F.col("_y"), F.col("_x1") - F.col("_x")).alias("slope"))


def _aims(sample: DataFrame, crowded: DataFrame, by: list[str]) -> DataFrame:
    """(by, _aim): for each key two slopes of the sample that stand closely around the place where the median must be."""
    inside = sample.join(crowded, by).filter((F.col("slope") > F.col("lo")) & (F.col("slope") < F.col("hi")))
    ranked = cumulative(inside, by, "slope", {"k": F.lit(1).cast("long")}).join(crowded, by)
    share = (F.col("p1") - F.col("f_lo")) / (F.col("f_hi") - F.col("f_lo"))
    spread = F.sqrt(F.col("k_all") * share * (1 - share)) * 2 + 1
    low = F.greatest(F.floor(share * F.col("k_all") - spread), F.lit(0))
    high = F.least(F.ceil(share * F.col("k_all") + spread), F.col("k_all") - 1)
    here = lambda place: F.max(F.when((F.col("k_cum") - F.col("k") <= place) & (place < F.col("k_cum")), F.col("slope")))
    # A little beside the sampled slope, so that no pair is at a tie with the aim.
    step = F.greatest((F.max("hi") - F.max("lo")) * 1e-7, F.max("grain"))
    picked = ranked.groupBy(*by).agg((here(low) - step).alias("a"), (here(high) + step).alias("b"))
    return picked.select(*by, F.explode(F.array("a", "b")).alias("_aim")).filter(F.col("_aim").isNotNull()).distinct()

"""Duration-matched negatives: one free stretch per event, and the window manifest built from them.

An event of duration d may start anywhere in a free stretch at least d long;
stretches are drawn with probability proportional to slack + 1e-6. Laying the
stretches of a key end to end by *falling length* makes the eligible ones a
prefix for every d, with cumulative weight S_j - j * (d - 1e-6), where S_j is
the running sum of lengths. So an event needs two searches over one sorted
list, not a pair with every stretch. The list is kept as a static tree: a leaf holds up
to ``FANOUT`` stretches, a node above the last stretch of each of up to ``FANOUT``
children, one row per node. An event goes down by one equi-join per level, so
no array grows with the stretches of a key. An entry keeps the true end of its
stretch: start + length may round past it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import stable_id, text_draw
from ..session import cut_lineage, stage
from .intervals import DAY, complement_intervals, overlap_earlier
from .ranks import with_cells
from .scan import Running, running

EPS = 1e-6
TOL = 1e-9
FANOUT = 128


def stretch_tree(gaps: DataFrame, by: Sequence[str]) -> list[DataFrame]:
    """Levels of the tree from the leaves to the roots: (by, node, entries), an entry being (j, s, len, g, z) of a stretch from g to z.

    All keys have the same number of levels; a key's root is node 0 of the last.
    """
    by = list(by)
    sized = gaps.select(*by, F.col("start").alias("g"), F.col("end").alias("z"), (F.col("end") - F.col("start")).alias("len"))
    # Cells grow with falling length, so the running order and the cell order agree.
    placed = with_cells(sized.withColumn("_short", -F.col("len")), by, "_short")
    entries = running(
        placed,
        by,
        "_cell",
        {
            "j": Running("sum", F.lit(1).cast("long"), ("_short", "g")),
            "s": Running("sum", F.col("len"), ("_short", "g")),
        },
    ).select(*by, (F.col("j") - 1).alias("place"), F.struct("j", "s", "len", "g", "z").alias("entry"))
    levels: list[DataFrame] = []
    while True:
        held = F.transform(F.array_sort(F.collect_list(F.struct("place", "entry"))), lambda e: e["entry"])
        level = entries.groupBy(*by, F.expr(f"place div {FANOUT}").alias("node")).agg(held.alias("entries"))
        levels.append(stage(level, "level"))
        if (levels[-1].agg(F.max("node")).first()[0] or 0) == 0:
            return levels
        entries = levels[-1].select(*by, F.col("node").alias("place"), F.element_at("entries", -1).alias("entry"))


def place_negatives(
    events: DataFrame, gaps: DataFrame, by: Sequence[str], seq: str, seed: int = 42, attempt: int = 0, inside: bool = False
) -> DataFrame:
    """One placed negative per event; an event longer than every free stretch is dropped.

    ``end`` is start + duration, which may round past the end of the stretch; ``inside`` stops it there.
    """
    by = list(by)
    levels = stretch_tree(gaps, by)
    want = events.select(
        *by, seq, F.col("start").alias("event_start"), F.col("end").alias("event_end"), (F.col("end") - F.col("start")).alias("d")
    )

    def fits(e: Column) -> Column:
        return e["len"] - F.col("d") >= -TOL

    def weight_upto(e: Column) -> Column:
        return e["s"] - e["j"] * (F.col("d") - EPS)

    def ending(entries: Column, at: int, *otherwise: Column) -> Column:
        """An entry of a filtered list, which is written once so that it is searched once; the next choice if the list is empty."""
        return F.coalesce(F.try_element_at(entries, F.lit(at)), *otherwise)

    def descend(rows: DataFrame, keep: list[str], passed, best: Column) -> DataFrame:
        """From the roots to the leaves, past the children that ``passed`` holds for; ``_best`` is the last entry that was passed."""
        step = rows.select(*keep, F.lit(0).cast("long").alias("node"), best.alias("_best"))
        for level in reversed(levels[1:]):
            left = F.filter("entries", passed)
            child = F.least(F.size(left), F.size("entries") - 1)
            step = step.join(level, [*by, "node"]).select(
                *keep, (F.col("node") * FANOUT + child).alias("node"), ending(left, -1, F.col("_best")).alias("_best")
            )
        return step.join(levels[0], [*by, "node"])

    # The end of the eligible prefix gives its weight, and that the place to aim at.
    nothing = F.lit(None).cast(levels[0].schema["entries"].dataType.elementType)
    eligible = F.filter("entries", fits)
    ended = descend(want, want.columns, fits, nothing).withColumn("_best", ending(eligible, -1, F.col("_best")))
    aimed = ended.select(*want.columns, (text_draw(f"{seed}:{attempt}", *by, seq) * weight_upto(F.col("_best"))).alias("aim")).filter(F.col("aim").isNotNull())
    # The first stretch whose cumulative weight reaches the aim; the last eligible one if rounding leaves none.
    found = descend(aimed, [*want.columns, "aim"], lambda e: fits(e) & (weight_upto(e) < F.col("aim")), nothing)
    hit = F.filter("entries", lambda e: fits(e) & (weight_upto(e) >= F.col("aim")))
    chosen = ending(hit, 1, ending(eligible, -1, F.col("_best")))
    step = found.select(*want.columns, "aim", chosen.alias("_e"))
    slack = F.greatest(F.col("_e.len") - F.col("d"), F.lit(0.0))
    before = weight_upto(F.col("_e")) - (F.col("_e.len") - F.col("d") + EPS)
    share = F.least(F.greatest((F.col("aim") - before) / (slack + EPS), F.lit(0.0)), F.lit(1.0))
    begin = F.col("_e.g") + share * slack
    end = begin + F.col("d")
    if inside:
        begin, end = F.least(begin, F.col("_e.z")), F.least(end, F.col("_e.z"))
    return step.select(*by, seq, "event_start", "event_end", begin.alias("start"), end.alias("end"))


def place_flagged(
    events: DataFrame, gaps: DataFrame, by: Sequence[str], seq: str, seed: int = 42, bin_seconds: float = DAY
) -> DataFrame:
    """One pass: negatives drawn independently, those over an earlier one flagged ``fallback``."""
    placed = stage(place_negatives(events, gaps, by, seq, seed), "placed")
    return overlap_earlier(placed, by, seq, bin_seconds).withColumnRenamed("overlaps_earlier", "fallback")


def place_strict(
    events: DataFrame,
    blocked: DataFrame,
    bounds: DataFrame,
    by: Sequence[str],
    seq: str,
    seed: int = 42,
    chunk_seconds: float = DAY,
) -> DataFrame:
    """Negatives that avoid each other; only an event without any place left overlaps, with ``fallback`` true.

    Works in rounds over all keys at once. In a round every waiting event draws
    a place in what is still free; a draw over one of a lower sequence number
    waits for the next round. The lowest waiting event of a key always settles,
    so the rounds end; each is checkpointed to keep the lineage flat.
    """
    by = list(by)
    first_free = cut_lineage(complement_intervals(blocked, bounds, by, chunk_seconds))
    free, waiting, settled = first_free, cut_lineage(events.select(*by, seq, "start", "end")), None
    attempt = 0
    while not waiting.isEmpty():
        drawn = overlap_earlier(place_negatives(waiting, free, by, seq, seed, attempt, inside=True), by, seq, chunk_seconds)
        drawn = cut_lineage(drawn)
        kept = drawn.filter(~F.col("overlaps_earlier")).drop("overlaps_earlier").withColumn("fallback", F.lit(False))
        placeless = waiting.join(drawn.select(*by, seq), [*by, seq], "left_anti")
        last = place_negatives(placeless, first_free, by, seq, seed, attempt, inside=True).withColumn("fallback", F.lit(True))
        now = kept.unionByName(last)
        settled = cut_lineage(now if settled is None else settled.unionByName(now))
        waiting = cut_lineage(
            drawn.filter(F.col("overlaps_earlier")).select(
                *by, seq, F.col("event_start").alias("start"), F.col("event_end").alias("end")
            )
        )
        taken = blocked.select(*by, "start", "end").unionByName(settled.select(*by, "start", "end"))
        free = cut_lineage(complement_intervals(taken, bounds, by, chunk_seconds))
        attempt += 1
    if settled is None:
        settled = place_negatives(waiting, free, by, seq, seed).withColumn("fallback", F.lit(False))
    return settled


def build_manifest(placed: DataFrame, types: DataFrame, devices: DataFrame, by: str = "subject_id", seq: str = "seq") -> DataFrame:
    """Window rows: every placed event and its negative, for every device.

    ``types`` gives (subject, seq, event_type, sleep_stage); ``devices`` is the
    two-row device dimension.
    """
    full = placed.join(types, [by, seq])
    positive_id = stable_id(by, F.lit("positive"), seq, F.round("event_start", 6).cast("decimal(20,6)"), F.round("event_end", 6).cast("decimal(20,6)"))
    negative_id = stable_id(by, F.lit("negative"), seq, F.round("start", 3).cast("decimal(20,3)"), F.round("end", 3).cast("decimal(20,3)"))
    # The digests are computed here, once per event; both are read more than once below.
    named = full.select("*", positive_id.alias("paired_positive_id"), negative_id.alias("_negative_id"))
    rows = named.select(
        by,
        "paired_positive_id",
        F.inline(
            F.array(
                F.struct(
                    F.col("paired_positive_id").alias("logical_window_id"),
                    F.lit(1).alias("label"),
                    F.col("event_type").alias("event_type"),
                    F.col("sleep_stage").alias("sleep_stage"),
                    F.col("event_start").alias("start_sec"),
                    F.col("event_end").alias("end_sec"),
                    F.lit(False).alias("negative_overlap_fallback"),
                ),
                F.struct(
                    F.col("_negative_id").alias("logical_window_id"),
                    F.lit(0).alias("label"),
                    F.lit("normal").alias("event_type"),
                    F.lit("").alias("sleep_stage"),
                    F.col("start").alias("start_sec"),
                    F.col("end").alias("end_sec"),
                    F.col("fallback").alias("negative_overlap_fallback"),
                ),
            )
        ),
    )
    return rows.crossJoin(F.broadcast(devices)).select(
        F.concat_ws("_", "logical_window_id", "device").alias("sample_id"),
        "logical_window_id",
        by,
        "device",
        "label",
        "event_type",
        "sleep_stage",
        "start_sec",
        "end_sec",
        (F.col("end_sec") - F.col("start_sec")).alias("duration_sec"),
        "paired_positive_id",
        "negative_overlap_fallback",
    )

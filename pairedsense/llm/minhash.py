"""Near duplicates: an inverted join over the coordinates of MinHash signatures.

1. One pass over the texts gives every document its number of distinct shingles,
   a digest of the set, and ``POSTED`` minimum hashes. Documents with equal sets
   fall together at once (a grouping, no pairs).
2. Each remaining set is posted under every coordinate value. Values that only
   one set has can't collide; they are counted map-side and go. A pair must
   agree in ``MATCHES`` posted coordinates, so a set with fewer shared values goes
   too, and of the rest only the prefix is merged: all but its ``MATCHES - 1``
   longest posting lists. Two sets that agree in ``MATCHES`` coordinates share a
   list of both prefixes; the long lists are skipped and only looked into once a
   pair is known: the sets that are left get ``COUNTED`` more coordinates of one
   bit each, and a pair's agreements in these are counted with xor and bit_count.
3. A list isn't expanded into pairs. First every member is held against the
   least member (links grow with the list's length); links confirmed on the full
   sets are closed to components. Then only members that are not yet in the
   least member's component meet the others, only across components; a pair leaves
   the join once, from the first list that both prefixes hold, and only with
   enough agreements.
4. Components of all links are found by alternating stars.

At a similarity of exactly 0.75 the 64 posted coordinates agree in 48 on
average (34 are asked for), the 1,024 bits in 896 (853): either threshold misses
such a pair with a probability of about 4e-5, one at 0.8 with less than 1e-7; a
missed pair costs nothing where other links join the two documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import text as T
from .components import components

POSTED = 64
MATCHES = 34
COUNTED = 1024
AGREEMENTS = 853
SHINGLE = 5
PERCENT = 75

_SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, sig array<long>"
_WORDS = [f"k{i}" for i in range(COUNTED // 64)]


def _seeds(first: int, n: int) -> np.ndarray:
    return T.mix(np.arange(first, first + n, dtype=np.uint64))


_A, _B = _seeds(1, POSTED + COUNTED) | np.uint64(1), _seeds(1 << 20, POSTED + COUNTED)


def minima(shingles: np.ndarray, first: int, n: int) -> np.ndarray:
    """For each of ``n`` coordinates the least value of its own hash over the set."""
    low = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        values = np.multiply.outer(_A[first : first + n], shingles[at : at + 1024])
        values += _B[first : first + n, None]
        np.minimum(low, values.min(axis=1), out=low)
    return low


def bits(shingles: np.ndarray) -> np.ndarray:
    """One bit of each of the ``COUNTED`` coordinates, packed into longs."""
    packed = np.packbits((T.mix(minima(shingles, POSTED, COUNTED)) & np.uint64(1)).astype(np.uint8))
    return packed.view(np.int64)


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for piece in T.slices(batch.column(1)):
                hashes, rows = T.words(piece)
                sets = T.shingles(hashes, rows, size)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                d1 = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                d2 = np.array([T.mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                full = np.flatnonzero(n)
                sigs = np.concatenate([minima(sets[i], 0, POSTED) for i in full]) if len(full) else np.zeros(0, np.uint64)
                offsets = np.concatenate(([0], np.cumsum(np.where(n > 0, POSTED, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(piece.first, len(piece)),
                        pa.array(n),
                        pa.array(T.signed(d1)),
                        pa.array(T.signed(d2)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(T.signed(sigs))),
                    ],
                    names=["doc_id", "n_shingles", "d1", "d2", "sig"],
                )

    return run


def _full_sets(size: int):
    """(doc_id, the set's hashes, its bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.slices(batch.column(1)):
                sets = T.shingles(*T.words(piece), size)
                packed = np.array([bits(s) for s in sets]).reshape(len(sets), len(_WORDS))
                columns = [pa.array(np.ascontiguousarray(packed[:, i])) for i in range(len(_WORDS))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.first, len(piece)), pa.array([s.tobytes() for s in sets], pa.binary()), *columns],
                    names=["doc_id", "set", *_WORDS],
                )

    return run


def _overlaps(percent: int):
    """Pairs (a, b, sa, sb) of which 100 * |both| >= percent * |either|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _agree(left: str, right: str, agreements: int):
    """Whether two rows' bits agree in enough places."""
    apart = None
    for w in _WORDS:
        n = F.bit_count(F.col(f"{left}{w}").bitwiseXOR(F.col(f"{right}{w}")))
        apart = n if apart is None else apart + n
    return apart <= COUNTED - agreements


def _confirmed(likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar on their full sets."""
    both = (
        likely.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb")), "b")
        .join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), "a")
        .select("a", "b", "sa", "sb")
    )
    return stage(both.mapInArrow(_overlaps(percent), "a long, b long").distinct(), "confirmed")


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, matches: int = MATCHES, agreements: int = AGREEMENTS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of ``docs`` (doc_id, text, ...), one row per row.

    * Null or blank texts have no shingles and are linked with nothing.
    * Rows with an equal doc_id are one document: what links one of them links all.
    * A row without doc_id has no component (NULL) and is kept; it links nothing.
    * Other columns are not read. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    signed = stage(docs.mapInArrow(_sign(size), _SIGNED), "signatures")
    named = signed.filter("doc_id is not null and n_shingles > 0")
    first = named.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    placed = stage(
        named.join(first, ["d1", "d2", "n_shingles"]).select(
            "doc_id", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("sig")).alias("sig")
        ),
        "placed",
    )
    # A document with several rows: the sets of its rows are linked with each other.
    where = placed.groupBy("doc_id").agg(F.min("rep").alias("m"), F.max("rep").alias("x"))
    doubled = placed.join(where.filter("m < x"), "doc_id").filter("rep <> m").select(F.col("rep").alias("a"), F.col("m").alias("b"))
    sigs = placed.filter("sig is not null").select("doc_id", "n_shingles", "sig")

    posted = sigs.select("doc_id", "n_shingles", F.posexplode("sig").alias("c", "v"))
    shared = posted.groupBy("c", "v").agg(F.count("*").alias("length")).filter("length > 1")
    lists = posted.join(shared, ["c", "v"])
    order = F.array_sort(F.collect_list(F.struct("length", "c", "v")))
    slots = lists.groupBy("doc_id", "n_shingles").agg(order.alias("lists")).filter(F.size("lists") >= matches)
    prefix = F.slice("lists", F.lit(1), F.size("lists") - (matches - 1))
    merged = stage(
        slots.select("doc_id", "n_shingles", F.explode(prefix).alias("l")).select("doc_id", "n_shingles", "l.c", "l.v"), "prefixes"
    )
    asked = merged.select(F.col("doc_id").alias("id")).distinct()
    texts = docs.join(asked, F.col("doc_id") == F.col("id"), "left_semi")
    kinds = ", ".join(f"{w} long" for w in _WORDS)
    sets = stage(texts.mapInArrow(_full_sets(size), f"doc_id long, set binary, {kinds}"), "sets")
    packed = sets.select("doc_id", *_WORDS).distinct()

    near = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    least = merged.groupBy("c", "v").agg(F.min("doc_id").alias("head"), F.count("*").alias("length")).filter("length > 1").drop("length")
    stars = merged.join(least, ["c", "v"]).filter("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    side = lambda name: packed.select(F.col("doc_id").alias(name), *[F.col(w).alias(f"{name}{w}") for w in _WORDS])
    likely = stage(stars.join(side("b"), "b").join(side("h"), (F.col("a") == F.col("h")) & _agree("h", "b", agreements)).select("a", "b").distinct(), "likely")
    links = _confirmed(likely, sets, percent)
    found = stage(components(links, "a", "b"), "components")

    # Lists that are not all in one component: their members with component and bits.
    known = merged.join(found, F.col("doc_id") == F.col("node"), "left").select(
        "c", "v", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("of")
    )
    spread = known.groupBy("c", "v").agg(F.min("of").alias("low"), F.max("of").alias("high"), F.min("doc_id").alias("head"))
    spread = spread.filter("low < high").select("c", "v", "head")
    open_lists = known.join(spread, ["c", "v"])
    own = merged.groupBy("doc_id").agg(F.collect_set("v").alias("own"))
    mains = spread.join(found, F.col("head") == F.col("node"), "left").select("c", "v", F.coalesce("component", "head").alias("main"))
    members = stage(
        open_lists.join(mains, ["c", "v"]).filter("doc_id <> head").join(packed, "doc_id").join(own, "doc_id").withColumn("settled", F.col("of") == F.col("main")), "members"
    )
    stray = members.filter("not settled").select(
        "c", "v", F.col("doc_id").alias("x"), F.col("n_shingles").alias("xn"), F.col("of").alias("xo"), F.col("own").alias("xl"), *[F.col(w).alias(f"x{w}") for w in _WORDS]
    )
    others = members.select(
        "c", "v", F.col("doc_id").alias("y"), F.col("n_shingles").alias("yn"), F.col("of").alias("yo"), F.col("own").alias("yl"), "settled", *[F.col(w).alias(f"y{w}") for w in _WORDS]
    )
    meets = (
        (stray["c"] == others["c"])
        & (stray["v"] == others["v"])
        & (F.col("xo") != F.col("yo"))
        & (F.col("settled") | (F.col("x") < F.col("y")))
        & near(F.col("xn"), F.col("yn"))
        & _agree("x", "y", agreements)
        & (F.array_min(F.array_intersect("xl", "yl")) == stray["v"])
    )
    across = stage(stray.join(others, meets).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "across")
    more = _confirmed(across, sets, percent)
    # `found` stands for the first links: every node hangs under its least one.
    joined = found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more).union(doubled)
    groups = components(joined, "a", "b")
    place = where.join(groups, F.col("m") == F.col("node"), "left").select(
        F.col("doc_id").alias("id"), F.coalesce("component", "m").alias("group")
    )
    out = signed.select("doc_id", "n_shingles").join(place, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("group", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group; the same columns. Rows without doc_id stay."""
    gone = near_duplicates(docs, **options).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")

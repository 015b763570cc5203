"""Fingerprints of a text's Lempel-Ziv dictionary.

A text is parsed into phrases, each the shortest one not met before (LZ78), the
set of phrases is hashed, and the ``KEPT`` least hashes are the fingerprint. The
share of common hashes among the least of two fingerprints estimates the Jaccard
similarity of the two dictionaries, which follows how well one text compresses
given the other.

Likeness to the next document needs neighbours by falling doc_id. Documents are
cut into ranges of doc_id, about equal by their quantiles; the first document of
a range is also sent to the range before (after the last: to the first one), so
that each range finds all its neighbours. Texts are shuffled once; a range is
walked row by row in sorted order.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

KEPT = 128
RANGE_ROWS = 20_000
MAX_RANGES = 10_000
_OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def phrases(raw: bytes, seen: set[bytes], at: int = 0) -> list[bytes]:
    """Parse raw[at:] into phrases, which are added to ``seen``; the last one may have been met before.

    All prefixes of a phrase are phrases, so its length may be searched from any guess: that of the one before.
    """
    found: list[bytes] = []
    add, keep, n, size = seen.add, found.append, len(raw), 4
    while at < n:
        if at + size > n:
            size = n - at
        phrase = raw[at : at + size]
        if phrase in seen:
            while at + size < n:
                size += 1
                phrase = raw[at : at + size]
                if phrase not in seen:
                    break
        else:
            while size > 1:
                shorter = phrase[:-1]
                if shorter in seen:
                    break
                phrase = shorter
                size -= 1
        add(phrase)
        keep(phrase)
        at += size
    return found


def sketch(parts: list[bytes], ends: np.ndarray) -> np.ndarray:
    """The least distinct 32-bit hashes of the phrases."""
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    hashes = np.sort((T.hash_spans(raw, starts, ends) >> np.uint64(32)).astype(np.uint32))
    fresh = np.ones(len(hashes), dtype=bool)
    np.not_equal(hashes[1:], hashes[:-1], out=fresh[1:])
    return hashes[fresh][:KEPT]


def _ends(parts: list[bytes]) -> np.ndarray:
    return np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Common share of the least hashes of both together; 1 for two empty texts."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    same = np.concatenate((both[1:] == both[:-1], [False]))
    firsts = np.concatenate(([True], both[1:] != both[:-1]))
    least = np.flatnonzero(firsts)[:KEPT]
    return float(same[least].mean())


def packed(sketch_of: np.ndarray) -> str:
    return base64.b64encode(sketch_of.tobytes()).decode("ascii")


class Parsed:
    """A text with its phrases and fingerprint."""

    def __init__(self, doc_id: int | None, text: str) -> None:
        self.doc_id, self.text, self.raw = doc_id, text, text.encode("utf-8")
        self.parts = phrases(self.raw, set())
        self.ends = _ends(self.parts)
        self.sketch = sketch(self.parts, self.ends)

    def edited(self, following: str) -> tuple[bytes, np.ndarray]:
        """The text whose last half is replaced by as much of ``following``, and its fingerprint; the parse of the first half is taken over."""
        half = len(self.text) // 2
        if not half:
            return self.raw, self.sketch
        stays = self.text[: len(self.text) - half].encode("utf-8")
        raw = stays + following[:half].encode("utf-8")
        kept = int(np.searchsorted(self.ends, len(stays), side="right"))
        parts = self.parts[:kept]
        parts += phrases(raw, set(parts), int(self.ends[kept - 1]) if kept else 0)
        return raw, sketch(parts, _ends(parts))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, borrowed, doc_id, text) in order; each own row is given with its follower."""
    rows: list[tuple] = []
    held: tuple | None = None

    def finished() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * 7, _SCHEMA)], schema=_SCHEMA)

    for batch in batches:
        for part, borrowed, doc_id, text in zip(*(c.to_pylist() if i != 3 else c for i, c in enumerate(batch.columns))):
            if borrowed and (held is None or held[0] != part or held[1]):
                continue
            own = Parsed(doc_id, text.as_py() or "")
            if held is not None and held[0] == part and not held[1]:
                before = held[2]
                raw, changed = before.edited(own.text)
                rows.append(
                    (before.doc_id, len(before.text), hashlib.sha256(raw).hexdigest(), packed(before.sketch), packed(changed),
                     likeness(before.sketch, changed), likeness(before.sketch, own.sketch))
                )
                if len(rows) == 1000:
                    yield finished()
                    rows.clear()
            held = (part, borrowed, own)
    yield finished()


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
     ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _bounds(docs: DataFrame) -> list[int]:
    """Distinct doc_ids, ascending, that cut the documents into ranges of about equal size; at most MAX_RANGES."""
    spark = docs.sparkSession
    n = docs.count()
    ranges = min(MAX_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // RANGE_ROWS, 1))
    if ranges < 2 or not n:
        return []
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    return sorted(set(cuts or []))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, ...): n_chars, the digest of its edited text, both fingerprints, near_edited, near_next.

    * A null text is an empty one; texts of fewer than two code points are not changed by the edit.
    * Rows with an equal doc_id follow each other by the hash of their text; rows without doc_id come last.
    * A single row is its own next document. Other columns are not read. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    bounds = _bounds(docs.select("doc_id"))
    cuts = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        # 0 holds the largest ids, the last range the least and those that are NULL.
        known = ids.fillna(0).astype("int64").to_numpy()
        place = len(cuts) - np.searchsorted(cuts, known, side="left")
        return pd.Series(np.where(ids.isna().to_numpy(), len(cuts), place).astype("int32"))

    placed = docs.withColumn("part", range_of("doc_id")).withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    heads = placed.groupBy("part").agg(F.max(F.struct("doc_id", "tie")).alias("h")).select("part", "h.doc_id", "h.tie").collect()
    heads.sort(key=lambda r: r["part"])
    lent = [(r["doc_id"], r["tie"], heads[i - 1]["part"]) for i, r in enumerate(heads)]
    lend = spark.createDataFrame(lent, "lent_id long, lent_tie long, lent_to int")
    match = placed["doc_id"].eqNullSafe(F.col("lent_id")) & (F.col("tie") == F.col("lent_tie"))
    # At most MAX_RANGES rows.
    both = placed.join(F.broadcast(lend), match, "left")
    copies = F.array(F.struct(F.col("part"), F.lit(False).alias("borrowed")), F.when(F.col("lent_to").isNotNull(), F.struct(F.col("lent_to").alias("part"), F.lit(True).alias("borrowed"))))
    rows = both.select(F.explode(F.filter(copies, lambda c: c.isNotNull())).alias("c"), "doc_id", "text", "tie")
    rows = rows.select("c.part", "c.borrowed", "doc_id", "text", "tie")
    dealt = rows.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "borrowed", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    return dealt.select("part", "borrowed", "doc_id", "text").mapInArrow(_walk, _OUT)

"""Quality by importance resampling with hashed n-gram models.

Two bag-of-n-gram models over ``BUCKETS`` hashed unigrams and bigrams: the
target from labelled good text, the raw one from all documents. A document's log
importance weight is the sum over its n-grams of log(target / raw). Sampling
without replacement in proportion to the weights is a Gumbel top-k: add Gumbel
noise, seeded by doc_id, to each log weight and keep the k largest.

k is the share of good rows among the labels times the number of documents. The
k-th largest key is found exactly by cutting the range into cells until one value
is left: a few aggregations of at most 4,096 rows each, no global sort.
Models have a fixed size; the raw counts cover all documents, the target counts
at most ``MAX_LABELLED`` labelled rows.

Words and runs of punctuation are tokens of their own (so marks glued to words
show), and all bigrams of a token with itself share one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import text as T

BUCKETS = 1 << 16
MAX_LABELLED = 20_000
_KIND = np.full(256, 2, dtype=np.uint8)  # 0 space, 1 letters and digits, 2 marks
_KIND[T.SPACE] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_TWICE = np.uint64(0x2545F4914F6CDD1D)


def features(piece: T.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of the tokens, buckets of the bigrams that end there or -1, the rows' bounds)."""
    starts, ends, rows = T.segments(_KIND[piece.data], piece.bounds, 0)
    words = T.hash_spans(T.LOWER[piece.data], starts, ends)
    single = (words % np.uint64(BUCKETS)).astype(np.int64)
    pair = np.full(len(words), -1, dtype=np.int64)
    if len(words) > 1:
        both = T.mix(words[:-1] * T.factor(0) + words[1:] * T.factor(1))
        both[words[1:] == words[:-1]] = _TWICE
        pair[1:] = (both % np.uint64(BUCKETS)).astype(np.int64)
        pair[rows[:-1][rows[:-1] < rows[1:]]] = -1
    return single, pair, rows


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for piece in T.slices(batch.column(0)):
            single, pair, _ = features(piece)
            total += np.bincount(single, minlength=BUCKETS) + np.bincount(pair[pair >= 0], minlength=BUCKETS)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["b", "n"])


def _model(texts: DataFrame) -> np.ndarray:
    """Log shares of the buckets, with one added to each count."""
    rows = texts.select("text").mapInArrow(_count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    counts = np.ones(BUCKETS)
    counts[rows["b"].to_numpy()] += rows["n"].to_numpy()
    return np.log(counts / counts.sum())


def labelled_sample(labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """(id, quality): at most ``limit`` labelled ids, those of the least hash; of several labels of an id the least counts."""
    usable = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    return stage(usable.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(limit).withColumnRenamed("doc_id", "id"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """(log weight of each bucket, share of good labels). Without good labels all weights are 0, without labels the share is 1."""
    sample = labelled_sample(labels, limit)
    good, n = sample.agg(F.sum((F.col("quality") == 1).cast("int")), F.count("*")).first()
    if not good:
        return np.zeros(BUCKETS), 0.0 if n else 1.0
    chosen = F.broadcast(sample.filter("quality = 1").select("id"))
    target = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("id"), "left_semi")
    return _model(target) - _model(docs), good / n


def _noise(seed: str) -> Column:
    """Gumbel noise from a hash of the doc_id."""
    u = (F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def weigh(docs: DataFrame, weights: np.ndarray, seed: str = "quality-1") -> DataFrame:
    """``docs`` with ``__log_weight`` and the perturbed ``__key``; a text without tokens weighs 0."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for piece in T.slices(batch.column(batch.schema.get_field_index("text"))):
                single, pair, rows = features(piece)
                each = sent.value[single] + np.where(pair >= 0, sent.value[pair], 0.0)
                sums = np.zeros(len(piece))
                full = np.flatnonzero(np.diff(rows))
                if len(full):
                    sums[full] = np.add.reduceat(each, rows[:-1][full])
                out.append(np.round(sums, 9))  # alike in whatever piece a text is read
            values = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*names, "__log_weight"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, __log_weight double").withColumn("__key", F.col("__log_weight") + _noise(seed))


def kth_largest(keys: DataFrame, name: str, k: int) -> float | None:
    """The k-th largest value of a double column; None if there are fewer rows.

    The range is cut into 4,096 equal cells again and again; every round keeps the
    cell that holds the k-th value, until the cell is one value.
    """
    if k <= 0:
        return None
    low, high, n = keys.agg(F.min(name), F.max(name), F.count(name)).first()
    if n < k:
        return None
    above, cells = 0, 4096
    while low < high:
        width = (high - low) / cells
        if width <= 0 or low + width == low:
            break
        cell = F.least(F.floor((F.col(name) - low) / F.lit(width)), F.lit(cells - 1))
        part = keys.filter((F.col(name) >= low) & (F.col(name) <= high))
        counted = part.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(name).alias("low"), F.max(name).alias("high"))
        for row in sorted(counted.collect(), key=lambda r: -r["cell"]):
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]
    return low


def select(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, seed: str = "quality-1") -> DataFrame:
    """``docs`` with ``__log_weight``, ``__key`` and ``__selected`` (among the k largest keys).

    * Null and empty texts weigh 0 and take part; NULL doc_ids share one noise.
    * Equal keys at the cut (repeated rows) are all selected.
    * All rows and columns stay. Without documents the result is empty; without labels all rows are selected.
    """
    weights, share = fit(docs, labels, limit)
    keys = stage(weigh(docs.select("doc_id", "text"), weights, seed).select("__key"), "keys")
    k = round(share * keys.count())
    cut = kth_largest(keys, "__key", k)
    chosen = F.lit(False) if cut is None else F.col("__key") >= cut
    return weigh(docs, weights, seed).withColumn("__selected", chosen)


def summary(selected: DataFrame) -> DataFrame:
    return selected.select(
        "doc_id", F.round("__log_weight", 9).alias("log_weight"), F.round("__key", 9).alias("key"), F.col("__selected").alias("selected")
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The selected rows of ``docs``; the same columns."""
    return select(docs, labels, **options).filter("__selected").select(*docs.columns)

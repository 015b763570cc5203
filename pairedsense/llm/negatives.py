"""Hard negatives for contrastive training by a vertical branch-and-bound scan.

Vectors are written once as column blocks: a block holds up to ``BLOCK`` rows,
ordered by label, dimension by dimension. For an anchor a block is read in the
order of falling |anchor component|, ``STEP`` dimensions at a time. The sums so
far and the most and least that the unread dimensions can add (from the least and
greatest value of every dimension in the block) bound each row's score, and rows
that can no longer matter leave the bitmap of candidates; after the last dimension
the sums of those left are exact.

Two scans: the first finds each anchor's positives, its best rows of the same
label; the second, with the positives' scores known, finds the best rows of other
labels inside every positive's window. A scan runs over all blocks as a map; a task
keeps only the best few per anchor, which are merged by a shuffle on the anchor.
Anchors come in groups of at most about ``GROUP`` rows, sent to the tasks, with
two scans per group: what is broadcast is bounded, whatever the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage

BLOCK = 8192
GROUP = 16384
STEP = 8
EXACT = float(1 << 53)
_KINDS = {"h": np.int16, "i": np.int32, "d": np.float64}
_PACKED = "rows int, dims int, kind string, ids binary, labels binary, columns binary"
_NONE = np.zeros(0)


@dataclass
class Block:
    """Rows ordered by label; ``columns`` is dims x rows."""

    ids: np.ndarray
    labels: np.ndarray
    columns: np.ndarray

    @staticmethod
    def unpack(row) -> Block:
        columns = np.frombuffer(row["columns"], _KINDS[row["kind"]]).reshape(row["dims"], row["rows"])
        return Block(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), columns.astype(np.float64))

    def slices(self) -> dict[int, tuple[int, int]]:
        """Label -> its first row and one past its last."""
        edges = np.flatnonzero(np.r_[True, self.labels[1:] != self.labels[:-1], True])
        return {int(self.labels[a]): (int(a), int(b)) for a, b in zip(edges[:-1], edges[1:])}


def eligible(table: DataFrame, vector: str = "embedding", label: str = "label", key: str = "vec_id") -> DataFrame:
    """(id, label, vector) of the rows that take part: no null id, label, vector or component, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = table.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    return rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, vector) as packed blocks of whole components floor(256 * x)."""

    def block(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        ids, labels = (table.column(i).to_numpy().astype(np.int64) for i in (0, 1))
        vectors = table.column(2).chunk(0)
        lengths = np.diff(vectors.offsets.to_numpy())
        width = int(lengths.max(initial=0))
        dense = np.zeros((len(ids), width))  # a shorter vector ends in zeros
        dense[np.arange(width) < lengths[:, None]] = np.floor(256.0 * vectors.flatten().to_numpy(zero_copy_only=False))
        order = np.lexsort((ids, labels))
        top = np.abs(dense).max(initial=0)
        kind = "h" if top < 1 << 15 else "i" if top < 1 << 31 else "d"
        columns = np.ascontiguousarray(dense[order].T).astype(_KINDS[kind])
        made = [[len(ids)], [width], [kind], [ids[order].tobytes()], [labels[order].tobytes()], [columns.tobytes()]]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(m, k) for m, k in zip(made, kinds)], names=["rows", "dims", "kind", "ids", "labels", "columns"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, BLOCK - sum(b.num_rows for b in held))
            held.append(part)
            batch = batch.slice(part.num_rows)
            if sum(b.num_rows for b in held) == BLOCK:
                yield block(pa.Table.from_batches(held))
                held = []
    if held:
        yield block(pa.Table.from_batches(held))


def column_blocks(rows: DataFrame, name: str) -> DataFrame:
    """Staged column blocks of rows (id, label, vector), spread evenly over the tasks."""
    spark = rows.sparkSession
    count = rows.count()
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // (BLOCK // 2))))
    if count > tasks * BLOCK * 16:  # large tables: about 16 full blocks a task
        tasks = -(-count // (BLOCK * 16))
    return stage(rows.repartition(tasks).mapInArrow(_pack, _PACKED), name)


@dataclass
class Anchors:
    """A group of anchors, as sent to the tasks; ``order`` is each one's dimensions by falling magnitude."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    order: np.ndarray

    @staticmethod
    def of(blocks: list[Block]) -> Anchors:
        width = max(b.columns.shape[0] for b in blocks)
        vectors = np.concatenate([np.pad(b.columns.T, ((0, 0), (0, width - b.columns.shape[0]))) for b in blocks])
        order = np.argsort(-np.abs(vectors), axis=1, kind="stable").astype(np.int32)
        return Anchors(np.concatenate([b.ids for b in blocks]), np.concatenate([b.labels for b in blocks]), vectors, order)

    def remaining(self, which: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the anchors ``which``: most and least that the dimensions after each step can add, whether all sums are exact doubles, and the order of the dimensions that the block has."""
        low, high = columns.min(axis=1), columns.max(axis=1)
        width = min(len(low), self.vectors.shape[1])
        vectors, order = self.vectors[which], self.order[which]
        if width < self.vectors.shape[1]:
            order = order[order < width].reshape(len(which), width)
        both = np.stack([vectors[:, :width] * low[:width], vectors[:, :width] * high[:width]])
        out = []
        for bound in (both.max(axis=0), both.min(axis=0)):
            ordered = np.take_along_axis(bound, order, axis=1)
            after = np.zeros((len(which), width + 1))
            after[:, :-1] = np.cumsum(ordered[:, ::-1], axis=1)[:, ::-1]
            out.append(after)
        return out[0], out[1], np.abs(both).max(axis=0).sum(axis=1) < EXACT, order


def candidates(columns: np.ndarray, anchor: np.ndarray, order: np.ndarray, most: np.ndarray, least: np.ndarray, floor: float, ceiling: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, exact scores) of the block's rows with floor <= score <= ceiling."""
    n, width = columns.shape[1], len(order)
    rows, sums = np.arange(n), np.zeros(n)
    whole = True
    for at in range(0, max(width, 1), STEP):
        dims = order[at : at + STEP]
        sums = sums + anchor[dims] @ (columns[dims] if whole else columns[dims[:, None], rows])
        end = min(at + STEP, width)
        alive = sums + most[end] >= floor
        if ceiling < np.inf:
            alive &= sums + least[end] <= ceiling
        left = np.count_nonzero(alive)
        if left == 0:
            return rows[:0], sums[:0]
        if left < 0.8 * len(rows) or end == width:
            rows, sums, whole = rows[alive], sums[alive], whole and left == n
    return rows, sums


def _exactly(columns: np.ndarray, anchor: np.ndarray, order: np.ndarray, floor: float, ceiling: float) -> tuple[np.ndarray, np.ndarray]:
    """``candidates`` in whole numbers of any size, for components whose sums may pass 2**53."""
    factors = [int(x) for x in anchor[order]]
    scores = [sum(f * int(x) for f, x in zip(factors, column)) for column in columns[order].T]
    rows = [i for i, s in enumerate(scores) if floor <= s <= ceiling]
    return np.array(rows, np.int64), np.array([scores[i] for i in rows], object)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k by falling score, then rising id."""
    if scores.dtype == object:
        order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
        return ids[order], scores[order]
    if len(scores) > 4 * k:
        close = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[close], scores[close]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _search(anchors: Anchors, block: Block, first: int, end: int, bounds, j: int, a: int, floor: float, ceiling: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows first .. end - 1 of a block with a score between the limits for anchor a (the j-th of ``bounds``)."""
    most, least, safe, order = bounds
    columns = block.columns[:, first:end]
    if safe[j]:
        rows, scores = candidates(columns, anchors.vectors[a], order[j], most[j], least[j], floor, ceiling)
    else:
        rows, scores = _exactly(columns, anchors.vectors[a], order[j], floor, ceiling)
    return block.ids[first:end][rows], scores


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            if row["rows"]:
                yield Block.unpack(row)


def _positives(sent, k: int):
    """Each task's k best rows of the anchor's own label, other than the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = sent.value
        ids, scores = [_NONE.astype(np.int64)] * len(anchors.ids), [_NONE] * len(anchors.ids)
        for block in _blocks(batches):
            for label, (first, end) in block.slices().items():
                which = np.flatnonzero(anchors.labels == label)
                if not len(which):
                    continue
                bounds = anchors.remaining(which, block.columns[:, first:end])
                for j, a in enumerate(which):
                    floor = scores[a][-1] if len(scores[a]) == k else -np.inf
                    found, value = _search(anchors, block, first, end, bounds, j, a, floor, np.inf)
                    other = found != anchors.ids[a]
                    if other.any():
                        ids[a], scores[a] = _best(np.r_[ids[a], found[other]], np.r_[scores[a], value[other]], k)
        sizes = [len(s) for s in scores]
        made = [np.repeat(np.arange(len(sizes)), sizes), np.concatenate([_NONE.astype(np.int64), *ids]), _whole(scores)]
        yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()) for m in made], names=["anchor", "id", "score"])

    return run


def _whole(scores: list[np.ndarray]) -> list[int]:
    return [int(x) for s in scores for x in s]


def _negatives(sent, k: int):
    """Each task's k best rows of other labels in the window of each (anchor, positive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, windows = sent.value  # windows: anchor -> [(least, greatest score) per positive]
        which = np.array(sorted(windows), np.int64)
        none = (_NONE.astype(np.int64), _NONE)
        kept = {int(a): [none] * len(windows[a]) for a in which}
        for block in _blocks(batches):
            if not len(which):
                break
            bounds, slices, n = anchors.remaining(which, block.columns), block.slices(), len(block.ids)
            for j, a in enumerate(which):
                own = slices.get(int(anchors.labels[a]), (n, n))
                best = kept[int(a)]
                for first, end in ((0, own[0]), (own[1], n)):
                    if first == end:
                        continue
                    # The running limit of a window is its k-th best so far.
                    floors = [max(low, s[-1]) if len(s) == k else low for (low, _), (_, s) in zip(windows[a], best)]
                    top = max(high for _, high in windows[a])
                    found, value = _search(anchors, block, first, end, bounds, j, a, min(floors), top)
                    if not len(value):
                        continue
                    for w, (_, high) in enumerate(windows[a]):
                        inside = (value >= floors[w]) & (value <= high)
                        if inside.any():
                            best[w] = _best(np.r_[best[w][0], found[inside]], np.r_[best[w][1], value[inside]], k)
        rows = [(a, w, int(i), int(s)) for a, best in kept.items() for w, (ids, scores) in enumerate(best) for i, s in zip(ids, scores)]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "slot", "id", "score"])

    return run


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _groups(packed: DataFrame, size: int) -> Iterator[Anchors]:
    """Anchors in groups of about ``size``; one block at a time reaches the driver."""
    held: list[Block] = []
    for row in packed.toLocalIterator():
        held.append(Block.unpack(row))
        if sum(len(b.ids) for b in held) >= size:
            yield Anchors.of(held)
            held = []
    if held:
        yield Anchors.of(held)


def mine(
    table: DataFrame,
    is_anchor: str = "vec_id % 50 = 0",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    group: int = GROUP,
) -> DataFrame:
    """Hard negatives of a table (vec_id, embedding, label): anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components are floor(256 * x), a score is the inner product of whole numbers. An anchor's positives
    are its ``positives`` best other rows of its label, a positive's negatives the ``negatives`` best rows of
    another label with low * positive_score <= 100 * negative_score <= high * positive_score; ties by smaller id.

    * Rows with a null id, label, vector or component, or one that is not finite, take no part.
    * Shorter vectors end in zeros; an empty vector scores 0 with everything.
    * Repeated rows are rows of their own; "other" means another id, and a repeated anchor has its result once per row.
    * An anchor without positives, or a positive whose window is empty, gives no rows; so does an empty table.
    * Other columns are ignored, whatever their names. A score beyond 64 bits is an error.
    """
    spark: SparkSession = table.sparkSession
    anchors = eligible(table.filter(is_anchor))
    blocks = column_blocks(eligible(table), "columns")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = None
    for part in _groups(column_blocks(anchors, "anchors"), group):
        sent = spark.sparkContext.broadcast(part)
        found = _first(blocks.mapInArrow(_positives(sent, positives), "anchor long, id long, score long"), ["anchor"], positives)
        windows: dict[int, list[tuple[int, int]]] = {}
        named = []
        for r in found.orderBy("anchor", "rank").collect():  # at most ``positives`` rows per anchor of the group
            score = r["score"]
            slot = len(windows.setdefault(r["anchor"], []))
            windows[r["anchor"]].append((-(-low * score // 100), high * score // 100))
            named.append((r["anchor"], slot, int(part.ids[r["anchor"]]), r["id"], score))
        both = spark.sparkContext.broadcast((part, {a: w for a, w in windows.items() if any(x <= y for x, y in w)}))
        rows = _first(blocks.mapInArrow(_negatives(both, negatives), "anchor long, slot long, id long, score long"), ["anchor", "slot"], negatives)
        names = spark.createDataFrame(named, "anchor long, slot long, anchor_id long, positive_id long, positive_score long")
        made = rows.join(names, ["anchor", "slot"]).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        made = stage(made, "hard")
        out = made if out is None else out.unionByName(made)
    return out if out is not None else spark.createDataFrame([], schema)

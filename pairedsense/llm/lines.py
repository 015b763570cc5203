"""Line dedup on levelled sorted runs of line hashes.

A run is a table (h1, h2, n_docs, keeper), sorted by the 128-bit hash of a line
key: in how many documents of the run the key stands, and the largest doc_id of
these. Each new batch of documents adds its own run at level 0; when a level
holds ``fanout`` runs they are merged into one run of the next level, so that a
key is rewritten once per level. To dedupe a batch its line hashes are merged
with the runs and anti-joined: a line goes if the runs know its key in enough
documents and another document keeps it.

Lines are hashed once; the hashes are written by batch and read again for both
steps. The keys are counted per task before they are shuffled, so that a line
that stands in a third of all documents is a few rows; the join that looks the
lines up is split by AQE. Texts are shuffled once, by doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path, stage

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 4


def line_key(line: bytes) -> bytes:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return line.strip().lower()


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _long_enough(key: bytes, chars: int) -> bool:
    return len(key) >= chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= chars)


def _hash_lines(chars: int, batches: int):
    """Each row's distinct line keys of ``chars`` code points or more, as hashes."""

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in:
            ids, texts = batch.column(0), batch.column(1)
            at, found = [], []
            for i, text in enumerate(texts):
                raw = text.as_buffer() if text.is_valid else None
                if raw is None:
                    continue
                keys = {k for k in map(line_key, raw.to_pybytes().split(b"\n")) if _long_enough(k, chars)}
                found += [_digest(k) for k in keys]
                at += [i] * len(keys)
                if len(at) > 200_000:
                    yield _rows(ids, at, found, batches)
                    at, found = [], []
            yield _rows(ids, at, found, batches)

    return run


def _rows(ids: pa.Array, at: list[int], found: list[bytes], batches: int) -> pa.RecordBatch:
    both = np.frombuffer(b"".join(found), dtype=">i8").astype(np.int64).reshape(-1, 2)
    own = ids.take(pa.array(at, pa.int64()))
    part = own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) % batches
    return pa.RecordBatch.from_arrays(
        [own, pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])), pa.array(part.astype(np.int32))],
        names=["doc_id", "h1", "h2", "batch"],
    )


def hash_lines(docs: DataFrame, chars: int = MIN_CHARS, batches: int = 1) -> DataFrame:
    """(doc_id, h1, h2, batch): the distinct long line keys of each row of ``docs``."""
    return docs.select("doc_id", "text").mapInArrow(_hash_lines(chars, batches), "doc_id long, h1 long, h2 long, batch int")


class Runs:
    """The levelled runs of a corpus, as folders below the shared checkpoint folder."""

    schema = "h1 long, h2 long, n_docs long, keeper long"

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = [[]]

    def _write(self, run: DataFrame, level: int) -> None:
        path = shared_path(self.spark, f"run-{level}")
        run.sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            merged = self._merge(self.levels[level])
            self.levels[level] = []
            self._write(merged, level + 1)

    def _merge(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        runs = self.spark.read.schema(self.schema).parquet(*paths)
        return runs.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def add(self, lines: DataFrame) -> None:
        """Add a batch (doc_id, h1, h2) as a run of its own; a document's lines come in one batch."""
        counted = lines.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        self._write(counted, 0)

    def all(self) -> DataFrame:
        """One row per key over all runs."""
        paths = [p for level in self.levels for p in level]
        if len(paths) == 1:
            return self.spark.read.schema(self.schema).parquet(*paths)
        return self._merge(paths)

    def repeated(self, lines: DataFrame, min_docs: int) -> DataFrame:
        """The rows of ``lines`` whose key stands in ``min_docs`` documents or more and is kept by another one."""
        common = self.all().filter(F.col("n_docs") >= min_docs).drop("n_docs")
        return lines.join(common, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper"))).drop("keeper")


def _drop(names: list[str]):
    """Rewrite ``text`` without the lines whose hashes stand in ``__drops``; count the lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drops = batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index("__drops"))
            out, lines_of, dropped = [], [], []
            for text, drop in zip(texts, drops):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                lines = raw.split(b"\n")
                kept = lines
                if drop.is_valid:
                    gone = {x.as_buffer().to_pybytes() for x in drop.values}
                    kept = [x for x in lines if _digest(line_key(x)) not in gone]
                out.append(b"\n".join(kept).decode("utf-8") if len(kept) < len(lines) else text.as_py())
                lines_of.append(len(lines))
                dropped.append(len(lines) - len(kept))
            columns = [pa.array(out, pa.string()) if n == "text" else batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(lines_of, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "__lines", "__dropped"]
            )

    return run


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """``docs`` with repeated lines dropped from ``text``, and ``__lines`` and ``__dropped`` (their numbers).

    A key of ``min_chars`` code points or more that stands in ``min_docs``
    documents or more loses all its lines but those of the largest doc_id that
    holds it.

    * A null or empty text is one empty line; it stays as it is.
    * Rows with an equal doc_id count as documents of their own; they keep or lose a line together.
    * A row without doc_id counts too; it keeps a line only where no numbered row holds it.
    * All columns and rows stay. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "lines")
    hash_lines(docs, min_chars, batches).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, h1 long, h2 long, batch int").parquet(path)
    runs = Runs(spark, fanout)
    for i in range(batches):
        runs.add(lines.filter(F.col("batch") == i).drop("batch"))
    gone = stage(runs.repeated(lines.drop("batch"), min_docs), "repeated")
    key = F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("h1", "h2")]))
    per_doc = gone.groupBy("doc_id").agg(F.collect_set(key).alias("__drops")).withColumnRenamed("doc_id", "__doc")
    joined = docs.join(per_doc, docs["doc_id"].eqNullSafe(F.col("__doc")), "left").drop("__doc")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(_drop(docs.columns), f"{fields}, __lines long, __dropped long")


def summary(docs: DataFrame) -> DataFrame:
    """Digest columns of a result of ``dedup_lines``."""
    return docs.select(
        "doc_id",
        F.col("__lines").alias("n_lines"),
        F.col("__dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )

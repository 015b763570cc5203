"""Writers that never change a finished result."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wav import open_store


def write_new(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write once: an empty table and an existing path are refused."""
    if df.isEmpty():
        raise ValueError(f"refusing to write an empty table to {path}")
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def write_idempotent(df: DataFrame, path: str) -> bool:
    """Write, or do nothing when the same rows are there; other rows fail. True if written."""
    spark = df.sparkSession
    try:
        present = spark.read.parquet(path)
    except AnalysisException:
        write_new(df, path)
        return True
    if set(present.columns) != set(df.columns):
        raise ValueError(f"columns at {path} differ")
    present = present.select(*df.columns)
    if not df.exceptAll(present).isEmpty() or not present.exceptAll(df).isEmpty():
        raise ValueError(f"different rows at {path}")
    return False


def append_log(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Append rows with the fixed columns of a log; others are refused."""
    extra = [c for c in df.columns if c not in columns]
    if extra:
        raise ValueError(f"unknown log columns {extra}")
    fixed = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
    fixed.write.mode("append").parquet(path)


def write_predictions(df: DataFrame, path: str, keys: Sequence[str] = ("representation", "classifier", "protocol", "fold")) -> None:
    """Compressed CSV parts below one folder per run cell.

    Rows of a cell may be spread over tasks: a large cell becomes several parts.
    """
    df.write.mode("errorifexists").option("header", True).option("compression", "gzip").partitionBy(*keys).csv(path)


def write_features(df: DataFrame, path: str) -> None:
    """Feature store: one partition folder per feature block."""
    df.write.mode("errorifexists").partitionBy("feature").parquet(path)


def write_files(files: DataFrame, root: str) -> int:
    """Write rows (path, content) as files below ``root``, each by the task that holds it; the number of files.

    A task that runs again writes the same bytes again. A NULL content is an empty file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base, _ = open_store(root)
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                target = f"{base}/{path.as_py().lstrip('/')}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(target) as out:
                    out.write(content.as_buffer() if content.is_valid else b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

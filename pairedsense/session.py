"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_staged: list[str] = []


def build_session(app: str = "pairedsense", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster the master, memory and checkpoint folder come from
    spark-submit; nothing here overrides what is already set.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names in ``spark.checkpoint.dir``.

    A local session without one gets a scratch folder; on a cluster every
    executor would write to its own disk, so there a missing setting is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, unlike a local one."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder, for stream state and results."""
    from uuid import uuid4

    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid4().hex[:12]}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there, in whatever store the path names."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what stands in a folder."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(f.getPath().getName() for f in there.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(there))


def delete_folder(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table into the shared folder and read it back.

    For a table that several branches of one plan read: it is computed once,
    its columns can be pruned per branch, the plan above it stays small, and a
    lost executor costs a re-read instead of the whole lineage.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    _staged.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that were staged inside the block when it ends: results must be written or collected before."""
    first = len(_staged)
    try:
        yield
    finally:
        for path in _staged[first:]:
            delete_folder(spark, path)
        del _staged[first:]

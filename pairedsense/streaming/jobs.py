"""Streaming forms of the epoch, run and latest-record operators."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.series import MIN_SAMPLES
from ..operators.summaries import pick_latest
from ..session import delete_folder, folder_names, path_exists, shared_path


def stream_epochs(events: DataFrame, by: Sequence[str], epoch: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Event count and mean value per key and epoch; an epoch is emitted once the watermark has passed it."""
    return (
        events.withWatermark("ts", watermark)
        .groupBy(*by, F.window("ts", epoch).alias("w"))
        .agg(F.count("*").alias("events"), F.avg("value").alias("mean_value"))
        .select(*by, F.col("w.start").alias("epoch_start"), "events", "mean_value")
    )


RUN_SCHEMA = T.StructType(
    [
        T.StructField("subject_id", T.LongType()),
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
        T.StructField("max_drop", T.DoubleType()),
        T.StructField("area", T.DoubleType()),
    ]
)


class RunDetector(StatefulProcessor):
    """Per key: the trailing window of samples, the run that is still open, and the number of samples.

    A key with fewer than ten samples gives no runs: those that end earlier wait
    in the state until the tenth sample. A micro-batch of one key is sorted in
    memory, so bound the batches (``maxFilesPerTrigger``); batches come in order.
    """

    def __init__(self, drop: float, min_duration: float, window: float, idle_ms: int | None = None):
        self.drop, self.min_duration, self.window, self.idle_ms = drop, min_duration, window, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        sample = T.StructType([T.StructField("t", T.DoubleType()), T.StructField("v", T.DoubleType())])
        run = T.StructType(
            [T.StructField(n, T.DoubleType()) for n in ("start", "end", "max_drop", "area", "last_drop")]
        )
        self.handle = handle
        self.recent = handle.getListState("recent", sample)
        self.open = handle.getValueState("open", run)
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("n", T.LongType())]))
        self.held = handle.getListState("held", run)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = self._advance(pd.concat(list(rows)).sort_values("t"))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._rows(key, done)

    def _advance(self, batch: pd.DataFrame) -> list[tuple]:
        """Take samples in their order; the runs that have ended."""
        # Falling values only: the head is the maximum of the trailing window.
        falling: deque[tuple[float, float]] = deque((float(t), float(v)) for t, v in self.recent.get())
        run = tuple(self.open.get()) if self.open.exists() else None
        done = []
        for t, v, masked in zip(batch["t"], batch["v"], batch["masked"]):
            t, v = float(t), float(v)
            while falling and falling[-1][1] <= v:
                falling.pop()
            falling.append((t, v))
            while falling[0][0] < t - self.window:
                falling.popleft()
            deficit = falling[0][1] - v
            if deficit >= self.drop and not masked:
                if run is None:
                    run = (t, t, deficit, 0.0, deficit)
                else:
                    start, end, top, area, last = run
                    run = (start, t, max(top, deficit), area + (deficit + last) / 2.0 * (t - end), deficit)
            elif run is not None:
                done.append(run)
                run = None
        before = self.seen.get()[0] if self.seen.exists() else 0
        count = before + len(batch)
        self.seen.update((count,))
        if before < MIN_SAMPLES:
            done = [tuple(r) for r in self.held.get()] + done
            if count < MIN_SAMPLES and done:
                self.held.put(done)
                done = []
            else:
                self.held.clear()
        self.recent.put(list(falling))
        if run is None:
            self.open.clear()
        else:
            self.open.update(run)
        return done

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A key without news for too long gives up its open run."""
        enough = self.seen.exists() and self.seen.get()[0] >= MIN_SAMPLES
        run = tuple(self.open.get()) if self.open.exists() and enough else None
        self.open.clear()
        yield self._rows(key, [run] if run else [])

    def _rows(self, key, runs) -> pd.DataFrame:
        kept = [(key[0], r[0], r[1], r[2], r[3]) for r in runs if r[1] - r[0] >= self.min_duration]
        return pd.DataFrame(kept, columns=[f.name for f in RUN_SCHEMA])

    def close(self) -> None:
        pass


#: Second zero as event time: far from the watermark's own zero, behind which every sample would be late.
ZERO = 946_684_800.0


class EventTimeRunDetector(RunDetector):
    """The same by event time: samples may arrive in any order within the watermark's delay.

    Samples wait in the state until a timer finds that the watermark has passed them, and are then taken in
    their order. Timers stand on a grid of an eighth of the delay, so that a key has few of them. Samples
    behind the watermark are dropped by Spark, which counts them (``late_rows``). State
    per key: the samples of a delay and an eighth, besides that of ``RunDetector``.
    """

    def __init__(self, drop: float, min_duration: float, window: float, delay_ms: int):
        super().__init__(drop, min_duration, window)
        self.grid_ms = max(1, delay_ms // 8)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState(
            "waiting", T.StructType([T.StructField("t", T.DoubleType()), T.StructField("v", T.DoubleType()), T.StructField("masked", T.BooleanType())])
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        self.waiting.appendList(list(zip(new["t"].tolist(), new["v"].tolist(), new["masked"].tolist())))
        last = int((new["t"].max() + ZERO) * 1000) + 1
        self.handle.registerTimer(-(-last // self.grid_ms) * self.grid_ms)
        yield self._rows(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() / 1000.0 - ZERO
        held = pd.DataFrame([tuple(r) for r in self.waiting.get()], columns=["t", "v", "masked"]).sort_values("t", kind="stable")
        ready, rest = held[held["t"] <= passed], held[held["t"] > passed]
        if len(rest):
            self.waiting.put(list(rest.itertuples(index=False, name=None)))
        else:
            self.waiting.clear()
        yield self._rows(key, self._advance(ready) if len(ready) else [])


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"


def stream_runs(
    samples: DataFrame, drop: float = 3.0, min_duration: float = 8.0, window: float = 100.0, idle_ms: int | None = None, delay: float | None = None
) -> DataFrame:
    """Runs below the trailing baseline of samples (subject_id, t, v, masked), emitted when they end.

    With ``delay`` (seconds) by event time: samples may be out of order by as much, runs come once
    the watermark has passed their end. Without it samples are taken as they come, batch by batch,
    and ``idle_ms`` gives up the open run of a key without news.

    The session needs the RocksDB state store. State per key is one trailing window, one run, at most nine samples' worth of waiting runs, and the samples of one delay.
    """
    if delay is not None:
        if idle_ms is not None:
            raise ValueError("by event time an open run waits for the watermark, not for the clock")
        delay_ms = math.ceil(delay * 1000)
        stamped = samples.withColumn("ts", F.timestamp_micros(F.floor((F.col("t") + ZERO) * 1e6).cast("long"))).withWatermark("ts", f"{delay_ms} milliseconds")
        processor, mode = EventTimeRunDetector(drop, min_duration, window, delay_ms), "EventTime"
    else:
        stamped = samples
        processor, mode = RunDetector(drop, min_duration, window, idle_ms), "ProcessingTime" if idle_ms is not None else "None"
    return stamped.groupBy("subject_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=RUN_SCHEMA, outputMode="Append", timeMode=mode
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were dropped, over the reported batches of a query."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def run_stream(stream: DataFrame, name: str) -> tuple[DataFrame, StreamingQuery]:
    """Run a stream over what is available now into Parquet below the shared folder: (that table, the finished query)."""
    spark = stream.sparkSession
    out, state = shared_path(spark, name), shared_path(spark, f"{name}-state")
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), query


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """The table of ``run_stream``."""
    return run_stream(stream, name)[0]


#: Change folders of ``stream_latest`` that are merged into one.
COMPACT = 8


def stream_latest(stream: DataFrame, keys: Sequence[str], ts: str, order: str, compact: int = COMPACT) -> DataFrame:
    """Newest record per key of an arriving log, run over what is available now.

    The newest record of each key is kept as keyed state. A batch writes only
    the keys that it changed, below a folder of its own number, so that a
    repeated batch replaces itself. Every ``compact`` batches the folders so far are
    merged into one of the last change per key, so what is read doesn't grow with the
    number of batches; the folders that a merge has read go with the next merge.
    """
    spark, path = stream.sparkSession, shared_path(stream.sparkSession, "latest")
    newest = pick_latest(stream, keys, ts, order)
    schema = T.StructType([*newest.schema.fields, T.StructField("batch", T.LongType())])
    last = F.max_by(F.struct(*newest.columns, "batch"), F.col("batch"))

    def merged(folders: list[str]) -> DataFrame:
        return spark.read.schema(schema).parquet(*folders).groupBy(*keys).agg(last.alias("_r")).select("_r.*")

    def known() -> tuple[int, list[str]]:
        """(last batch of the newest whole merge, or -1; the folders that stand for all batches)."""
        names = [n for n in folder_names(spark, path) if path_exists(spark, f"{path}/{n}/_SUCCESS")]
        upto = max((int(n.removeprefix("upto-")) for n in names if n.startswith("upto-")), default=-1)
        return upto, [f"{path}/{n}" for n in names if n == f"upto-{upto}" or n.startswith("batch-") and int(n.removeprefix("batch-")) > upto]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/batch-{batch_id}")
        upto, folders = known()
        if len(folders) > compact:
            merged(folders).write.mode("overwrite").parquet(f"{path}/upto-{batch_id}")
            for name in folder_names(spark, path):
                kind, _, number = name.partition("-")
                if kind == "upto" and int(number) < upto or kind == "batch" and int(number) <= upto:
                    delete_folder(spark, f"{path}/{name}")

    query = (
        newest.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", shared_path(spark, "latest-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    folders = known()[1] if path_exists(spark, path) else []
    return merged(folders).select(*newest.columns) if folders else spark.createDataFrame([], newest.schema)

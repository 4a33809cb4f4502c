"""Structured Streaming forms. Event time is cast to TIMESTAMP: watermarks reject TIMESTAMP_NTZ."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberline.config import DEFAULT, Config
from emberline.session import shared_dir


#: Rows that a trigger of a replay takes, in files of at most so many.
ROWS_A_TRIGGER, ROWS_A_FILE = 50_000_000, 1_000_000
#: Keeps state on the executors' disks, beside memory, as transformWithState needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, path: str, files_a_trigger: int | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Parquet files as a stream with the schema of what is there, or the given one. The path may be one file: as a pattern, it need not be a folder."""
    rows = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_a_trigger:
        rows = rows.option("maxFilesPerTrigger", files_a_trigger)
    return rows.parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


@dataclass(frozen=True)
class Replay:
    """A table dealt to slices of time, to be streamed slice by slice."""

    spark: SparkSession
    root: str
    slices: int
    schema: T.StructType

    @property
    def feed(self) -> str:
        return f"{self.root}/feed"

    def stream(self) -> DataFrame:
        return event_stream(self.spark, self.feed, schema=self.schema)

    def send(self, number: int) -> None:
        """Put slice `number` where the stream reads."""
        self.spark.read.schema(self.schema).parquet(f"{self.root}/sliced/slice={number}").write.mode("append").parquet(self.feed)


def time_sliced(spark: SparkSession, path: str, rows_a_trigger: int = ROWS_A_TRIGGER, late_share: float = 0.0, rows_a_file: int = ROWS_A_FILE) -> Replay:
    """The table of events in slices of time, each of many files.

    A file source takes what it finds, in no order of the events. So a replay writes
    a slice where the stream reads, runs the stream over it, and only then writes the
    next: no row is late, whatever rows the table's own files hold, and all files of a
    slice are read at once. late_share: so much of the events, the earliest ones, comes
    once more in the end.
    """
    rows = spark.read.parquet(path)
    root = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    count = rows.count()
    slices = max(3 if late_share else 1, -(-count // rows_a_trigger))  # a row is late by the watermark of the trigger before the last
    files = max(1, -(-count // (slices * rows_a_file)))
    dealt = rows.repartitionByRange(slices * files, "ts", "event_id").withColumn("slice", F.floor(F.spark_partition_id() / files).cast("int"))
    dealt.write.partitionBy("slice").parquet(f"{root}/sliced")
    if not count:
        rows.write.parquet(f"{root}/sliced/slice=0")
    have = slices
    if late_share:
        until = rows.agg(F.percentile_approx("ts", F.lit(late_share), F.lit(10_000))).first()[0]
        rows.where(F.col("ts") <= F.lit(until)).write.parquet(f"{root}/sliced/slice={slices}")
        have += 1
    replay = Replay(spark, root, have, rows.schema)
    rows.limit(0).write.parquet(replay.feed)
    return replay


def tumbling(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("v"))
    return g.select(F.col("w.start").alias("start"), "n", "v")


def sessions(events: DataFrame, late: str = "1 hour", config: Config = DEFAULT) -> DataFrame:
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", f"{config.session_gap_minutes} minutes").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def precursor_pairs(events: DataFrame, precursor: str, target: str, late: str = "1 hour", config: Config = DEFAULT) -> DataFrame:
    """Stream-stream join of a unit's target events with the precursors in the hours before; both sides' state is bounded by time."""
    a = events.where(F.col("event_type") == target).select(F.col("event_id").alias("target_id"), F.col("user_id").alias("unit"), F.col("ts").alias("t_ts")).withWatermark("t_ts", late)
    b = events.where(F.col("event_type") == precursor).select(F.col("event_id").alias("precursor_id"), F.col("user_id").alias("unit_"), F.col("ts").alias("p_ts")).withWatermark("p_ts", late)
    span = F.expr(f"unit = unit_ AND p_ts < t_ts AND p_ts >= t_ts - INTERVAL {config.precursor_hours} HOURS")
    return a.join(b, span).select("target_id", "precursor_id")


class EwmaProcessor(StatefulProcessor):
    """A user's mean as state: one number, and the time of the last reading. A user who sends nothing for `idle` loses the state and begins anew."""

    def __init__(self, alpha: float, idle_ms: int) -> None:
        self.alpha, self.idle_ms = alpha, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mean = handle.getValueState("mean", "value double, last_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        value, last = self.mean.get() if self.mean.exists() else (None, None)
        found = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for v, ms in zip(found["value"], found["ts"].map(lambda t: int(t.timestamp() * 1000)), strict=True):
            if last is not None and ms - last > self.idle_ms:
                value = None  # the timer had come in this batch's span
            value, last = (v if value is None else self.alpha * v + (1 - self.alpha) * value), ms
        self.mean.update((value, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.idle_ms)
        yield pd.DataFrame({"user_id": [key[0]], "ewma": [value], "known": [True]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.mean.clear()
        yield pd.DataFrame({"user_id": [key[0]], "ewma": [float("nan")], "known": [False]})

    def close(self) -> None:
        pass


def ewma(events: DataFrame, late: str = "1 hour", config: Config = DEFAULT) -> DataFrame:
    """user_id, ewma, known: each user's exponentially weighted mean after a batch, or known false where the user was idle for config.idle_days and the state has gone.

    A batch's readings of a user are taken in time order, in one task; a stream's trigger bounds them.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = events.where("value is not null and ts is not null").select("user_id", "ts", "event_id", "value").withWatermark("ts", late)
    processor = EwmaProcessor(config.ewma_alpha, int(config.idle_days * 86_400_000))
    return rows.groupBy("user_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType="user_id long, ewma double, known boolean", outputMode="Update", timeMode="EventTime")


def run_to_tier(stream: DataFrame, name: str, mode: str = "append", fold: Callable[[DataFrame], DataFrame] | None = None, restarts: int = 0, replay: Replay | None = None) -> DataFrame:
    """Run a stream over what is there, batch by batch into Parquet, and read that. fold: what to make of the rows read. restarts: how often to start it again from its checkpoint. replay: whose slices to send one by one, each to a run that starts from the checkpoint of the one before."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def batch(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{root}/data/number={number}")

    for k in range((replay.slices if replay else 1) + restarts):
        if replay and k < replay.slices:
            replay.send(k)
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(batch).start()
        q.awaitTermination()
    out = spark.read.parquet(f"{root}/data").drop("number")
    return fold(out) if fold else out.drop("batch")

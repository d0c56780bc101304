"""Streaming forms of the event operators: state machine, active sessions, last write wins, incremental sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from glyphmill.operators import ordered, review

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 100) -> DataFrame:
    """A stream over the Parquet files of a table, with the schema that they have."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def sorted_parts(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one key and batch in the order of their time."""
    parts = list(rows)
    if parts:
        yield pd.concat(parts).sort_values(["ts", "event_id"])


class Replay(StatefulProcessor):
    """One small state for each key: where its state machine stands, and counts."""

    def __init__(self, start: str = "proposed"):
        self.start = start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("machine", "state string, n_legal int, n_illegal int, n_reopened int, n_late int, last_ts long, last_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, legal, illegal, reopened, late, *last = self.state.get() if self.state.exists() else (self.start, 0, 0, 0, 0, -(2**63), -(2**63))
        for part in sorted_parts(rows):
            for ts, event, action in zip(part["ts"], part["event_id"], part["action"]):
                if (ts, event) <= tuple(last):
                    late += 1
                    continue
                to = review.TRANSITIONS.get((state, action))
                legal, illegal, reopened = legal + (to is not None), illegal + (to is None), reopened + (to is not None and action == "reopen")
                state, last = to or state, [int(ts), int(event)]
        self.state.update((state, legal, illegal, reopened, late, *last))
        yield pd.DataFrame({"key": [key[0]], "state": [state], "n_legal": [legal], "n_illegal": [illegal], "n_reopened": [reopened], "n_late": [late]})

    def close(self) -> None:
        pass


def replay(events: DataFrame, key: str) -> DataFrame:
    """State of each key after every batch, from a stream (key, ts, event_id, action); in update mode.

    Events of a key are ordered inside a batch.  An event that is not later
    than one of an earlier batch can't be put in its place any more: it is
    counted in ``n_late`` and changes nothing.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = events.select(F.col(key).cast("long").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").cast("long").alias("event_id"), "action")
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Replay(), outputStructType="key long, state string, n_legal int, n_illegal int, n_reopened int, n_late int", outputMode="Update", timeMode="None")


def sessions(events: DataFrame, user: str, ts: str = "ts", idle: str = "120 seconds", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: runs of events with gaps under the idle time; in append mode once the watermark passes."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    spans = timed.groupBy(F.session_window("__ts", idle), user).agg(F.count(F.lit(1)).alias("n_events"), F.min("__ts").alias("first"), F.max("__ts").alias("last"))
    return spans.select(user, "n_events", ((F.unix_micros("last") - F.unix_micros("first")) / 1e6).alias("active_seconds"), F.col("first").alias("started"))


def upsert_stream(writes: DataFrame, path: str, checkpoint: str, key: str, order: list[str], text: str, user: str, status: str):
    """Appends a stream of writes to a log, batch by batch and idempotently; ``current`` folds the log."""

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return writes.select(key, *order, text, user, status).writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, key: str, order: list[str], text: str, user: str, status: str) -> DataFrame:
    """The last write of each key in a log of writes."""
    return ordered.upsert(spark.read.parquet(path), key, order, text, user, status)


def append_results(results: DataFrame, path: str, checkpoint: str):
    """Results are appended to a folder as their batches finish."""
    return results.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def distinct_clicks(clicks: DataFrame, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Clicks without repeats inside the lateness that is allowed."""
    return clicks.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).dropDuplicatesWithinWatermark(keys).drop("__ts")

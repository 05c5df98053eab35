"""Conversation history as list state with a cap and an idle time-out.

Before the exchange every Arrow batch is cut to the newest ``keep`` rows per session, so a session
holding a third of the log sends few rows to its task. The cut is exact: a row dropped there has
``keep`` newer rows in the same batch. A session's state is at most ``keep`` rows; an event-time timer
clears it once the session has been idle too long.

Snapshots are written by batch (``epochs``) and merged into a ``base`` from time to time, so a reader
meets one base and few epochs however long the stream has run. A base counts once ``log`` names it.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from docquery.config import SESSION_HISTORY, SESSION_TIMEOUT_MINUTES
from docquery.functions.windows import top_per_key
from docquery.streaming.run import run_available, session_conf

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = ["micros", "request_id", "query", "response"]
ROW = T.StructType([
    T.StructField("micros", T.LongType()), T.StructField("request_id", T.StringType()),
    T.StructField("query", T.StringType()), T.StructField("response", T.StringType())])
SNAPSHOT = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("version", T.LongType()), *ROW.fields])
# Batches after which their snapshots are merged into a new base.
MERGE_AFTER = 16


def newest(rows: pd.DataFrame, keep: int) -> pd.DataFrame:
    return rows.sort_values(["micros", "request_id"]).groupby("session_id", sort=False).tail(keep)


def after_last_gap(items: list, idle_micros: int) -> list:
    """Items since the last pause longer than the time-out."""
    for i in range(len(items) - 1, 0, -1):
        if items[i][0] - items[i - 1][0] > idle_micros:
            return items[i:]
    return items


class History(StatefulProcessor):
    """Keeps each session's newest rows since its last idle gap; yields them whenever the session is touched."""

    def __init__(self, keep: int, idle: int):
        self.keep, self.idle = keep, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("history", ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        items = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        for batch in rows:
            new = batch[FIELDS].astype(object).where(batch[FIELDS].notna(), None)
            items = sorted(items + [(int(r[0]), *r[1:]) for r in new.itertuples(index=False, name=None)],
                           key=lambda x: (x[0], x[1] is not None, x[1]))[-self.keep:]
        items = after_last_gap(items, self.idle)
        self.rows.put(items)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        last = items[-1][0]
        self.handle.registerTimer((last + self.idle) // 1000 + 1)
        out = pd.DataFrame(items, columns=FIELDS)
        # a later batch holds the same newest row or a newer one
        out.insert(0, "version", last)
        out.insert(0, "session_id", key[0])
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        yield from ()

    def close(self) -> None:
        pass


def history_updates(logs: DataFrame, keep: int = SESSION_HISTORY, minutes: int = SESSION_TIMEOUT_MINUTES,
                    lateness: str = "10 minutes") -> DataFrame:
    """A snapshot of every touched session per batch: its rows since the last idle gap, ``keep`` at most."""

    def trim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield newest(batch, keep)

    rows = logs.select(
        "session_id", "timestamp", F.unix_micros("timestamp").alias("micros"), "request_id", "query", "response")
    # the newest row of a batch survives the trim, so the watermark behind it is the same
    trimmed = rows.mapInPandas(trim, rows.schema).withWatermark("timestamp", lateness)
    return trimmed.groupBy("session_id").transformWithStateInPandas(
        History(keep, minutes * 60 * 1_000_000), SNAPSHOT, "Append", "EventTime")


def track_history(logs: DataFrame, path: str, checkpoint: str, **kw) -> None:
    """Process what is there; merge the snapshots where MERGE_AFTER batches have come since the last time."""
    spark = logs.sparkSession
    spark.createDataFrame([], SNAPSHOT).write.mode("ignore").parquet(f"{path}/epochs/epoch=-1")
    spark.createDataFrame([(-1,)], "base long").write.mode("ignore").parquet(f"{path}/log")

    def keep_batch(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epochs/epoch={number}")

    with session_conf(spark, **{"spark.sql.streaming.stateStore.providerClass": ROCKSDB}):
        run_available(history_updates(logs, **kw).writeStream.foreachBatch(keep_batch).outputMode("append"), checkpoint)
    base, epochs = _layout(spark, path)
    if len([e for e in epochs if e > base]) >= MERGE_AFTER:
        merge_history(spark, path)


def merge_history(spark: SparkSession, path: str) -> None:
    """Write the newest snapshot of each session as the new base, then name it; a crash in between changes nothing."""
    _, epochs = _layout(spark, path)
    upto = max(epochs)
    _snapshots(spark, path).write.mode("overwrite").parquet(f"{path}/base={upto}")
    spark.createDataFrame([(upto,)], "base long").write.mode("append").parquet(f"{path}/log")


def _layout(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The base that counts, and the numbers of all epochs (from their folders' names)."""
    base = spark.read.schema("base long").parquet(f"{path}/log").agg(F.max("base")).first()[0]
    files = spark.read.schema(SNAPSHOT).parquet(f"{path}/epochs").inputFiles()
    return base, sorted({int(f.rpartition("/epoch=")[2].partition("/")[0]) for f in files})


def _snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot of each session, from the base and the epochs after it. Of equal versions the later batch
    holds at least the rows of the earlier one."""
    base, epochs = _layout(spark, path)
    parts = [spark.read.schema(SNAPSHOT).parquet(f"{path}/epochs/epoch={e}").withColumn("epoch", F.lit(e)) for e in epochs if e > base]
    if base >= 0:
        parts.append(spark.read.schema(SNAPSHOT).parquet(f"{path}/base={base}").withColumn("epoch", F.lit(base)))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    latest = rows.groupBy("session_id").agg(F.max(F.struct("version", "epoch")).alias("newest"))
    return (rows.join(latest.withColumnRenamed("session_id", "_id"), F.col("session_id").eqNullSafe(F.col("_id")))
            .where((F.col("version") == F.col("newest.version")) & (F.col("epoch") == F.col("newest.epoch")))
            .drop("_id", "newest", "epoch"))


def read_history(spark: SparkSession, path: str, keep: int = SESSION_HISTORY) -> DataFrame:
    """The newest snapshot of each session; ``recency`` 1 is the newest row."""
    current = _snapshots(spark, path).withColumn("timestamp", F.timestamp_micros("micros"))
    return top_per_key(current.drop("version", "micros"), ["session_id"],
                       [F.desc("timestamp"), F.desc("request_id")], keep, "recency")

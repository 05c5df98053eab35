"""The request log as a stream: append, tumbling metrics, idle sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docquery.config import SESSION_TIMEOUT_MINUTES
from docquery.streaming.run import run_available, session_conf

LATENESS = "10 minutes"


def append_log(logs: DataFrame, path: str, checkpoint: str) -> None:
    """Exactly-once append to day folders: the file sink's own log lists the committed files."""
    writer = logs.writeStream.format("parquet").partitionBy("date_day").option("path", path).outputMode("append")
    run_available(writer, checkpoint)


def tumbling_metrics(logs: DataFrame, width: str = "1 hour", lateness: str = LATENESS,
                     keys: tuple[str, ...] = ("model_version",)) -> DataFrame:
    """Count, mean latency and errors per window. Rows later than the watermark are dropped; with append
    output a window appears once the watermark has passed its end, so state stays bounded."""
    return (
        logs.withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", width).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("request_count"), F.avg("latency_ms").alias("avg_latency"),
             F.count_if(F.col("response").like("Error:%")).alias("errors"))
        .select(F.col("w.start").alias("window_start"), *keys, "request_count", "avg_latency", "errors")
    )


def idle_sessions(logs: DataFrame, key: str = "user_id", minutes: int = SESSION_TIMEOUT_MINUTES,
                  lateness: str = LATENESS) -> DataFrame:
    return (
        logs.withWatermark("timestamp", lateness)
        .groupBy(F.session_window("timestamp", f"{minutes} minutes").alias("w"), key)
        .agg(F.count(F.lit(1)).alias("requests"), F.max("timestamp").alias("session_end"))
        .select(key, F.col("w.start").alias("session_start"), "session_end", "requests")
    )


def write_append(df: DataFrame, path: str, checkpoint: str) -> None:
    run_available(df.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint)


def write_idle_sessions(logs: DataFrame, path: str, checkpoint: str, **kw) -> None:
    """Rows of one key are merged into sessions before the exchange, so a busy key sends few rows."""
    spark = logs.sparkSession
    with session_conf(spark, **{"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}):
        write_append(idle_sessions(logs, **kw), path, checkpoint)


def write_complete(df: DataFrame, path: str, checkpoint: str) -> str:
    """Every batch replaces the whole (window-sized) result; returns the folder of versions."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    run_available(df.writeStream.foreachBatch(store).outputMode("complete"), checkpoint)
    return path


def read_latest_version(spark, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("version") == df.agg(F.max("version")).scalar()).drop("version")

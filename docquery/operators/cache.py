"""The answer cache: built from the log, probed by semi and anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docquery.config import CACHE_TTL_MINUTES


def query_hash(query: str) -> Column:
    return F.sha2(F.col(query), 256)


def build_cache(logs: DataFrame) -> DataFrame:
    """One row per question: latest response, first and last time, number of uses."""
    return (
        logs.groupBy(query_hash("query").alias("query_hash"))
        .agg(F.max("query").alias("query"),
             F.max_by("response", F.struct("timestamp", "request_id")).alias("response"),
             F.min("timestamp").alias("created_at"), F.count(F.lit(1)).alias("access_count"),
             F.max("timestamp").alias("last_accessed"))
    )


def _fresh(minutes: int) -> Column:
    age = F.unix_micros("r.timestamp") - F.unix_micros("c.last_accessed")
    return (F.col("r._hash") == F.col("c.query_hash")) & (age >= 0) & (age <= minutes * 60 * 1_000_000)


def _probe(requests: DataFrame, cache: DataFrame, minutes: int, how: str) -> DataFrame:
    left = requests.withColumn("_hash", query_hash("query")).alias("r")
    right = cache.select("query_hash", "last_accessed").alias("c")
    return left.join(right, _fresh(minutes), how).drop("_hash")


def cache_hits(requests: DataFrame, cache: DataFrame, minutes: int = CACHE_TTL_MINUTES) -> DataFrame:
    """Requests whose question was cached and used within the last ``minutes``."""
    return _probe(requests, cache, minutes, "left_semi")


def cache_misses(requests: DataFrame, cache: DataFrame, minutes: int = CACHE_TTL_MINUTES) -> DataFrame:
    return _probe(requests, cache, minutes, "left_anti")


def merge_caches(older: DataFrame, newer: DataFrame) -> DataFrame:
    """The cache of both logs together from the caches of each: a new day is one aggregate over that day, merged by
    question. Where a question was last used at the same time in both, the newer response stays."""
    both = older.withColumn("_part", F.lit(0)).unionByName(newer.withColumn("_part", F.lit(1)))
    return both.groupBy("query_hash").agg(
        F.max("query").alias("query"), F.max_by("response", F.struct("last_accessed", "_part")).alias("response"),
        F.min("created_at").alias("created_at"), F.sum("access_count").alias("access_count"),
        F.max("last_accessed").alias("last_accessed"))

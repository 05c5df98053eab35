"""The request log: filling, filtering, latest rows."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from docquery.functions.text import token_count


def as_timestamp(value) -> Column:
    """A literal, a column or a one-row frame (used as scalar subquery) as timestamp."""
    if isinstance(value, DataFrame):
        value = value.scalar()
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def latest_time(logs: DataFrame, ts: str = "timestamp") -> Column:
    """max(ts) as a scalar subquery: it stays in the plan, nothing is collected."""
    return logs.agg(F.max(ts)).scalar()


def fill_defaults(logs: DataFrame, default_user: str = "system",
                  default_metadata: dict[str, str] | None = None) -> DataFrame:
    """Missing token counts are word counts; user, metadata and day get defaults."""
    pairs = (default_metadata or {"source": "inference_logger"}).items()
    fallback = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    return logs.withColumns({
        "tokens_input": F.coalesce("tokens_input", token_count("query")),
        "tokens_output": F.coalesce("tokens_output", token_count("response")),
        "user_id": F.coalesce("user_id", F.lit(default_user)),
        "metadata": F.when(F.size(F.col("metadata")) > 0, F.col("metadata")).otherwise(fallback),
        "date_day": F.coalesce("date_day", F.date_format("timestamp", "yyyy-MM-dd")),
    })


def filter_logs(logs: DataFrame, start: datetime | str | None = None, end: datetime | str | None = None,
                user_id: str | None = None, partitioned: bool = True) -> DataFrame:
    """Closed time range and user; the implied day range is added so day folders are pruned."""
    conditions = []
    if start is not None:
        conditions.append(F.col("timestamp") >= as_timestamp(start))
    if end is not None:
        conditions.append(F.col("timestamp") <= as_timestamp(end))
    if user_id:
        conditions.append(F.col("user_id") == user_id)
    if partitioned and "date_day" in logs.columns:
        day = lambda v: F.date_format(F.lit(v).cast("timestamp"), "yyyy-MM-dd")
        if start is not None:
            conditions.append(F.col("date_day") >= day(start))
        if end is not None:
            conditions.append(F.col("date_day") <= day(end))
    return logs.where(reduce(lambda a, b: a & b, conditions)) if conditions else logs


def latest_logs(logs: DataFrame, limit: int = 100) -> DataFrame:
    return logs.orderBy(F.desc("timestamp"), F.asc("request_id")).limit(limit)


def since(logs: DataFrame, as_of, interval: str, ts: str = "timestamp") -> DataFrame:
    """Rows not older than ``interval`` (for example '24 HOURS') before ``as_of``."""
    return _from(logs, as_timestamp(as_of) - F.expr(f"INTERVAL {interval}"), ts)


def _from(logs: DataFrame, start: Column, ts: str) -> DataFrame:
    """The day test repeats the time test on the partition column, so older folders are not read."""
    recent = F.col(ts) >= start
    if "date_day" in logs.columns:
        recent = recent & (F.col("date_day") >= F.date_format(start, "yyyy-MM-dd"))
    return logs.where(recent)


def since_midnight(logs: DataFrame, as_of, ts: str = "timestamp") -> DataFrame:
    return _from(logs, F.date_trunc("day", as_timestamp(as_of)), ts)

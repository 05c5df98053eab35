"""Sessions and conversation history derived from the log.

A session may hold a third of all rows: histories are cut before the exchange, idle gaps are found on
time cells, and neighbour turns are paired in ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docquery import config
from docquery.functions.windows import lead_split, top_per_key
from docquery.operators.logs import as_timestamp

NOT_FOUND_TEXT = "Session not found or expired. Please create a new session."
COMPLEX_RESPONSE = "[Complex response]"


def session_records(logs: DataFrame, history: int = config.SESSION_HISTORY) -> DataFrame:
    """session_id, user_id of the first row, created, last_active, history_size (capped)."""
    return logs.groupBy("session_id").agg(
        F.coalesce(F.min_by("user_id", F.struct("timestamp", "request_id")), F.lit("anonymous")).alias("user_id"),
        F.min("timestamp").alias("created"), F.max("timestamp").alias("last_active"),
        F.least(F.count(F.lit(1)), F.lit(history).cast("bigint")).alias("history_size"))


def list_sessions(logs: DataFrame, user_id: str | None = None) -> DataFrame:
    records = session_records(logs)
    return records.where(F.col("user_id") == user_id) if user_id else records


def trim_history(logs: DataFrame, keep: int = config.SESSION_HISTORY, key: str = "session_id",
                 order: list[str] = ["timestamp", "request_id"]) -> DataFrame:
    """The last ``keep`` rows per session; ``recency`` 1 is the newest."""
    return top_per_key(logs, [key], [F.desc(c) for c in order], keep, "recency")


def response_text(text: Column, structured: Column | None = None) -> Column:
    """Plain text, else the ``response`` field of a structured record, else a marker."""
    inner = structured if structured is not None else F.lit(None).cast("string")
    return F.coalesce(text, inner, F.lit(COMPLEX_RESPONSE))


def conversation_context(history: DataFrame, key: str, order: list[str], query: str, response: str,
                         max_items: int | None = None) -> DataFrame:
    """One context text per session from its last items; no item or 0 means the default of 20."""
    limit = min(max_items or config.SESSION_HISTORY, config.SESSION_HISTORY)
    last = top_per_key(history, [key], [F.desc(c) for c in order], limit, "_recency")
    item = F.concat(F.lit("User: "), F.coalesce(F.col(query), F.lit("None")), F.lit("\nAssistant: "),
                    response_text(F.col(response)), F.lit("\n"))
    # at most ``limit`` items per session reach the list
    listed = F.array_sort(F.collect_list(F.struct((-F.col("_recency")).alias("o"), item.alias("t"))))
    body = F.array_join(F.transform(listed, lambda x: x["t"]), "")
    return last.groupBy(key).agg(F.concat(F.lit("Previous conversation:\n"), body).alias("context"))


def context_for(sessions: DataFrame, contexts: DataFrame, key: str) -> DataFrame:
    """Sessions without history get an empty context."""
    return sessions.join(contexts, key, "left").withColumn("context", F.coalesce("context", F.lit("")))


def pair_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
               text: str = "text") -> DataFrame:
    """Each user turn with the assistant turn directly after it."""
    paired = lead_split(turns.select(key, order, role, text), key, order, [role, text])
    return paired.where((F.col(role) == "user") & (F.col(f"next_{role}") == "assistant")).select(
        key, order, F.col(text).alias("query"), F.col(f"next_{text}").alias("response"))


def sessionize(logs: DataFrame, key: str = "user_id", ts: str = "timestamp",
               minutes: int = config.SESSION_TIMEOUT_MINUTES) -> DataFrame:
    """Idle sessions per key: a gap longer than ``minutes`` starts a new one.

    Two rows of one aligned cell of that length are never further apart, so a cell lies in one session.
    Rows are first folded into (key, cell) bounds map-side; the gap test runs over cells, whose
    number per key is bounded by the covered time, not by the rows.
    """
    seconds = minutes * 60
    cells = logs.groupBy(F.col(key), F.floor(F.unix_micros(ts) / (seconds * 1_000_000)).alias("_cell")).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key).orderBy("_cell")
    gap = F.unix_micros("_first") - F.unix_micros(F.lag("_last").over(w))
    starts = cells.withColumn("_new", F.when(gap.isNull() | (gap > seconds * 1_000_000), 1).otherwise(0))
    numbered = starts.withColumn("session_no", F.sum("_new").over(w))
    return numbered.groupBy(key, "session_no").agg(
        F.min("_first").alias("session_start"), F.max("_last").alias("session_end"), F.sum("_n").alias("requests"))


def expired_sessions(records: DataFrame, as_of, minutes: int = config.SESSION_TIMEOUT_MINUTES) -> DataFrame:
    """Idle for strictly longer than ``minutes``."""
    idle = F.unix_micros(as_timestamp(as_of)) - F.unix_micros("last_active")
    return records.where(idle > minutes * 60 * 1_000_000)


def live_sessions(records: DataFrame, as_of, minutes: int = config.SESSION_TIMEOUT_MINUTES) -> DataFrame:
    """The records that expired_sessions leaves; one without a time stays."""
    idle = F.unix_micros(as_timestamp(as_of)) - F.unix_micros("last_active")
    return records.where(F.coalesce(idle <= minutes * 60 * 1_000_000, F.lit(True)))


def evict_sessions(records: DataFrame, capacity: int = config.SESSION_CAPACITY):
    """(kept, evicted): the ``capacity`` most recently active sessions stay."""
    kept = records.orderBy(F.desc("last_active"), "session_id").limit(capacity)
    # rows at or after the oldest kept one stay: a comparison with two scalars, not an anti-join
    edge = kept.agg(F.max(F.struct((-F.unix_micros("last_active")).alias("t"), F.col("session_id").alias("s")))).scalar()
    place = F.struct((-F.unix_micros("last_active")).alias("t"), F.col("session_id").alias("s"))
    return kept, records.where(place > edge)


def delete_sessions(records: DataFrame, doomed: DataFrame) -> DataFrame:
    return records.join(doomed.select("session_id"), "session_id", "left_anti")


def lookup_sessions(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Requests naming an unknown session become error records."""
    known = records.select("session_id", F.lit(True).alias("_known"))
    missing = F.col("_known").isNull()
    return requests.join(known, "session_id", "left").withColumns({
        "status": F.when(missing, "error").otherwise("ok"),
        "error": F.when(missing, "SESSION_NOT_FOUND"),
        "response": F.when(missing, NOT_FOUND_TEXT),
    }).drop("_known")


def repeated_within(logs: DataFrame, key: str, minutes: int, out: str, ts: str = "timestamp",
                    tie: str = "request_id") -> DataFrame:
    """Flags rows whose key occurred at most ``minutes`` before.

    Each key is windowed per hour-like cell and the newest time of the cell before is carried over,
    so a key holding a third of all rows is spread over its cells.
    """
    micros = minutes * 60 * 1_000_000
    cell = F.floor(F.unix_micros(ts) / micros)
    celled = logs.withColumn("_cell", cell)
    last = celled.groupBy(key, "_cell").agg(F.max(ts).alias("_before"))
    carried = last.select(F.col(key).alias("_k"), (F.col("_cell") + 1).alias("_c"), "_before")
    joined = celled.join(carried, (F.col(key) == F.col("_k")) & (F.col("_cell") == F.col("_c")), "left")
    w = Window.partitionBy(key, "_cell").orderBy(ts, tie)
    previous = F.coalesce(F.lag(ts).over(w), F.col("_before"))
    gap = F.unix_micros(ts) - F.unix_micros(previous)
    return joined.withColumn(out, F.coalesce(gap <= micros, F.lit(False))).select(*logs.columns, out)


def count_repeated(logs: DataFrame, key: str, minutes: int, ts: str = "timestamp", tie: str = "request_id") -> DataFrame:
    """One number: the rows that ``repeated_within`` would flag. Only a hash of the key, the time and the tie-breaker are
    shuffled, not the rows."""
    narrow = logs.select(F.when(F.col(key).isNotNull(), F.xxhash64(key)).alias(key), ts, tie)
    return repeated_within(narrow, key, minutes, "_repeated", ts, tie).agg(F.count_if("_repeated"))

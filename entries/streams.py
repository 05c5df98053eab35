"""Streams run over the tables until nothing is left, then read back."""

from functools import partial

from pyspark.sql import functions as F

from docquery.operators.chunking import chunk_documents
from docquery.operators.embedding import embed_tfidf, fit_tfidf
from docquery.session import scratch_path, spread
from docquery.sources.sinks import read_log
from docquery.streaming import bucketed_index, index_sync, logs as SL, session_state
from docquery.streaming.run import files_as_stream

from entries import retrieval, sessions  # noqa: F401  (their SQL is reused)
from entries.tables import REGISTRY, WITH_LOGS, as_log, load, register


def table_stream(spark, sf, table):
    # a pattern, because a stream takes a plain path for a folder and a table may be one file
    return files_as_stream(spark, f"{sf}/{table}.parque[t]", load(spark, sf, table).schema)


def log_stream(spark, sf):
    return as_log(table_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))


@register("stream_log_append", WITH_LOGS + 'SELECT request_id, "timestamp", query, response, date_day FROM logs')
def _(spark, sf):
    path = scratch_path(spark, "log")
    SL.append_log(log_stream(spark, sf), path, scratch_path(spark, "ckpt"))
    return read_log(spark, path).select("request_id", "timestamp", "query", "response", "date_day")


# Append output: only windows the watermark has passed.
@register("stream_tumbling", WITH_LOGS + """
SELECT date_trunc('hour', "timestamp") AS window_start, model_version, count(*) AS request_count,
   round(avg(latency_ms), 6) AS avg_latency, count(*) FILTER (response LIKE 'Error:%') AS errors
FROM logs GROUP BY 1, 2 HAVING date_trunc('hour', "timestamp") + INTERVAL 1 HOUR <= (SELECT max("timestamp") FROM logs) - INTERVAL 10 MINUTES""")
def _(spark, sf):
    path = scratch_path(spark, "tumbling")
    SL.write_append(SL.tumbling_metrics(log_stream(spark, sf)), path, scratch_path(spark, "ckpt"))
    return spark.read.parquet(path).withColumn("avg_latency", F.round("avg_latency", 6))


@register("stream_tumbling_complete", WITH_LOGS + """
SELECT date_trunc('day', "timestamp")::TIMESTAMP AS window_start, model_name, count(*) AS request_count,
   round(avg(latency_ms), 6) AS avg_latency, count(*) FILTER (response LIKE 'Error:%') AS errors FROM logs GROUP BY 1, 2""")
def _(spark, sf):
    days = SL.tumbling_metrics(log_stream(spark, sf), "1 day", keys=("model_name",))
    path = SL.write_complete(days, scratch_path(spark, "days"), scratch_path(spark, "ckpt"))
    return SL.read_latest_version(spark, path).withColumn("avg_latency", F.round("avg_latency", 6))


@register("stream_sessions", WITH_LOGS + """,
g AS (SELECT user_id, "timestamp", CASE WHEN "timestamp" - lag("timestamp") OVER w <= INTERVAL 60 MINUTES THEN 0 ELSE 1 END AS s
      FROM logs WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp")),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY "timestamp" ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, min("timestamp") AS session_start, max("timestamp") AS session_end, count(*) AS requests
FROM n GROUP BY user_id, no HAVING max("timestamp") + INTERVAL 60 MINUTES <= (SELECT max("timestamp") FROM logs) - INTERVAL 10 MINUTES""")
def _(spark, sf):
    path = scratch_path(spark, "sessions")
    SL.write_idle_sessions(log_stream(spark, sf), path, scratch_path(spark, "ckpt"))
    return spark.read.parquet(path)


@register("stream_session_state", WITH_LOGS + """,
r AS (SELECT session_id, request_id, query, "timestamp", row_number() OVER w AS recency,
        lag("timestamp") OVER w - "timestamp" > INTERVAL 60 MINUTES AS gap FROM logs
      WINDOW w AS (PARTITION BY session_id ORDER BY "timestamp" DESC, request_id DESC)),
c AS (SELECT *, sum(coalesce(gap, false)::INTEGER) OVER (PARTITION BY session_id ORDER BY recency) AS gaps FROM r WHERE recency <= 20)
SELECT session_id, request_id, query, recency::INTEGER AS recency FROM c WHERE gaps = 0""")
def _(spark, sf):
    path = scratch_path(spark, "history")
    session_state.track_history(log_stream(spark, sf), path, scratch_path(spark, "ckpt"))
    return session_state.read_history(spark, path).select("session_id", "request_id", "query", "recency")


@register("stream_index_sync", REGISTRY["chunk_packed"][1])
def _(spark, sf):
    docs = spread(load(spark, sf, "documents"), "doc_id")
    model = fit_tfidf(chunk_documents(docs, "doc_id", "text"))
    path = scratch_path(spark, "index")
    index_sync.sync_index(table_stream(spark, sf, "documents"), model, path, scratch_path(spark, "ckpt"), "doc_id", "text")
    return index_sync.read_index(spark, path).select("chunk_id", "document_id", "position", "content")


@register("stream_index_bucketed", REGISTRY["chunk_packed"][1])
def _(spark, sf):
    """All documents as a stream into a bucketed index, then every other document once more with its text doubled and
    back again: the index ends as the documents' chunks."""
    docs = load(spark, sf, "documents")
    model = fit_tfidf(chunk_documents(spread(docs, "doc_id"), "doc_id", "text"))
    index = bucketed_index.BucketedIndex(spark, scratch_path(spark, "bucketed"), bucketed_index.chunk_schema(spark, model), 16)
    bucketed_index.sync_bucketed(table_stream(spark, sf, "documents"), model, index, scratch_path(spark, "ckpt"), "doc_id", "text")
    even = docs.where("doc_id % 2 = 0")
    keys = even.select(F.col("doc_id").cast("string"))
    for version, text in ((1 << 40, F.concat("text", F.lit("\n"), "text")), ((1 << 40) + 1, F.col("text"))):
        again = chunk_documents(spread(even.withColumn("text", text), "doc_id"), "doc_id", "text")
        index.upsert(again, keys, version, partial(embed_tfidf, model))
    return index.read().select("chunk_id", "document_id", "position", "content")

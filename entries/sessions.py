"""Sessions, conversation history, star-schema questions, change tracking."""

from pyspark.sql import functions as F

from docquery.operators import changes as C, logs as L, sessions as S, star

from entries.guard import PAIRS, pairs
from entries.tables import WITH_LOGS, load, logs, register

RECORDS = WITH_LOGS + """,
records AS (SELECT session_id, arg_min(user_id, ("timestamp", request_id)) AS user_id, min("timestamp") AS created,
   max("timestamp") AS last_active, least(count(*), 20)::BIGINT AS history_size FROM logs GROUP BY 1)
"""


@register("sessions_list", RECORDS + "SELECT * FROM records")
def _(spark, sf):
    return S.list_sessions(logs(spark, sf))


@register("sessions_by_user", RECORDS + "SELECT * FROM records WHERE user_id = '8'")
def _(spark, sf):
    return S.list_sessions(logs(spark, sf), "8")


@register("history_trim", WITH_LOGS + """
SELECT session_id, request_id, query, recency FROM (SELECT *, row_number() OVER (PARTITION BY session_id
  ORDER BY "timestamp" DESC, request_id DESC)::INTEGER AS recency FROM logs) WHERE recency <= 20""")
def _(spark, sf):
    return S.trim_history(logs(spark, sf)).select("session_id", "request_id", "query", "recency")


@register("conversation_context", WITH_LOGS + """
SELECT session_id, 'Previous conversation:' || chr(10) || string_agg('User: ' || query || chr(10) || 'Assistant: ' ||
   coalesce(response, '[Complex response]') || chr(10), '' ORDER BY "timestamp", request_id) AS context
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY "timestamp" DESC, request_id DESC) AS r FROM
  (SELECT * REPLACE (CASE WHEN response = 'ok' THEN NULL ELSE response END AS response) FROM logs))
WHERE r <= 20 GROUP BY 1""")
def _(spark, sf):
    # structured answers have no plain text: the short ones stand for them
    df = logs(spark, sf).withColumn("response", F.when(F.col("response") != "ok", F.col("response")))
    return S.conversation_context(df, "session_id", ["timestamp", "request_id"], "query", "response")


@register("sessionize", WITH_LOGS + """,
g AS (SELECT user_id, "timestamp", CASE WHEN "timestamp" - lag("timestamp") OVER w <= INTERVAL 60 MINUTES THEN 0 ELSE 1 END AS s
      FROM logs WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp")),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY "timestamp" ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM g)
SELECT user_id, session_no, min("timestamp") AS session_start, max("timestamp") AS session_end, count(*) AS requests
FROM n GROUP BY 1, 2""")
def _(spark, sf):
    return S.sessionize(logs(spark, sf))


@register("sessions_expired", RECORDS + """
SELECT session_id, last_active FROM records WHERE (SELECT max("timestamp") FROM logs) - last_active > INTERVAL 60 MINUTES""")
def _(spark, sf):
    df = logs(spark, sf)
    return S.expired_sessions(S.session_records(df), L.latest_time(df)).select("session_id", "last_active")


@register("sessions_evict", RECORDS + """
SELECT session_id, last_active, CASE WHEN r <= 10 THEN 'kept' ELSE 'evicted' END AS fate
FROM (SELECT *, row_number() OVER (ORDER BY last_active DESC, session_id) AS r FROM records)""")
def _(spark, sf):
    kept, evicted = S.evict_sessions(S.session_records(logs(spark, sf)), 10)
    return kept.withColumn("fate", F.lit("kept")).unionByName(evicted.withColumn("fate", F.lit("evicted"))).select(
        "session_id", "last_active", "fate")


# Deleted on request: every session whose last entry was a sign-up.
DOOMED = """(SELECT session_id FROM logs GROUP BY 1 HAVING arg_max(response, ("timestamp", request_id)) = 'an error was found')"""


@register("sessions_delete", RECORDS + f"SELECT * FROM records WHERE session_id NOT IN {DOOMED}")
def _(spark, sf):
    df = logs(spark, sf)
    last = df.groupBy("session_id").agg(F.max_by("response", F.struct("timestamp", "request_id")).alias("r"))
    return S.delete_sessions(S.session_records(df), last.where(F.col("r") == "an error was found"))


@register("session_not_found", RECORDS + """
SELECT e.event_id, 's' || (e.event_id % 60) AS session_id, CASE WHEN r.session_id IS NULL THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN r.session_id IS NULL THEN 'SESSION_NOT_FOUND' END AS error,
  CASE WHEN r.session_id IS NULL THEN 'Session not found or expired. Please create a new session.' END AS response
FROM events e LEFT JOIN records r ON r.session_id = 's' || (e.event_id % 60)""")
def _(spark, sf):
    asked = load(spark, sf, "events").select(
        "event_id", F.concat(F.lit("s"), (F.col("event_id") % 60).cast("string")).alias("session_id"))
    return S.lookup_sessions(asked, S.session_records(logs(spark, sf))).select(
        "event_id", "session_id", "status", "error", "response")


@register("pair_turns", f"WITH {PAIRS} SELECT * FROM pairs")
def _(spark, sf):
    return pairs(spark, sf)


@register("customers_by_region", """
SELECT r_name AS region, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def _(spark, sf):
    places = load(spark, sf, "nation").join(
        load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("r_name").alias("region"))
    # customers are counted per nation first, so only 25 rows meet the names
    per = load(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return per.join(places, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("region").agg(
        F.sum("n").alias("customers"))


@register("revenue_by_segment", """
SELECT c_mktsegment AS segment, round(sum(o_totalprice), 2) AS revenue, count(*) AS orders
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def _(spark, sf):
    out = star.revenue_by(
        load(spark, sf, "orders").withColumnRenamed("o_custkey", "custkey"),
        load(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment")),
        "custkey", "segment", F.col("o_totalprice"))
    return out.withColumn("revenue", F.round("revenue", 2))


@register("revenue_by_type", """
SELECT p_type AS category, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS orders
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def _(spark, sf):
    out = star.revenue_by(
        load(spark, sf, "lineitem").withColumnRenamed("l_partkey", "partkey"),
        load(spark, sf, "part").select(F.col("p_partkey").alias("partkey"), F.col("p_type").alias("category")),
        "partkey", "category", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return out.withColumn("revenue", F.round("revenue", 2))


# Two snapshots of the corpus: the newer one lacks one source, gained another and changed a third.
def snapshots(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    changed = F.when(F.col("source") == "src7", F.concat(F.lit("revised "), "text")).otherwise(F.col("text"))
    return docs.where(F.col("source") != "src3"), docs.where(F.col("source") != "src5").withColumn("text", changed)


SNAPSHOTS = """WITH b AS (SELECT doc_id, text FROM documents WHERE source <> 'src3'),
a AS (SELECT doc_id, CASE WHEN source = 'src7' THEN 'revised ' || text ELSE text END AS text FROM documents WHERE source <> 'src5')
"""


@register("change_feed", SNAPSHOTS + """
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'insert' WHEN a.doc_id IS NULL THEN 'delete'
  ELSE 'update' END AS change
FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.text <> b.text""")
def _(spark, sf):
    before, after = snapshots(spark, sf)
    return C.change_feed(before, after, "doc_id", ["text", "lang", "source"])


@register("index_sync_delta", SNAPSHOTS + """
SELECT a.doc_id, a.text FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND b.text = a.text)""")
def _(spark, sf):
    before, after = snapshots(spark, sf)
    index = before.select("doc_id", C.content_hash(["text", "lang", "source"]).alias("content_hash"))
    return C.not_indexed(after, index, "doc_id", ["text", "lang", "source"]).select("doc_id", "text")


@register("dedup_latest", WITH_LOGS + """
SELECT query, request_id, "timestamp", response FROM (SELECT *, row_number() OVER (PARTITION BY query
  ORDER BY "timestamp" DESC, request_id DESC) AS r FROM logs) WHERE r = 1""")
def _(spark, sf):
    df = logs(spark, sf).select("query", "request_id", "timestamp", "response")
    return C.latest_per_key(df, ["query"], ["timestamp", "request_id"])

"""Aggregations, alerts, windows and the log filters behind them."""

from pyspark.sql import functions as F

from docquery import config
from docquery.operators import logs as L, metrics as M, routing
from docquery.operators.cache import build_cache, cache_hits, cache_misses, merge_caches
from docquery.operators.guardrails import Policy, audit, check_input
from docquery.plans import dashboards

from entries.tables import REGISTRY, WITH_LOGS, knn_sql, load, logs, questions, register

AS_OF = '(SELECT max("timestamp") FROM logs)'


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@register("requests_per_hour", WITH_LOGS + """
SELECT date_trunc('hour', "timestamp") AS hour, count(*) AS request_count FROM logs GROUP BY 1""")
def _(spark, sf):
    return M.requests_per_hour(logs(spark, sf))


@register("latency_by_model", WITH_LOGS + """
SELECT model_name, round(avg(latency_ms), 6) AS avg_latency FROM logs GROUP BY 1""")
def _(spark, sf):
    return rounded(M.latency_by_model(logs(spark, sf)), "avg_latency")


@register("latency_p95_hour", WITH_LOGS + """
SELECT date_trunc('hour', "timestamp") AS hour, round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency
FROM logs GROUP BY 1""")
def _(spark, sf):
    return rounded(M.latency_p95_by_hour(logs(spark, sf)), "p95_latency")


@register("latency_p95_approx")
def _(spark, sf):
    return M.latency_p95_by_hour_approx(logs(spark, sf))


@register("latency_24h", WITH_LOGS + f"""
SELECT date_trunc('hour', "timestamp") AS hour, round(avg(latency_ms), 6) AS avg_latency_ms,
       round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency_ms
FROM logs WHERE "timestamp" >= {AS_OF} - INTERVAL 24 HOURS GROUP BY 1""")
def _(spark, sf):
    df = logs(spark, sf)
    return rounded(M.latency_last_day(df, L.latest_time(df)), "avg_latency_ms", "p95_latency_ms")


@register("error_rate_endpoint", WITH_LOGS + """
SELECT endpoint_name, round(count(*) FILTER (response LIKE 'Error:%') * 100.0::DOUBLE / count(*), 6) AS error_rate
FROM logs GROUP BY 1""")
def _(spark, sf):
    return rounded(M.error_rate_by_endpoint(logs(spark, sf)), "error_rate")


@register("feedback_daily", WITH_LOGS + f"""
SELECT date_trunc('day', "timestamp")::TIMESTAMP AS day, round(avg(feedback_score), 6) AS avg_feedback,
       round(count(*) FILTER (feedback_score >= 4) * 100.0::DOUBLE / count(*), 6) AS satisfaction_rate
FROM logs WHERE "timestamp" >= {AS_OF} - INTERVAL 7 DAYS AND feedback_score IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    df = logs(spark, sf)
    return rounded(M.feedback_by_day(df, L.latest_time(df)), "avg_feedback", "satisfaction_rate")


@register("top_queries", WITH_LOGS + """
SELECT query, count(*) AS frequency FROM logs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, sf):
    return M.top_queries(logs(spark, sf))


@register("top_queries_7d", WITH_LOGS + f"""
SELECT query, count(*) AS frequency, round(avg(latency_ms), 6) AS avg_latency
FROM logs WHERE "timestamp" >= {AS_OF} - INTERVAL 7 DAYS GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, sf):
    df = logs(spark, sf)
    return rounded(M.top_queries_last_week(df, L.latest_time(df)), "avg_latency")


TYPES = "CASE WHEN response LIKE '%error%' THEN 'Error' WHEN response LIKE '%sorry%' THEN 'Apology' ELSE 'Success' END"


@register("error_analysis", WITH_LOGS + f"""
SELECT {TYPES} AS response_type, count(*) AS count,
       round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percentage
FROM logs WHERE "timestamp" >= {AS_OF} - INTERVAL 24 HOURS GROUP BY 1""")
def _(spark, sf):
    df = logs(spark, sf)
    return rounded(M.response_types(df, L.latest_time(df)), "percentage")


@register("response_type", WITH_LOGS + f"""
SELECT request_id, {TYPES} AS response_type, response LIKE 'Error:%' AS prefixed_error,
       response LIKE '%error%' AS mentions_error FROM logs""")
def _(spark, sf):
    return logs(spark, sf).select(
        "request_id", routing.response_type("response").alias("response_type"),
        routing.is_prefixed_error("response").alias("prefixed_error"),
        routing.mentions_error("response").alias("mentions_error"))


@register("table_count", "SELECT count(*) AS row_count FROM documents")
def _(spark, sf):
    return load(spark, sf, "documents").agg(F.count(F.lit(1)).alias("row_count"))


@register("topic_count", "SELECT source, count(*) AS row_count FROM documents GROUP BY 1")
def _(spark, sf):
    return load(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("row_count"))


@register("latency_today", WITH_LOGS + f"""
SELECT round(avg(latency_ms), 6) AS avg_latency, count(*) AS request_count
FROM logs WHERE "timestamp" >= date_trunc('day', {AS_OF})""")
def _(spark, sf):
    df = logs(spark, sf)
    return rounded(M.latency_today(df, L.latest_time(df)), "avg_latency")


@register("alert_latency", WITH_LOGS + f"""
SELECT round(avg(latency_ms), 6) AS avg_latency, count(*) AS request_count
FROM logs WHERE "timestamp" >= {AS_OF} - INTERVAL 1 HOUR""")
def _(spark, sf):
    df = logs(spark, sf)
    return rounded(dashboards.alerts(df, L.latest_time(df))["high_latency"], "avg_latency")


@register("alert_feedback", WITH_LOGS + f"""
SELECT round(avg(feedback_score), 6) AS avg_feedback, count(*) AS request_count
FROM logs WHERE "timestamp" >= {AS_OF} - INTERVAL 1 HOUR AND feedback_score IS NOT NULL""")
def _(spark, sf):
    df = logs(spark, sf)
    return rounded(dashboards.alerts(df, L.latest_time(df))["low_feedback_score"], "avg_feedback")


@register("alert_error_rate", WITH_LOGS + f"""
SELECT round(count(*) FILTER (response LIKE '%error%') * 100.0::DOUBLE / count(*), 6) AS error_rate
FROM logs WHERE "timestamp" >= {AS_OF} - INTERVAL 1 HOUR""")
def _(spark, sf):
    df = logs(spark, sf)
    return rounded(dashboards.alerts(df, L.latest_time(df))["error_rate"], "error_rate")


@register("monitor_slices", WITH_LOGS + """
SELECT CASE WHEN grouping(environment) = 0 THEN 'environment' WHEN grouping(endpoint_name) = 0 THEN 'endpoint_name'
            WHEN grouping(model_name) = 0 THEN 'model_name' WHEN grouping(date_day) = 0 THEN 'date_day'
            ELSE 'all' END AS slice,
       coalesce(environment, endpoint_name, model_name, date_day, 'all') AS slice_value,
       count(*) AS request_count, round(avg(latency_ms), 6) AS avg_latency,
       round(avg(tokens_output), 6) AS avg_tokens_output, round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency
FROM logs GROUP BY GROUPING SETS ((environment), (endpoint_name), (model_name), (date_day), ())""")
def _(spark, sf):
    return rounded(M.profile_by_slice(logs(spark, sf)), "avg_latency", "avg_tokens_output", "p95_latency")


@register("monitor_granularity", WITH_LOGS + """
SELECT '1 hour' AS granularity, date_trunc('hour', "timestamp") AS window_start, model_version,
       count(*) AS request_count, round(avg(latency_ms), 6) AS avg_latency FROM logs GROUP BY ALL
UNION ALL
SELECT '1 day', date_trunc('day', "timestamp")::TIMESTAMP, model_version, count(*), round(avg(latency_ms), 6)
FROM logs GROUP BY ALL""")
def _(spark, sf):
    return rounded(M.metrics_by_granularity(logs(spark, sf)), "avg_latency")


# The test log never reaches the shipped limits, so the audit runs with one query and eight tokens a minute.
@register("rate_limit_breaches", WITH_LOGS + """
SELECT environment, date_trunc('minute', "timestamp") AS minute, count(*) AS queries,
       sum(tokens_input + tokens_output)::BIGINT AS tokens, count(*) > 1 AS over_queries,
       sum(tokens_input + tokens_output) > 8 AS over_tokens
FROM logs GROUP BY 1, 2 HAVING count(*) > 1 OR sum(tokens_input + tokens_output) > 8""")
def _(spark, sf):
    limits = config.environment_table(spark).select(
        "environment", F.lit(1).alias("max_queries_per_minute"), F.lit(8).alias("max_tokens_per_minute"))
    return M.rate_limit_breaches(logs(spark, sf), limits)


@register("promotion_gate", WITH_LOGS + """,
acc AS (SELECT avg((((d.n_chars >= 200)::INTEGER = l.quality))::INTEGER::DOUBLE) AS accuracy
        FROM labels l JOIN documents d USING (doc_id)),
m AS (SELECT avg(latency_ms) AS avg_latency,
             count(*) FILTER (response LIKE 'Error:%')::DOUBLE / count(*) AS error_rate FROM logs)
SELECT round(avg_latency, 6) AS avg_latency, round(error_rate, 6) AS error_rate, round(accuracy, 6) AS accuracy,
       accuracy >= 0.85 AS accuracy_ok, avg_latency <= 2000 AS latency_ok, error_rate <= 0.05 AS error_rate_ok,
       accuracy >= 0.85 AND avg_latency <= 2000 AND error_rate <= 0.05 AS promote
FROM m, acc""")
def _(spark, sf):
    labelled = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    agree = (F.col("n_chars") >= 200).cast("int") == F.col("quality")
    accuracy = labelled.agg(F.avg(agree.cast("double")).alias("accuracy"))
    return rounded(M.promotion_gate(logs(spark, sf), accuracy), "avg_latency", "error_rate", "accuracy")


# Stand-in flags: a question asked again within the hour counts as cache hit, one about an item
# whose number starts with 9 as blocked, one of more than two words as rewritten.
@register("kpi_summary", WITH_LOGS + """,
flagged AS (SELECT *, coalesce("timestamp" - lag("timestamp") OVER (PARTITION BY query ORDER BY "timestamp", request_id)
                      <= INTERVAL 60 MINUTES, false) AS cache_hit FROM logs)
SELECT count(*) AS request_count, round(avg(latency_ms), 6) AS avg_latency,
  sum(tokens_input)::BIGINT AS tokens_input, sum(tokens_output)::BIGINT AS tokens_output,
  round(count(*) FILTER (response LIKE 'Error:%') * 100.0::DOUBLE / count(*), 6) AS error_rate,
  round(count(*) FILTER (cache_hit) * 100.0::DOUBLE / count(*), 6) AS cache_hit_rate,
  round(count(*) FILTER (k LIKE '9%') * 100.0::DOUBLE / count(*), 6) AS guardrail_rate,
  round(count(*) FILTER (tokens_input > 2) * 100.0::DOUBLE / count(*), 6) AS rewrite_rate,
  round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency, round(quantile_cont(latency_ms, 0.99), 6) AS p99_latency
FROM flagged""")
def _(spark, sf):
    from docquery.operators.sessions import count_repeated

    df = logs(spark, sf)
    flagged = df.withColumns({"blocked": F.col("metadata")["k"].like("9%"), "rewritten": F.col("tokens_input") > 2})
    return rounded(M.kpi_summary(flagged, count_repeated(df, "query", 60)), "avg_latency", "error_rate", "cache_hit_rate", "guardrail_rate",
                   "rewrite_rate", "p95_latency", "p99_latency")


@register("active_users", WITH_LOGS + """
SELECT date_day, count(DISTINCT user_id) AS active_users, count(DISTINCT session_id) AS active_sessions
FROM logs GROUP BY 1""")
def _(spark, sf):
    return M.active_users(logs(spark, sf))


@register("active_users_week", WITH_LOGS + """,
seen AS (SELECT DISTINCT user_id, date_day::DATE AS day FROM logs),
days AS (SELECT DISTINCT day FROM seen)
SELECT day, count(DISTINCT user_id) AS active,
  count(DISTINCT user_id) FILTER (user_id IN (SELECT user_id FROM seen s WHERE s.day = days.day) AND seen.day < days.day) AS returning,
  true AS sketches_agree
FROM days JOIN seen ON seen.day BETWEEN days.day - 6 AND days.day GROUP BY days.day""".replace("SELECT day, count", "SELECT days.day AS day, count"))
def _(spark, sf):
    """Users of the seven days up to each day, in full and by united and intersected sketches."""
    df = logs(spark, sf)
    told = M.active_over(M.user_sketches(df), 7).select("day", F.col("active").alias("a"), F.col("returning").alias("r"))
    near = lambda x, y: F.abs(x - y) <= F.greatest(F.lit(1), 0.05 * F.col("active"))
    return M.active_over_exact(df, 7).join(told, "day").select(
        "day", "active", "returning", (near(F.col("active"), F.col("a")) & near(F.col("returning"), F.col("r"))).alias("sketches_agree"))


@register("retrieval_quality", "WITH " + knn_sql(5) + """,
w AS (SELECT label AS query_id, count(*) AS wanted FROM embeddings GROUP BY 1),
f AS (SELECT query_id, count(*) AS found, min(rank) AS first_rank FROM hits WHERE label = query_id GROUP BY 1)
SELECT count(*) AS questions, round(avg(coalesce(found, 0) / wanted::DOUBLE), 6) AS recall_at_k,
       round(avg(coalesce(found, 0) / 5.0::DOUBLE), 6) AS precision_at_k,
       round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 6) AS mrr
FROM w LEFT JOIN f USING (query_id)""")
def _(spark, sf):
    from docquery.operators.search import top_k

    vectors = load(spark, sf, "embeddings")
    hits = top_k(vectors, questions(spark, sf), 5).withColumnRenamed("vec_id", "doc_id")
    truth = vectors.select(F.col("label").alias("query_id"), F.col("vec_id").alias("doc_id"))
    return rounded(M.retrieval_quality(hits, truth, 5), "recall_at_k", "precision_at_k", "mrr")


@register("canary_compare", WITH_LOGS + """
SELECT CASE WHEN ('0x' || substr(sha256(session_id), 1, 8))::BIGINT % 100 < 10 THEN 'canary' ELSE 'stable' END AS arm,
  count(*) AS request_count, round(avg(latency_ms), 6) AS avg_latency,
  round(count(*) FILTER (response LIKE 'Error:%') * 100.0::DOUBLE / count(*), 6) AS error_rate,
  round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency
FROM logs GROUP BY 1""")
def _(spark, sf):
    return rounded(M.canary_compare(logs(spark, sf)), "avg_latency", "error_rate", "p95_latency")


@register("guard_audit", WITH_LOGS + """
SELECT date_day, violation, count(*) AS interventions FROM (
  SELECT date_day, unnest(list_filter([CASE WHEN contains(query, 'purchase') OR contains(query, 'sign')
     THEN 'Banned topic: commerce' END, CASE WHEN contains(query, 'click') THEN 'Banned topic: tracking' END],
     lambda x: x IS NOT NULL)) AS violation FROM logs) GROUP BY 1, 2""")
def _(spark, sf):
    policy = Policy(topics_by_level={"medium": ["commerce", "tracking"]},
                    keywords={"commerce": ["purchase", "sign"], "tracking": ["click"]})
    df = logs(spark, sf).withColumn("violations", check_input("query", policy)["violations"])
    return audit(df, "date_day", "violations")


@register("sliding_alerts", WITH_LOGS + """,
spread AS (SELECT *, time_bucket(INTERVAL 5 MINUTES, "timestamp") - to_minutes(5 * i) AS window_start
           FROM logs, (SELECT unnest(range(12)) AS i))
SELECT window_start, count(*) AS request_count, round(avg(latency_ms), 9) AS avg_latency,
       round(count(*) FILTER (response LIKE '%error%') * 100.0::DOUBLE / count(*), 6) AS error_rate,
       round(avg(feedback_score), 9) AS avg_feedback
FROM spread GROUP BY 1""")
def _(spark, sf):
    out = rounded(M.sliding_alerts(logs(spark, sf)), "error_rate")
    return out.withColumns({c: F.round(c, 9) for c in ("avg_latency", "avg_feedback")})


# Cache: everything before the last day of the log; requests: that last day.
CACHE = WITH_LOGS + f""",
cut AS (SELECT {AS_OF} - INTERVAL 24 HOURS AS t),
c AS (SELECT sha256(query) AS query_hash, max("timestamp") AS last_accessed FROM logs, cut
      WHERE "timestamp" < t GROUP BY 1),
r AS (SELECT logs.*, sha256(query) AS h FROM logs, cut WHERE "timestamp" >= t)
"""


def _cache_inputs(spark, sf):
    df = logs(spark, sf)
    cut = L.latest_time(df) - F.expr("INTERVAL 24 HOURS")
    return df.where(F.col("timestamp") >= cut), build_cache(df.where(F.col("timestamp") < cut))


@register("cache_build", WITH_LOGS + """
SELECT sha256(query) AS query_hash, query, arg_max(response, "timestamp") AS response,
       min("timestamp") AS created_at, count(*) AS access_count, max("timestamp") AS last_accessed
FROM logs GROUP BY query""")
def _(spark, sf):
    return build_cache(logs(spark, sf))


@register("cache_merge", REGISTRY["cache_build"][1])
def _(spark, sf):
    """The caches of three stretches of the log, merged one after the other."""
    df = logs(spark, sf)
    cuts = [L.latest_time(df) - F.expr(f"INTERVAL {h} HOURS") for h in (240, 24)]
    made = build_cache(df.where(F.col("timestamp") < cuts[0]))
    for part in (df.where((F.col("timestamp") >= cuts[0]) & (F.col("timestamp") < cuts[1])), df.where(F.col("timestamp") >= cuts[1])):
        made = merge_caches(made, build_cache(part))
    return made


@register("cache_hits", CACHE + """
SELECT request_id, query FROM r WHERE EXISTS (SELECT 1 FROM c WHERE c.query_hash = r.h
  AND r."timestamp" - c.last_accessed <= INTERVAL 1440 MINUTES)""")
def _(spark, sf):
    requests, cache = _cache_inputs(spark, sf)
    return cache_hits(requests, cache, 1440).select("request_id", "query")


@register("cache_misses", CACHE + """
SELECT request_id, query FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.query_hash = r.h
  AND r."timestamp" - c.last_accessed <= INTERVAL 60 MINUTES)""")
def _(spark, sf):
    requests, cache = _cache_inputs(spark, sf)
    return cache_misses(requests, cache).select("request_id", "query")


@register("logs_filter", WITH_LOGS + """
SELECT request_id, "timestamp", user_id, date_day FROM logs
WHERE "timestamp" >= '2024-01-05 06:00:00' AND "timestamp" <= '2024-01-20 18:30:00' AND user_id = '8'""")
def _(spark, sf):
    return L.filter_logs(logs(spark, sf), "2024-01-05 06:00:00", "2024-01-20 18:30:00", "8").select(
        "request_id", "timestamp", "user_id", "date_day")


@register("logs_recent", WITH_LOGS + f"""
SELECT span, count(*) AS requests FROM (
  SELECT unnest(list_filter([CASE WHEN "timestamp" >= {AS_OF} - INTERVAL 1 HOUR THEN '1 HOUR' END,
    CASE WHEN "timestamp" >= {AS_OF} - INTERVAL 24 HOURS THEN '24 HOURS' END,
    CASE WHEN "timestamp" >= {AS_OF} - INTERVAL 7 DAYS THEN '7 DAYS' END,
    CASE WHEN "timestamp" >= date_trunc('day', {AS_OF}) THEN 'TODAY' END], lambda x: x IS NOT NULL)) AS span
  FROM logs) GROUP BY 1""")
def _(spark, sf):
    df = logs(spark, sf)
    now = L.latest_time(df)
    parts = [L.since(df, now, s).select(F.lit(s).alias("span")) for s in ("1 HOUR", "24 HOURS", "7 DAYS")]
    parts.append(L.since_midnight(df, now).select(F.lit("TODAY").alias("span")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("span").agg(F.count(F.lit(1)).alias("requests"))


@register("logs_latest", WITH_LOGS + """
SELECT request_id, "timestamp", query, response FROM logs ORDER BY "timestamp" DESC, request_id LIMIT 100""")
def _(spark, sf):
    return L.latest_logs(logs(spark, sf)).select("request_id", "timestamp", "query", "response")


@register("log_defaults", WITH_LOGS + """
SELECT request_id, tokens_input, tokens_output,
       CASE WHEN user_id::BIGINT % 2 = 0 THEN 'system' ELSE user_id END AS user_id,
       CASE WHEN user_id::BIGINT % 5 = 0 THEN 'inference_logger' ELSE NULL END AS metadata_source, date_day FROM logs""")
def _(spark, sf):
    u = F.col("user_id").cast("bigint")
    raw = logs(spark, sf).withColumns({
        "tokens_input": F.lit(None).cast("int"), "tokens_output": F.lit(None).cast("int"),
        "metadata": F.when(u % 5 != 0, F.col("metadata")), "date_day": F.lit(None).cast("string"),
        "user_id": F.when(u % 2 != 0, F.col("user_id"))})
    return L.fill_defaults(raw).select("request_id", "tokens_input", "tokens_output", "user_id",
                                       F.col("metadata")["source"].alias("metadata_source"), "date_day")


@register("env_params", WITH_LOGS + """
SELECT l.request_id, l.environment, e.temperature, e.max_tokens, e.timeout_s, e.max_queries_per_minute
FROM logs l JOIN (VALUES ('dev', 0.7::DOUBLE, 1024, 30, 20), ('qa', 0.5, 2048, 60, 20), ('prod', 0.3, 4096, 120, 100))
  e(environment, temperature, max_tokens, timeout_s, max_queries_per_minute) USING (environment)""")
def _(spark, sf):
    params = config.environment_table(spark).select(
        "environment", "temperature", "max_tokens", "timeout_s", "max_queries_per_minute")
    return logs(spark, sf).join(F.broadcast(params), "environment").select("request_id", *params.columns)

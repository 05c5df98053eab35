"""What can be said in SQL about queries whose values SQL can't compute: keys, counts, states and bounds of every row."""

from pyspark.sql import functions as F, types as T

from docquery.functions.registered import register_functions
from docquery.operators.guardrails import INPUT_MESSAGES, Policy
from docquery.operators.routing import ROUTE_DATA_WORDS, ROUTE_DOCUMENT_WORDS
from docquery.schemas import INFERENCE_LOG

from entries.guard import violations_sql
from entries.metrics import logs
from entries.retrieval import PAIRS, flagship
from entries.tables import REGISTRY, WITH_LOGS, load, register

RUN = {name: fn for name, (fn, _) in REGISTRY.items()}


def contains_sql(column, words):
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


ROUTE = f"""CASE WHEN {contains_sql('query', ROUTE_DOCUMENT_WORDS)} THEN 'RAG'
  WHEN {contains_sql('query', ROUTE_DATA_WORDS)} THEN 'SQL' ELSE 'AGENT' END"""
BLOCKED = f"len({violations_sql(Policy(), 'query', INPUT_MESSAGES)}) > 0"


@register("embed_tfidf_check", f"""
SELECT chunk_id, 512::INTEGER AS dimension, true AS of_unit_length FROM ({REGISTRY["chunk_packed"][1]})""")
def _(spark, sf):
    from docquery.operators.chunking import chunk_documents
    from docquery.operators.embedding import embed_tfidf, fit_tfidf
    from docquery.session import materialise

    chunks = materialise(chunk_documents(load(spark, sf, "documents"), "doc_id", "text"), "chunks")
    made = embed_tfidf(fit_tfidf(chunks), chunks)
    length = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    blank = ~F.lower("content").rlike(r"[\p{L}\p{N}]")
    return made.select("chunk_id", F.size("embedding").alias("dimension"), ((F.abs(length - 1) < 1e-5) | blank).alias("of_unit_length"))


@register("answer_batch_check", f"""
SELECT item_id AS query_id, query, {ROUTE} AS route, CASE WHEN {BLOCKED} THEN 'blocked' ELSE 'success' END AS status,
  NULL::VARCHAR AS error_type, CASE WHEN {BLOCKED} THEN 0 ELSE 1 END::INTEGER AS attempts, true AS answered
FROM (SELECT item_id, text AS query FROM benchmark)""")
def _(spark, sf):
    return RUN["answer_batch"](spark, sf).select(
        "query_id", "query", "route", "status", "error_type", "attempts",
        (F.length("safe_response") > 0).alias("answered"))


@register("answer_session_check", f"""
SELECT conv_id AS query_id, conv_id AS session_id, query, CASE WHEN {BLOCKED} THEN 'blocked' ELSE 'success' END AS status, true AS answered
FROM (SELECT conv_id, arg_max(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY 1)""")
def _(spark, sf):
    return RUN["answer_session"](spark, sf).select(
        "query_id", "session_id", "query", "status", (F.length("safe_response") > 0).alias("answered"))


@register("udf_ask_check", """
SELECT item_id AS query_id, text AS query, 'success' AS status, 'session-1' AS session_id, true AS answered FROM benchmark""")
def _(spark, sf):
    made = RUN["udf_ask"](spark, sf).select("query_id", F.from_json("response", "query string, response string, status string, session_id string").alias("r"))
    return made.select("query_id", "r.query", "r.status", "r.session_id", (F.length("r.response") > 0).alias("answered"))


def word_shares(texts):
    """A stand-in for a hosted embedding model: length, letters e and blanks of a text."""
    return [[float(len(t)), float(t.count("e")), float(t.count(" "))] for t in texts]


@register("udf_embed", """
SELECT doc_id, length(text)::FLOAT AS chars, (length(text) - length(replace(text, 'e', '')))::FLOAT AS letters_e,
  (length(text) - length(replace(text, ' ', '')))::FLOAT AS blanks FROM documents""")
def _(spark, sf):
    """The embedding function called from SQL over all documents."""
    register_functions(spark, load_model=lambda: word_shares)
    load(spark, sf, "documents").createOrReplaceTempView("embed_source")
    return spark.sql("""SELECT doc_id, v[0] AS chars, v[1] AS letters_e, v[2] AS blanks
        FROM (SELECT doc_id, embed_text(text) AS v FROM embed_source)""")


@register("flagship_check", """
SELECT item_id, unnest(range(1, 6))::INTEGER AS rank, true AS answered FROM benchmark""")
def _(spark, sf):
    return flagship(spark, sf).select("item_id", "rank", (F.length("answer") > 0).alias("answered"))


@register("knn_multi_variant_check", """
SELECT item_id AS query_id, unnest(range(1, 6))::INTEGER AS rank, true AS fitting FROM benchmark""")
def _(spark, sf):
    found = RUN["knn_multi_variant"](spark, sf)
    return found.select("query_id", "rank", F.col("score").between(-1.000001, 1.000001).alias("fitting"))


@register("run_report_check", f"""WITH {PAIRS}
SELECT length(query) % 5 > 1 AS success, count(*) AS queries, true AS timed FROM pairs GROUP BY 1""")
def _(spark, sf):
    report = RUN["run_report"](spark, sf)
    return report.select("success", "queries", F.when(F.col("success"), F.col("mean_latency_ms") >= 0).otherwise(
        F.col("mean_latency_ms") == 0).alias("timed"))


LOG_COLUMNS = [f.name for f in (INFERENCE_LOG if isinstance(INFERENCE_LOG, T.StructType) else T.StructType.fromDDL(INFERENCE_LOG))]


@register("catalog_summary_check", """
SELECT 'docquery_checks.orders' AS "table", column_name AS "column", false AS is_partition FROM (DESCRIBE orders)
UNION ALL SELECT 'docquery_checks.log', unnest([{}]), unnest([{}])""".format(
    ", ".join(f"'{c}'" for c in LOG_COLUMNS), ", ".join("true" if c == "date_day" else "false" for c in LOG_COLUMNS)))
def _(spark, sf):
    return RUN["catalog_summary"](spark, sf).drop("type")


@register("latency_p95_approx_check", WITH_LOGS + """
SELECT date_trunc('hour', "timestamp") AS hour, true AS within_a_hundredth FROM logs GROUP BY 1""")
def _(spark, sf):
    """The share of an hour's rows at or below its approximate percentile."""
    told = RUN["latency_p95_approx"](spark, sf)
    rows = logs(spark, sf).select(F.date_trunc("hour", "timestamp").alias("hour"), "latency_ms")
    met = rows.join(told, "hour").groupBy("hour").agg(
        F.count("*").alias("n"), F.count_if(F.col("latency_ms") < F.col("p95_latency")).alias("below"),
        F.count_if(F.col("latency_ms") <= F.col("p95_latency")).alias("upto"))
    rank = F.col("n") * 0.95
    slack = F.greatest(F.col("n") * 0.01, F.lit(1.0))
    return met.select("hour", ((F.col("below") <= rank + slack) & (F.col("upto") >= rank - slack)).alias("within_a_hundredth"))

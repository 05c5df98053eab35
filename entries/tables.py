"""Test tables as the engine's inputs, in both dialects, and the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docquery.functions.text import token_count
from docquery.operators.embedding import group_means

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    """``sql`` is the DuckDB twin; None where SQL cannot express the operator."""

    def keep(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn

    return keep


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def as_log(ev: DataFrame) -> DataFrame:
    """The request log seen in the events table; works on a batch or a stream."""
    k = F.get_json_object("props", "$.k")
    env = F.element_at(F.array(F.lit("dev"), F.lit("qa"), F.lit("prod")), (F.col("user_id") % 3 + 1).cast("int"))
    kind = F.col("event_type")
    base = ev.select(
        F.col("event_id").cast("string").alias("request_id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("show "), kind, F.lit(" item "), k).alias("query"),
        F.when(kind == "error", "Error: backend timeout").when(kind == "signup", "an error was found")
        .when(kind == "view", "sorry, not found").otherwise("ok").alias("response"),
        F.col("value").alias("latency_ms"),
        env.alias("environment"),
        F.concat(F.lit("rag-assistant-"), env).alias("endpoint_name"),
        F.concat(F.lit("model-"), (F.col("user_id") % 4).cast("string")).alias("model_name"),
        F.lit("1").alias("model_version"),
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string")).alias("session_id"),
        F.when(F.col("event_id") % 4 != 0, 1.0 + F.col("event_id") % 5).alias("feedback_score"),
        F.create_map(F.lit("k"), k).alias("metadata"),
        F.date_format("ts", "yyyy-MM-dd").alias("date_day"),
    )
    return base.withColumns({"tokens_input": token_count("query"), "tokens_output": token_count("response")})


def logs(spark: SparkSession, sf: str) -> DataFrame:
    return as_log(events(spark, sf))


LOGS = """logs AS (
  SELECT *, len(string_split(query, ' '))::INTEGER AS tokens_input,
         len(string_split(response, ' '))::INTEGER AS tokens_output
  FROM (SELECT CAST(event_id AS VARCHAR) AS request_id, ts AS "timestamp",
    'show ' || event_type || ' item ' || json_extract_string(props, '$.k') AS query,
    CASE event_type WHEN 'error' THEN 'Error: backend timeout' WHEN 'signup' THEN 'an error was found'
         WHEN 'view' THEN 'sorry, not found' ELSE 'ok' END AS response,
    value AS latency_ms,
    CASE user_id % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'qa' ELSE 'prod' END AS environment,
    'rag-assistant-' || CASE user_id % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'qa' ELSE 'prod' END AS endpoint_name,
    'model-' || (user_id % 4) AS model_name, '1' AS model_version,
    CAST(user_id AS VARCHAR) AS user_id, 's' || (user_id % 50) AS session_id,
    CASE WHEN event_id % 4 <> 0 THEN 1.0::DOUBLE + event_id % 5 END AS feedback_score,
    json_extract_string(props, '$.k') AS k, strftime(ts, '%Y-%m-%d') AS date_day
  FROM events))"""
WITH_LOGS = f"WITH {LOGS}\n"


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """One question vector per label: the mean of its vectors."""
    return group_means(load(spark, sf, "embeddings"), "label")


QUESTIONS = """q AS (
  SELECT label AS query_id, list(a ORDER BY pos) AS query_vector
  FROM (SELECT label, pos, avg(v) AS a
        FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos
              FROM embeddings) GROUP BY label, pos) GROUP BY label)"""


def knn_sql(k: int, metric: str = "cosine") -> str:
    """CTE ``hits`` (query_id, vec_id, score, rank) over all questions and all vectors."""
    fn = {"cosine": "list_cosine_similarity(embedding::DOUBLE[], query_vector)",
          "dot": "list_inner_product(embedding::DOUBLE[], query_vector)",
          "l2": "list_distance(embedding::DOUBLE[], query_vector)"}[metric]
    way = "" if metric == "l2" else "DESC"
    return f"""{QUESTIONS},
scored AS (SELECT query_id, vec_id, label, {fn} AS score FROM embeddings, q),
hits AS (SELECT * FROM (SELECT query_id, vec_id, label, score,
    row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) {way}, vec_id)::INTEGER AS rank
  FROM scored) WHERE rank <= {k})"""

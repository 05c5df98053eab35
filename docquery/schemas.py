"""Declared schemas of the stored tables."""

from pyspark.sql import types as T

DOCUMENT_METADATA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("topics", T.ArrayType(T.StringType())),
        T.StructField("created_at", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("word_count", T.IntegerType()),
    ]
)

DOCUMENT = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "title", "content", "metadata")])

CHUNK = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("chunk_id", "document_id", "title", "content", "metadata")]
)

INFERENCE_LOG = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("query", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("tokens_input", T.IntegerType()),
        T.StructField("tokens_output", T.IntegerType()),
        T.StructField("context_items", T.IntegerType()),
        T.StructField("environment", T.StringType()),
        T.StructField("endpoint_name", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("feedback_score", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("date_day", T.StringType()),
    ]
)

QUERY_CACHE = T.StructType(
    [
        T.StructField("query_hash", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("access_count", T.LongType()),
        T.StructField("last_accessed", T.TimestampType()),
    ]
)

GENERATION = T.StructType(
    [
        T.StructField("response", T.StringType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("prompt_tokens", T.IntegerType()),
        T.StructField("completion_tokens", T.IntegerType()),
        T.StructField("total_tokens", T.IntegerType()),
        T.StructField("model", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
    ]
)

# The row-change table the incremental index reads.
CHANGE_TYPES = ("insert", "update", "delete")

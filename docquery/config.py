"""Settings per environment and the limits the operators default to (fixed values)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ENVIRONMENTS = ("dev", "qa", "prod")

# One row per environment.
ENVIRONMENT_COLUMNS = (
    "environment string, endpoint_name string, temperature double, max_tokens int, top_p double, "
    "frequency_penalty double, presence_penalty double, timeout_s int, search_cache_ttl_s int, "
    "search_cache_size int, answer_cache_enabled boolean, scale_to_zero boolean, min_scale int, "
    "max_scale int, max_queries_per_minute int, max_tokens_per_minute int"
)
ENVIRONMENT_ROWS = [
    ("dev", "rag-assistant-dev", 0.7, 1024, 0.9, 0.0, 0.0, 30, 300, 100, True, True, 1, 2, 20, 20000),
    ("qa", "rag-assistant-qa", 0.5, 2048, 0.9, 0.0, 0.0, 60, 600, 500, True, True, 1, 4, 20, 20000),
    ("prod", "rag-assistant-prod", 0.3, 4096, 0.9, 0.0, 0.0, 120, 1800, 2000, False, False, 2, 8, 100, 100000),
]

# Retrieval and re-ranking.
CHUNK_CHARS = 1000
FUSION_CONSTANT = 60
RERANK_THRESHOLD = 0.5
RERANK_TOP_K = 10
RETRIEVE_K = 5
SHORT_QUERY_WORDS = 2

# Sessions and the answer cache.
SESSION_TIMEOUT_MINUTES = 60
SESSION_HISTORY = 20
SESSION_CAPACITY = 1000
CACHE_TTL_MINUTES = 60

# Retries, promotion gate, canary share.
MAX_RETRIES = 2
GATE_ACCURACY = 0.85
GATE_LATENCY_MS = 2000
GATE_ERROR_RATE = 0.05
CANARY_PERCENT = 10


def environment_table(spark: SparkSession, rows=None) -> DataFrame:
    """Three rows as an inline table: its size is known to the optimizer, which broadcasts it."""
    names = [c.split()[0] for c in ENVIRONMENT_COLUMNS.split(", ")]
    rows = ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in rows or ENVIRONMENT_ROWS)
    table = spark.sql(f"SELECT * FROM VALUES {rows} AS environments({', '.join(names)})")
    types = dict(c.split() for c in ENVIRONMENT_COLUMNS.split(", "))
    return table.select(*[table[n].cast(types[n]).alias(n) for n in names])


def _literal(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    return "'" + value.replace("'", "\\'") + "'" if isinstance(value, str) else f"{value!r}" + ("D" if isinstance(value, float) else "")

"""Named metric sets over the log: what a dashboard or an alert job evaluates."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docquery.operators import metrics


def performance_dashboard(logs: DataFrame) -> dict[str, DataFrame]:
    return {
        "Request Volume Over Time": metrics.requests_per_hour(logs),
        "Average Latency by Model": metrics.latency_by_model(logs),
        "P95 Latency Over Time": metrics.latency_p95_by_hour(logs),
        "Error Rate by Endpoint": metrics.error_rate_by_endpoint(logs),
        "Top 10 Queries": metrics.top_queries(logs),
    }


def recent_dashboard(logs: DataFrame, as_of) -> dict[str, DataFrame]:
    from docquery.operators.logs import since

    return {
        "request_volume": metrics.requests_per_hour(since(logs, as_of, "24 HOURS")),
        "average_latency": metrics.latency_last_day(logs, as_of),
        "feedback_scores": metrics.feedback_by_day(logs, as_of),
        "top_queries": metrics.top_queries_last_week(logs, as_of),
        "error_analysis": metrics.response_types(logs, as_of),
    }


def alerts(logs: DataFrame, as_of) -> dict[str, DataFrame]:
    return {
        "high_latency": metrics.alert_latency(logs, as_of),
        "low_feedback_score": metrics.alert_feedback(logs, as_of),
        "error_rate": metrics.alert_error_rate(logs, as_of),
    }

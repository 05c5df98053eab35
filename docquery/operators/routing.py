"""First-match classifications of questions, responses and errors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
ROUTE_DOCUMENT_WORDS = ["document", "article", "content"]
ROUTE_DATA_WORDS = ["data", "report", "sales", "customer", "product", "order", "revenue"]
ERROR_WORDS = [
    ("MODEL_INFERENCE", ["model inference", "endpoint"]),
    ("RETRIEVAL", ["retriev", "vector", "embedding"]),
    ("DATABASE", ["sql", "database", "query"]),
]


def _any(text: Column, needles: list[str]) -> Column:
    found = text.contains(needles[0])
    for n in needles[1:]:
        found = found | text.contains(n)
    return found


def route(query: str) -> Column:
    """RAG, SQL or AGENT; document words win over data words."""
    text = F.lower(F.col(query))
    return (
        F.when(_any(text, ROUTE_DOCUMENT_WORDS), "RAG").when(_any(text, ROUTE_DATA_WORDS), "SQL").otherwise("AGENT")
    )


def classify_error(message: str) -> Column:
    text = F.lower(F.col(message))
    out = F.when(_any(text, ERROR_WORDS[0][1]), ERROR_WORDS[0][0])
    for name, needles in ERROR_WORDS[1:]:
        out = out.when(_any(text, needles), name)
    return out.otherwise("GENERAL")


def classify_error_text(message: str) -> str:
    """The same rule for a message caught inside a task."""
    lowered = message.lower()
    return next((n for n, needles in ERROR_WORDS if any(w in lowered for w in needles)), "GENERAL")


def response_type(response: str) -> Column:
    text = F.col(response)
    return F.when(text.like("%error%"), "Error").when(text.like("%sorry%"), "Apology").otherwise("Success")


def is_prefixed_error(response: str) -> Column:
    """The per-endpoint error rate counts this form only."""
    return F.col(response).like("Error:%")


def mentions_error(response: str) -> Column:
    """The alert counts this form only; it is case sensitive."""
    return F.col(response).like("%error%")


def or_fixed_message(query: str, answer: Column, message: str = "Please provide a valid query.") -> Column:
    return F.when(F.coalesce(F.col(query), F.lit("")) == "", F.lit(message)).otherwise(answer)

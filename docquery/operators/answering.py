"""Context assembly, prompts, citations and the batch answer provider."""

from __future__ import annotations

import threading
import time
from concurrent.futures import ThreadPoolExecutor
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from docquery.config import MAX_RETRIES
from docquery.operators.routing import classify_error_text
from docquery.schemas import GENERATION

# Prompts.
CHAIN_PROMPT = (
    "You are a helpful AI assistant. Use the following context to answer the question.\n"
    "If you don't know the answer, just say you don't know. Don't try to make up an answer.\n\n"
    "Context:\n{context}\n\nQuestion: {question}\n\nAnswer:"
)
CONTEXT_PROMPT = (
    "Question: {question}\n\nContext:\n{context}\n\n"
    "Please provide a helpful answer based on the context provided."
)
KNOWLEDGE_PROMPT = "user query : {question} and supporting knowledge: {context}"


def gather_ranked(hits: DataFrame, text: Column, separator: str, out: str, keys: list[str] = ["query_id"],
                  rank: str = "rank") -> DataFrame:
    """One ordered text per question. Hit lists are cut to k rows before, so groups are small."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), text.alias("t"))))
    return hits.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["t"]), separator).alias(out))


def context_and_sources(hits: DataFrame, doc_id: str, text: str, title: str | None = None) -> DataFrame:
    """Context and citation list of each question from one pass over its hits."""
    cited = _source_line(doc_id, title)
    listed = F.array_sort(F.collect_list(F.struct(
        F.col("rank").alias("r"), _topic_block(doc_id, text).alias("b"), cited.alias("c"))))
    blocks = F.filter(F.transform("_l", lambda x: x["b"]), lambda b: b.isNotNull())
    return hits.groupBy("query_id").agg(listed.alias("_l")).select(
        "query_id", F.array_join(blocks, "\n").alias("context"),
        F.concat(F.lit("\n\nSources:\n"), F.array_join(F.transform("_l", lambda x: x["c"]), "")).alias("sources"))


def _topic_block(topic: str, description: str) -> Column:
    """NULL when either field is missing."""
    return F.concat(F.lit("Topic: "), F.col(topic).cast("string"), F.lit("\nDescription: "),
                    F.col(description).cast("string"))


def _source_line(doc_id: str, title: str | None) -> Column:
    position = F.concat(F.lit("doc-"), (F.col("rank") - 1).cast("string"))
    named = F.coalesce(F.col(title).cast("string"), F.lit("Untitled")) if title else F.lit("Untitled")
    return F.concat(F.lit("- "), F.coalesce(F.col(doc_id).cast("string"), position), F.lit(": "), named, F.lit("\n"))


def assemble_context(hits: DataFrame, topic: str, description: str, out: str = "context") -> DataFrame:
    """``Topic: ..`` / ``Description: ..`` blocks by rank; hits lacking either field are left out."""
    full = hits.where(F.col(topic).isNotNull() & F.col(description).isNotNull())
    return gather_ranked(full, _topic_block(topic, description), "\n", out)


def render_prompt(template: str, question: Column, context: Column) -> Column:
    """Pieces are joined once; text inside the context that looks like a placeholder stays as it is."""
    parts: list[Column] = []
    rest = template
    while rest:
        spots = [(rest.find("{" + n + "}"), n) for n in ("question", "context") if "{" + n + "}" in rest]
        if not spots:
            parts.append(F.lit(rest))
            break
        at, name = min(spots)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(F.coalesce(question if name == "question" else context, F.lit("")))
        rest = rest[at + len(name) + 2:]
    return F.concat(*parts)


def cite_sources(hits: DataFrame, doc_id: str, title: str, out: str = "sources") -> DataFrame:
    """``\\n\\nSources:\\n- id: title\\n`` per question; a missing id reads doc-<position>, title Untitled."""
    cited = gather_ranked(hits, _source_line(doc_id, title), "", out)
    return cited.withColumn(out, F.concat(F.lit("\n\nSources:\n"), F.col(out)))


class ExtractiveProvider:
    """Offline provider: the context line sharing most words with the question."""

    model = "extractive"

    def generate(self, question: str, context: str) -> str:
        wanted = set((question or "").lower().split())
        lines = [x for x in (context or "").split("\n") if x.strip()]
        if not lines:
            return "I don't know."
        return max(lines, key=lambda x: len(wanted & set(x.lower().split())))


# Texts of failed answers.
APOLOGY = ("I'm sorry, I encountered an error ({kind}). "
           "Please try again or contact support if the issue persists.")
ERROR_LABELS = {"MODEL_INFERENCE": "Model inference error", "RETRIEVAL": "Retrieval error",
                "DATABASE": "Database error", "GENERAL": "General error"}


def _failure(style: str, error: Exception, attempts: int, model: str) -> tuple:
    text, kind = str(error), classify_error_text(str(error))
    response = {"message": text, "prefixed": f"Error: {text}", "apology": APOLOGY.format(kind=kind)}[style]
    detail = f"{ERROR_LABELS[kind]}: {text}" if style == "apology" else text
    return (response, -1.0, 0, 0, 0, model, "error", kind, detail, attempts)


# Requests that a task has under way at once.
IN_FLIGHT = 8


class Pace:
    """At most ``rate`` requests a second, handed out in order; no limit without a rate."""

    def __init__(self, rate: float | None):
        self.gap = 1.0 / rate if rate else 0.0
        self.lock = threading.Lock()
        self.free = time.monotonic()

    def wait(self) -> None:
        if self.gap:
            with self.lock:
                at = max(self.free, time.monotonic())
                self.free = at + self.gap
            time.sleep(max(0.0, at - time.monotonic()))


class BatchClient:
    """A batch of requests put to a provider: some at once, failures again together after the rest.

    Equal requests of a batch are put once. A round that leaves failures is followed by one wait (``wait`` to the power
    of the round) for all of them, so the waits of a batch do not add up over its rows.
    """

    def __init__(self, provider, max_retries: int, wait: float, in_flight: int = IN_FLIGHT, rate: float | None = None):
        self.provider, self.max_retries, self.wait, self.in_flight = provider, max_retries, wait, in_flight
        self.pace = Pace(rate)

    def _ask(self, request: tuple) -> tuple:
        """(text, milliseconds), or the exception."""
        self.pace.wait()
        started = time.perf_counter()
        try:
            return self.provider.generate(*request), round((time.perf_counter() - started) * 1000, 2)
        except Exception as e:
            return e, -1.0

    def answers(self, requests: list[tuple]) -> dict[tuple, tuple]:
        """Request -> (text or exception, milliseconds, attempts)."""
        done: dict[tuple, tuple] = {}
        open_ = list(dict.fromkeys(requests))
        with ThreadPoolExecutor(self.in_flight) as pool:
            for attempt in range(1, self.max_retries + 2):
                told = pool.map(self._ask, open_) if self.in_flight > 1 else map(self._ask, open_)
                for request, (text, spent) in zip(open_, told):
                    done[request] = text, spent, attempt
                open_ = [r for r in open_ if isinstance(done[r][0], Exception)]
                if not open_:
                    break
                if attempt <= self.max_retries and self.wait > 0:
                    time.sleep(self.wait**attempt)
        return done


def generate_answers(df: DataFrame, provider_factory: Callable[[], object], question: str = "query",
                     context: str = "context", max_retries: int = 0, wait: float = 2.0,
                     failure: str = "message", in_flight: int = IN_FLIGHT, rate: float | None = None) -> DataFrame:
    """Appends response, latency_ms, token counts, model, status, error columns and attempts.

    One provider per task, Arrow batches in and out, one output row per input row. A task has at most ``in_flight``
    requests under way (1 for providers that several threads can't call) and starts at most ``rate`` a second. A
    failing row gets latency -1 and no tokens. Failures of a batch are put again together, after one wait of wait**n
    seconds (see ``BatchClient``). ``failure``: message, prefixed or apology.
    """
    schema = T.StructType(df.schema.fields + GENERATION.fields)
    names = GENERATION.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = provider_factory()
        client = BatchClient(provider, max_retries, wait, in_flight, rate)

        def row(request, told) -> tuple:
            text, spent, attempts = told
            if isinstance(text, Exception):
                return _failure(failure, text, attempts, provider.model)
            n_in, n_out = len((request[0] or "").split()), len((text or "").split())
            return (text, spent, n_in, n_out, n_in + n_out, provider.model, "success", None, None, attempts)

        for batch in batches:
            requests = list(zip(batch[question], batch[context]))
            told = client.answers(requests)
            made = pd.DataFrame([row(r, told[r]) for r in requests], columns=names, index=batch.index)
            yield pd.concat([batch, made], axis=1)

    return df.mapInPandas(run, schema)


def generate_with_retry(df: DataFrame, provider_factory, question: str = "query", context: str = "context",
                        max_retries: int = MAX_RETRIES, wait: float = 2.0) -> DataFrame:
    return generate_answers(df, provider_factory, question, context, max_retries, wait, failure="apology")


def run_report(answers: DataFrame) -> DataFrame:
    """Count and mean latency per outcome; a failed row counts with latency 0."""
    ok = F.col("status") == "success"
    return answers.groupBy(ok.alias("success")).agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg(F.when(ok, F.col("latency_ms")).otherwise(0.0)).alias("mean_latency_ms"),
    )

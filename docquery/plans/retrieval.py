"""Corpus -> index -> questions -> answers."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from docquery import config
from docquery.operators import answering, guardrails, rerank, routing, search
from docquery.operators.chunking import chunk_documents
from docquery.operators.embedding import embed_tfidf, fit_tfidf, with_embeddings
from docquery.operators.index import IvfIndex
from docquery.operators.passages import passages_in as passage_truth  # noqa: F401
from docquery.session import materialise, scratch_path, spread

# Questions that one task puts to the provider.
QUESTIONS_PER_TASK = 1_000


@dataclass
class TextIndex:
    """Chunk table with vectors, the model (a fitted pipeline or an ``embedding_udf``) that embeds questions the
    same way, and the cells if any."""

    chunks: DataFrame
    model: PipelineModel | Callable
    cells: IvfIndex | None = None

    def embed_questions(self, questions: DataFrame, query_id: str, query: str) -> DataFrame:
        embed = embed_tfidf if isinstance(self.model, PipelineModel) else embed_plugged
        return embed(self.model, questions, query, "query_vector").withColumnRenamed(query_id, "query_id")

    def search(self, questions: DataFrame, query_id: str, query: str, k: int = config.RETRIEVE_K,
               metric: str = "cosine", nprobe: int | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank) with the chunk's document and text.

        With ``nprobe`` only that many cells per question are read: faster, not exact.
        """
        asked = self.embed_questions(questions.select(query_id, query), query_id, query)
        if nprobe and self.cells is None:
            raise ValueError("the index has no cells")
        if nprobe:
            hits = self.cells.search(self.chunks, asked, k, nprobe, id_col="chunk_id")
        else:
            hits = search.top_k(self.chunks, asked, k, metric, id_col="chunk_id")
        titled = ["title"] if "title" in self.chunks.columns else []
        text = self.chunks.select("chunk_id", "document_id", "content", *titled)
        return search.hits_with_documents(hits, text, "chunk_id")


def embed_plugged(model: Callable, df: DataFrame, text_col: str, out: str) -> DataFrame:
    return with_embeddings(df, model, text_col, out)


def build_text_index(docs: DataFrame, id_col: str, text_col: str, store: bool = True,
                     cells: int | None = None, title_col: str | None = None,
                     embedder: Callable | None = None) -> TextIndex:
    """Chunk once, write the chunks, fit document frequencies, write the vectors.

    Both tables are written because the fit and every search read them again; a lost executor then
    re-reads files instead of re-chunking the corpus. With ``cells`` the vectors are laid out by cell.
    ``title_col`` is carried to the chunks as ``title``, for citations. ``embedder`` (an ``embedding_udf``)
    takes the place of TF-IDF.
    """
    read = [F.col(id_col), F.col(text_col)] + ([F.col(title_col).alias("title")] if title_col else [])
    chunks = chunk_documents(spread(docs.select(*read), id_col), id_col, text_col, ["title"] if title_col else None)
    if store:
        chunks = materialise(chunks, "chunks", compression="zstd")
    model = embedder or fit_tfidf(chunks, "content")
    embedded = (embed_plugged if embedder else embed_tfidf)(model, chunks, "content", "embedding")
    if cells:
        embedded = materialise(embedded, "vectors", compression="zstd")
        ivf = IvfIndex.fit(embedded, cells)
        path = scratch_path(docs.sparkSession, "index")
        ivf.write(embedded, path)
        return TextIndex(docs.sparkSession.read.parquet(path), model, ivf)
    return TextIndex(materialise(embedded, "index", compression="zstd") if store else embedded, model)


def merge_variants(hits: DataFrame, k: int, how: str = "mean") -> DataFrame:
    """Hits of question variants (query_id, doc, score) -> one ranked list per question."""
    from docquery.functions.windows import top_per_key

    merged = rerank.aggregate_scores(hits, how, doc_id="chunk_id")
    return top_per_key(merged, ["query_id"], [F.desc(F.round("score", 9)), F.asc("chunk_id")], k)


def rerank_by_overlap(hits: DataFrame, questions: DataFrame, query: str = "query",
                      threshold_on: str = "relevance") -> DataFrame:
    paired = hits.join(questions.select("query_id", query), "query_id").withColumn(
        "cross_score", rerank.overlap_score(query, "content"))
    return rerank.rerank(paired, "cross_score", "score", threshold_on=threshold_on, doc_id="chunk_id")


def answer_batch(questions: DataFrame, index: TextIndex,
                 provider_factory: Callable[[], object] = answering.ExtractiveProvider,
                 k: int = config.RETRIEVE_K, policy: guardrails.Policy | None = None,
                 prompt_context: str | None = None, hits: DataFrame | None = None,
                 original: str | None = None, template: str | None = None) -> DataFrame:
    """Every question of a frame (query_id, query) gets exactly one row.

    Screen -> retrieve -> re-rank -> context -> generate -> screen the answer. Blocked questions skip
    retrieval and generation. The screened questions are written first: every later step reads the same rows,
    also when ``questions`` comes out of a model. With ``prompt_context`` (a column) earlier conversation
    precedes the context. ``hits`` of an earlier search of the same questions spares the search. Answers are
    screened against the ``original`` question (a column; else the one asked). With ``template`` the provider
    gets that prompt, rendered, in place of the bare context.
    """
    policy = policy or guardrails.Policy()
    screened = materialise(
        questions.withColumn("guardrail_results", guardrails.check_input("query", policy)), "screened")
    safe, blocked = guardrails.split_checked(screened)
    if hits is None:
        hits = index.search(safe, "query_id", "query", k)
    ranked = rerank_by_overlap(hits, safe)
    ready = safe.join(answering.context_and_sources(
        ranked, "document_id", "content", "title" if "title" in ranked.columns else None), "query_id", "left")
    body = F.coalesce(F.col("context"), F.lit(""))
    if prompt_context:
        body = F.concat(F.coalesce(F.col(prompt_context), F.lit("")), body)
    if template:
        body = answering.render_prompt(template, F.col("query"), body)
    # the rows are few bytes, so AQE would otherwise run the provider in one task; tasks grow with the batch, whose size
    # the written table tells without another scan
    cores = ready.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-screened.count() // QUESTIONS_PER_TASK))
    ready = ready.withColumn("context", body).repartition(tasks, "query_id")
    answered = answering.generate_with_retry(ready, provider_factory, wait=2.0)
    # document questions are answered with their sources
    cited = (routing.route("query") == "RAG") & (F.col("status") == "success") & F.col("sources").isNotNull()
    answered = answered.withColumn(
        "response", F.when(cited, F.concat("response", "sources")).otherwise(F.col("response")))
    done = guardrails.apply_guardrails(answered, original or "query", "response", policy).select(
        "query_id", "query", routing.route("query").alias("route"), "status", "response",
        F.col("safe_response"), F.coalesce("sources", F.lit("")).alias("sources"), "latency_ms", "is_safe",
        "error_type", "error_message", "attempts", "prompt_tokens", "completion_tokens")
    none = [F.lit(None).cast(done.schema[c].dataType).alias(c) for c in ("error_type", "error_message")]
    held = blocked.select(
        "query_id", "query", routing.route("query").alias("route"), "status", "response",
        F.col("response").alias("safe_response"), F.lit("").alias("sources"),
        F.lit(0.0).alias("latency_ms"), F.lit(False).alias("is_safe"),
        *none, *[F.lit(0).alias(c) for c in ("attempts", "prompt_tokens", "completion_tokens")])
    return done.unionByName(held)

"""Second-stage scoring and ranking of retrieved rows (query_id, doc_id, ...)."""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from docquery.config import FUSION_CONSTANT, RERANK_THRESHOLD, RERANK_TOP_K
from docquery.functions.text import hash_fraction, words


def overlap_score(query: str | Column, text: str | Column) -> Column:
    """Share of the distinct question words that occur in the text; 0 for an empty question."""
    q, t = (words(F.lower(F.col(c) if isinstance(c, str) else c)) for c in (query, text))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)), F.size(F.array_distinct(q))), F.lit(0.0))


def hashed_score(query_id: str, doc_id: str) -> Column:
    """The repeatable counterpart of a random score in [0.5, 1)."""
    return 0.5 + 0.5 * hash_fraction(query_id, doc_id)


def pair_scorer(score: Callable[[list[str], list[str]], list[float]]):
    """Plug in a model over (question, text) batches.

    When a batch fails its questions are scored one by one, so that only the failing ones get 0.5 and no
    score depends on where a batch ends.
    """

    @F.pandas_udf("double")
    def scored(query: pd.Series, text: pd.Series) -> pd.Series:
        try:
            return pd.Series(score(query.tolist(), text.tolist()), dtype="float64")
        except Exception:
            out = pd.Series(0.5, index=query.index)
            codes = pd.Series(pd.factorize(query)[0], index=query.index)
            for rows in codes.groupby(codes).groups.values():
                try:
                    out[rows] = score(query[rows].tolist(), text[rows].tolist())
                except Exception:
                    continue
            return out

    return scored


def fuse_ranks(hits: DataFrame, first: str, second: str, out: str = "fused_score",
               doc_id: str = "doc_id", constant: int = FUSION_CONSTANT) -> DataFrame:
    """Reciprocal rank fusion of two score columns; ties go to the smaller document key.

    Hit lists hold at most k rows per question, so the windows see small groups.
    """
    ranks = {
        name: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), doc_id))
        for name, score in (("rank_first", first), ("rank_second", second))
    }
    fused = 1.0 / (constant + F.col("rank_first")) + 1.0 / (constant + F.col("rank_second"))
    return hits.withColumns(ranks).withColumn(out, fused.cast("double"))


def keep_relevant(hits: DataFrame, score: str, threshold: float = RERANK_THRESHOLD, top_k: int = RERANK_TOP_K,
                  doc_id: str = "doc_id", threshold_on: str | None = None) -> DataFrame:
    """Drop rows under the threshold, keep the best row if all are under it, cut to ``top_k``.

    A question with one row keeps it unscored. ``threshold_on`` names the column compared with the
    threshold when that is not the ranking score.
    """
    limit_col = threshold_on or score
    by_query = Window.partitionBy("query_id")
    ranked = hits.withColumns({
        "_place": F.row_number().over(by_query.orderBy(F.desc(score), doc_id)),
        "_any": F.max(F.col(limit_col) >= threshold).over(by_query),
        "_size": F.count(F.lit(1)).over(by_query),
    })
    passes = F.lit(threshold <= 0) | (F.col(limit_col) >= threshold) | (~F.col("_any") & (F.col("_place") == 1))
    kept = ranked.where(passes | (F.col("_size") == 1))
    place = F.row_number().over(by_query.orderBy("_place"))
    return (
        kept.withColumn("rank", place).where(F.col("rank") <= top_k)
        .withColumn("relevance_score", F.when(F.col("_size") > 1, F.col(score)))
        .drop("_place", "_any", "_size")
    )


def rerank(hits: DataFrame, cross_score: str, retriever_score: str | None = None, use_fusion: bool = True,
           threshold: float = RERANK_THRESHOLD, top_k: int = RERANK_TOP_K, threshold_on: str = "final",
           doc_id: str = "doc_id") -> DataFrame:
    """Fusion when retriever scores are given, else the pair score; then threshold and cut.

    With ``threshold_on='final'`` the threshold meets the fused score, whose maximum is far below
    0.5, so only the best row survives; 'relevance' compares the pair score instead.
    """
    if threshold_on not in ("final", "relevance"):
        raise ValueError("threshold_on is 'final' or 'relevance'")
    if retriever_score and use_fusion:
        fused = fuse_ranks(hits, retriever_score, cross_score, "final_score", doc_id)
    else:
        fused = hits.withColumn("final_score", F.col(cross_score).cast("double"))
    return keep_relevant(fused, "final_score", threshold, top_k, doc_id,
                         cross_score if threshold_on == "relevance" else None)


def aggregate_scores(scored: DataFrame, how: str = "mean", score: str = "score",
                     doc_id: str = "doc_id") -> DataFrame:
    """One score per (query_id, document) from several scorers or question variants."""
    agg = {"mean": F.avg, "max": F.max, "sum": F.sum}[how]
    return scored.groupBy("query_id", doc_id).agg(agg(score).alias("score"))

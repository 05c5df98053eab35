"""Text -> vector.

The offline model is hashed TF-IDF with unit length, all in pyspark.ml. Another model plugs in as a
pandas UDF from text to array<float> through ``with_embeddings``.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, IDF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

DIMENSION = 512


def _tokens(df: DataFrame, text_col: str) -> DataFrame:
    parts = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+")
    return df.withColumn("_tokens", F.filter(parts, lambda w: w != ""))


def fit_tfidf(df: DataFrame, text_col: str = "content", dimension: int = DIMENSION) -> PipelineModel:
    """One pass: document frequencies are summed tree-wise into a vector of fixed length."""
    stages = [
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dimension),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0),
    ]
    return Pipeline(stages=stages).fit(_tokens(df.select(text_col), text_col))


def embed_tfidf(model: PipelineModel, df: DataFrame, text_col: str = "content", out: str = "embedding") -> DataFrame:
    done = model.transform(_tokens(df, text_col))
    return done.withColumn(out, vector_to_array("_unit", "float32")).drop("_tokens", "_tf", "_tfidf", "_unit")


def embedding_udf(load_model: Callable[[], Callable[[list[str]], list[list[float]]]]):
    """Wrap a model loader: the model is loaded once per Python worker, then fed Arrow batches."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in batches:
            yield pd.Series(list(model(texts.fillna("").tolist())))

    return embed


def with_embeddings(df: DataFrame, udf, text_col: str = "content", out: str = "embedding") -> DataFrame:
    return df.withColumn(out, udf(F.col(text_col)))


def group_means(vectors: DataFrame, group: str, vector_col: str = "embedding") -> DataFrame:
    """Mean vector per group, combined map-side: at most one buffer per group leaves a partition."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    return (
        vectors.select(group, array_to_vector(F.col(vector_col)).alias("_v"))
        .groupBy(group)
        .agg(Summarizer.mean(F.col("_v")).alias("_m"))
        .select(F.col(group).alias("query_id"), vector_to_array("_m").alias("query_vector"))
    )

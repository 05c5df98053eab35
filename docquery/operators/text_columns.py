"""Column projections of the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def project_chunks(docs: DataFrame, id_col: str = "doc_id", title: str = "source", text: str = "text",
                   metadata: tuple[str, ...] = ("lang", "n_chars")) -> DataFrame:
    """Documents in the chunk table's shape: one whole-document chunk each, metadata as JSON."""
    return docs.select(
        F.concat_ws("-chunk-", F.col(id_col).cast("string"), F.lit("0")).alias("chunk_id"),
        F.col(id_col).alias("document_id"), F.col(title).alias("title"), F.col(text).alias("content"),
        F.to_json(F.struct(*metadata)).alias("metadata"))

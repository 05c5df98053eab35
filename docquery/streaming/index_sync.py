"""Keeping the index in step with a changing document folder.

Each batch writes its chunks and the keys it touched under ``batch=<id>``; a repeated batch overwrites its
own folders, so a restart after a lost driver leaves no duplicates. Readers leave out the rows of
superseded (document, batch) pairs, found from the keys alone. ``compact`` folds the batches when
there are many.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from docquery.operators.chunking import chunk_documents
from docquery.operators.embedding import embed_tfidf
from docquery.session import materialise, spread
from docquery.streaming.run import run_available

EPOCH_BITS = 32  # of a batch number, below the epoch


def sync_index(docs: DataFrame, model, path: str, checkpoint: str, id_col: str = "id",
               text_col: str = "content", deleted: str | None = None) -> None:
    """Process the documents that arrived since the last run.

    ``deleted`` names a boolean column; such documents leave the index. The model is fitted
    beforehand, so old and new vectors stay comparable.
    """

    epoch = _epoch(docs.sparkSession, path)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        number = (epoch << EPOCH_BITS) + batch_id + 1
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        chunks = chunk_documents(spread(batch.where(~gone), id_col), id_col, text_col)
        embed_tfidf(model, chunks).write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
        # a document left without any chunk still replaces its older version; the keys, written last, publish the batch
        batch.select(F.col(id_col).cast("string").alias("document_id")).write.mode("overwrite").parquet(
            f"{path}/keys/batch={number}")

    run_available(docs.writeStream.foreachBatch(upsert), checkpoint)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Current chunks: the rows of each document's newest batch, of batches whose keys are written.

    The superseded pairs are written first: none means no join at all, few means Spark sees their size
    and broadcasts them, so the vectors are not shuffled.
    """
    keys = spark.read.parquet(f"{path}/keys")
    published = keys.select("batch").distinct()  # a row for each batch since the last compaction
    rows = spark.read.parquet(f"{path}/chunks").join(published, "batch", "left_semi")
    touched = keys.groupBy("document_id").agg(
        F.max("batch").alias("newest"), F.min("batch").alias("oldest")).where("oldest < newest")
    stale = materialise(
        keys.join(touched, "document_id").where("batch < newest").select("document_id", "batch"), "stale")
    current = rows if stale.isEmpty() else rows.join(stale, ["document_id", "batch"], "left_anti")
    return current.drop("batch")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the current chunks as the first batch of a new folder and epoch.

    Batches synced into the new folder, by an old or a new checkpoint, get higher numbers than the folded one.
    """
    number = (_epoch(spark, path) + 1) << EPOCH_BITS
    current = read_index(spark, path)
    current.write.parquet(f"{target}/chunks/batch={number}")
    current.select("document_id").distinct().write.parquet(f"{target}/keys/batch={number}")


def _epoch(spark: SparkSession, path: str) -> int:
    """How often the index in this folder has been compacted; zero for a new folder."""
    try:
        newest = spark.read.parquet(f"{path}/keys").agg(F.max("batch")).first()[0]
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        newest = None
    return (newest or 0) >> EPOCH_BITS

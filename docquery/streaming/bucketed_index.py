"""An index table in hash buckets: an upsert rewrites the buckets of its documents, a read opens one folder a bucket.

``data/version=<n>/bucket=<b>`` holds whole buckets; ``log/version=<n>`` lists the buckets that a version replaced and
is written last. A bucket's current folder is that of the newest version whose log names it, so a version that stopped
half-way is not read, and running it again overwrites its own folders. Reading joins nothing. Rows that stay are copied
from their bucket's old folder to the new one without an exchange, and vectors are made after the new rows are dealt out.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from docquery.operators.chunking import chunk_documents
from docquery.operators.embedding import embed_tfidf
from docquery.session import materialise, spread
from docquery.streaming.run import run_available

# Files of a bucket (on average) beyond which the rows that stay are dealt out anew, into large files.
MANY_FILES = 32


class BucketedIndex:
    """``key`` names the column that says which rows belong to one document; ``schema`` that of the rows."""

    def __init__(self, spark: SparkSession, path: str, schema, buckets: int = 64, key: str = "document_id"):
        self.spark, self.path, self.schema, self.buckets, self.key = spark, path, schema, buckets, key
        spark.createDataFrame([], "bucket int").write.mode("ignore").parquet(f"{path}/log/version=-1")

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def folders(self, buckets: set[int] | None = None, before: int | None = None) -> list[str]:
        """The current folder of each bucket (of some of them; as it was before a version): a row for each bucket."""
        log = self.spark.read.schema("bucket int, version long").option("basePath", f"{self.path}/log").parquet(f"{self.path}/log")
        log = log if before is None else log.where(F.col("version") < before)
        newest = log.where("bucket IS NOT NULL").groupBy("bucket").agg(F.max("version").alias("version")).collect()
        return [f"{self.path}/data/version={r.version}/bucket={r.bucket}" for r in newest if buckets is None or r.bucket in buckets]

    def read(self) -> DataFrame:
        return self._rows(self.folders())

    def _rows(self, folders: list[str]) -> DataFrame:
        # every listed bucket has a folder, so Spark gets no path that is missing
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def upsert(self, rows: DataFrame, touched: DataFrame, version: int, finish=None) -> None:
        """Replace all rows of the ``touched`` documents (one column) by ``rows``, which are theirs; versions only rise.
        Rows without a key are left out. ``finish`` adds the columns that need not travel (vectors) to the new rows.

        Shuffled are the new rows without those and the keys; of the index only the touched buckets are read, and written
        anew.
        """
        keys = materialise(touched.toDF("_key").where("_key IS NOT NULL").distinct(), "touched")
        # at most as many numbers as there are buckets
        buckets = sorted(r[0] for r in keys.select(self._bucket("_key")).distinct().collect())
        old = self._rows(self.folders(set(buckets), version))
        kept = old.join(keys, F.col(self.key) == F.col("_key"), "left_anti").withColumn("bucket", self._bucket(self.key))
        if len(old.inputFiles()) > MANY_FILES * len(buckets):
            kept = kept.hint("rebalance", "bucket")
        fresh = rows.where(F.col(self.key).isNotNull()).withColumn("bucket", self._bucket(self.key))
        # sorted while the rows are narrow: the writer needs no sort of its own
        fresh = fresh.hint("rebalance", "bucket").sortWithinPartitions("bucket")
        fresh = (finish(fresh) if finish else fresh).select(*kept.columns)
        data = f"{self.path}/data/version={version}"
        for part, mode in ((fresh, "overwrite"), (kept, "append")):
            # a rerun of the version must leave nothing of its first run, whatever the session's overwrite mode
            writer = part.write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "static")
            writer.partitionBy("bucket").parquet(data)
        files = self.spark.read.schema(self.schema).parquet(data).inputFiles() if buckets else []
        filled = {int(f.rpartition("/bucket=")[2].partition("/")[0]) for f in files if "/bucket=" in f}
        for bucket in sorted(set(buckets) - filled):  # a bucket whose documents are all gone
            self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(f"{data}/bucket={bucket}")
        self.spark.createDataFrame([(b,) for b in buckets], "bucket int").coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/log/version={version}")


def chunk_schema(spark: SparkSession, model):
    """Columns and types of embedded chunks."""
    return embed_tfidf(model, chunk_documents(spark.createDataFrame([], "id string, content string"))).schema


def sync_bucketed(docs: DataFrame, model, index: BucketedIndex, checkpoint: str, id_col: str = "id", text_col: str = "content",
                  deleted: str | None = None, first_version: int = 0) -> None:
    """Process the documents that arrived since the last run; ``deleted`` names a boolean column of those that leave.

    A new checkpoint on an old index needs a ``first_version`` above its versions.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        chunks = chunk_documents(spread(batch.where(~gone), id_col), id_col, text_col)
        index.upsert(chunks, batch.select(F.col(id_col).cast("string")), first_version + number, partial(embed_tfidf, model))

    run_available(docs.writeStream.foreachBatch(upsert), checkpoint)

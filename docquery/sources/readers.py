"""Scans. Nothing here counts or collects: loading is lazy."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

logger = logging.getLogger(__name__)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Header CSV; without a schema every column is a string (no inference pass)."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Fails at once with the table name when it does not exist."""
    if not spark.catalog.tableExists(name):
        raise ValueError(f"table not found: {name}")
    return spark.table(name)


def read_path(spark: SparkSession, path: str, file_format: str = "parquet",
              schema: T.StructType | str | None = None, **options) -> DataFrame:
    reader = spark.read.format(file_format).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def read_sql(spark: SparkSession, query: str, args: dict | None = None, **views: DataFrame) -> DataFrame:
    """SQL text over named frames; values are bound as parameters, not spliced."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(query, args=args)


def _existing(spark: SparkSession, paths: list[str]) -> list[str]:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        matches = path.getFileSystem(conf).globStatus(path)
        if matches is None or len(matches) == 0:
            logger.warning("File not found: %s", p)
        else:
            found.append(p)
    return found


EMPTY_TEXT = "id string, title string, content string, metadata struct<source: string, format: string, size_bytes: bigint, created_at: timestamp>"


def read_text_files(spark: SparkSession, paths: str | list[str], file_format: str = "text") -> DataFrame:
    """One row per text file; missing paths and other formats are skipped with a warning."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    found = []
    if file_format.lower() == "text":
        found = _existing(spark, paths)
    else:
        logger.warning("Unsupported file format: %s", file_format)
    if not found:
        return spark.createDataFrame([], EMPTY_TEXT)
    m = F.col("_metadata")
    return spark.read.text(found, wholetext=True).select(
        m["file_name"].alias("id"), m["file_name"].alias("title"), F.col("value").alias("content"),
        F.struct(m["file_path"].alias("source"), F.lit(file_format).alias("format"),
                 m["file_size"].alias("size_bytes"), m["file_modification_time"].alias("created_at")).alias("metadata"),
    )


def rows_to_frame(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    """Driver rows with a declared schema; for configuration-sized data."""
    return spark.createDataFrame(rows, schema)


def parse_metadata(docs: DataFrame, schema: T.StructType, column: str = "metadata",
                   keep: list[str] | None = None) -> DataFrame:
    """Flatten a JSON column; malformed JSON gives NULL fields. The raw column stays."""
    fields = keep or schema.fieldNames()
    parsed = docs.withColumn("_m", F.from_json(column, schema))
    rest = [c for c in docs.columns if c != column and c not in fields]
    return parsed.select(*rest, *[F.col("_m")[f].alias(f) for f in fields], column)


def stamp_ingest(df: DataFrame, key_columns: list[str] | None = None, at=None) -> DataFrame:
    """record_id, created_at, updated_at. With key columns the id is their hash, so a rerun repeats it."""
    rid = F.sha2(F.concat_ws("|", *key_columns), 256) if key_columns else F.uuid()
    now = F.current_timestamp() if at is None else at
    return df.withColumns({"record_id": rid, "created_at": now, "updated_at": now})


def require_rows(df: DataFrame, message: str = "No data found in the source file") -> DataFrame:
    """Raise when there is no row; reads at most one."""
    if df.isEmpty():
        raise ValueError(message)
    return df

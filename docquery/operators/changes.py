"""Row changes between two snapshots, index freshness, and keeping the latest row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docquery.session import materialise


def content_hash(columns: list[str]):
    """NULL and empty text differ: fields are hashed as JSON."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def change_feed(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """insert / update / delete rows. Only key and hash are shuffled, not the content."""
    old = before.select(F.col(key).alias("_old_key"), content_hash(columns).alias("_old"))
    new = after.select(F.col(key).alias("_new_key"), content_hash(columns).alias("_new"))
    joined = old.join(new, F.col("_old_key") == F.col("_new_key"), "full_outer")
    change = (
        F.when(F.col("_old_key").isNull(), "insert").when(F.col("_new_key").isNull(), "delete")
        .when(F.col("_old") != F.col("_new"), "update")
    )
    return joined.select(F.coalesce("_new_key", "_old_key").alias(key), change.alias("change")).where(
        F.col("change").isNotNull())


def not_indexed(source: DataFrame, index: DataFrame, key: str, columns: list[str],
                hash_col: str = "content_hash") -> DataFrame:
    """Source rows missing from the index or indexed with other content.

    Keys and hashes alone meet the index; what is new is written, so that its size is known when the rows are fetched:
    few new rows are looked up in place, and rows that are indexed already never move.
    """
    hashed = source.withColumn("_hash", content_hash(columns))
    known = index.select(F.col(key).alias("_key"), F.col(hash_col).alias("_known"))
    same = lambda other, value: (F.col(key) == F.col(other)) & (F.col("_hash") == F.col(value))
    fresh = materialise(hashed.select(key, "_hash").join(known, same("_key", "_known"), "left_anti").distinct(), "fresh")
    named = fresh.select(F.col(key).alias("_new"), F.col("_hash").alias("_new_hash"))
    return hashed.join(named, F.col(key).eqNullSafe(F.col("_new")) & (F.col("_hash") == F.col("_new_hash")), "left_semi").select(source.columns)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the greatest by ``order``; combined map-side."""
    others = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(df.columns)

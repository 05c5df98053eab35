"""Bounded samples of labelled rows, picked by a hash of the id: the same rows at any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TEAMS = 64


def bounded(df: DataFrame, rows: int, by: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """At most ``rows`` rows (for each value of ``by``): those with the smallest hashes of id and text, one of each.

    Rows that repeat both (or the id alone, where the table has no text) are one, so an id or a text that holds a third
    of the table takes one place. The cut is found on hashes alone and then applied to the table as a filter: texts
    move only once they are in the sample. Null ids and null groups are left out.
    """
    order = F.struct(F.xxhash64(key).alias("id"), (F.xxhash64(text) if text in df.columns else F.lit(0).cast("long")).alias("text"))
    known = df.where(F.col(key).isNotNull())
    # first within teams of input splits: a group's last window then meets at most TEAMS * rows hashes, whatever the
    # splits; a hash's copies share its rank and are dropped between the two
    near = known.where(F.col(by).isNotNull()) if by else known
    near = near.select(order.alias("__o"), (F.col(by) if by else F.lit(0)).alias("__g"), (F.spark_partition_id() % TEAMS).alias("__team"))
    for keys in (["__g", "__team"], ["__g"]):
        near = near.withColumn("__n", F.dense_rank().over(Window.partitionBy(*keys).orderBy("__o"))).where(
            F.col("__n") <= rows).select("__g", "__o").distinct().withColumn("__team", F.lit(0))
    cuts = near.groupBy("__g").agg(F.max("__o").alias("__cut"))
    # one row for each group, as bounded as the groups that a model is made for; the table itself is not shuffled
    own = F.col(by) if by else F.lit(0)
    return (known.withColumn("__o", order).join(F.broadcast(cuts), (own == F.col("__g")) & (F.col("__o") <= F.col("__cut")))
            .dropDuplicates(["__g", "__o"]).drop("__o", "__g", "__cut"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, fold: Column, rows: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``rows`` labelled documents of the fold; texts of others are not moved.

    An id with several labels counts with its largest; texts that share an id are documents each, within the bound.
    """
    picked = bounded(labels.where(fold & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label")), rows)
    # at most `rows` ids and numbers, whatever the tables hold
    return bounded(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), rows)

"""Window helpers that keep a hot key from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Rows ranked 1..k per key.

    The rank filter sits directly on the window, so Spark plans a WindowGroupLimit before the
    exchange and at most k rows per key leave each input partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def lead_split(df: DataFrame, key: str, order: str, columns: list[str], span: int = 4096,
               prefix: str = "next_") -> DataFrame:
    """``lead(column) over (partition by key order by order)`` for an integer order column.

    Each key is cut into ranges of ``span`` order values that are windowed apart; the first row of
    every range is carried to the range before it, so a key holding a third of all rows is spread
    over many tasks.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order) / span))
    head = F.struct(F.col(order).alias("_o"), *[F.col(c) for c in columns])
    heads = ranged.groupBy(key, "_range").agg(F.min(head).alias("_head"))
    following = heads.select(
        F.col(key).alias("_key"), F.col("_range").alias("_r"),
        F.lead("_head").over(Window.partitionBy(key).orderBy("_range")).alias("_following"),
    )
    joined = ranged.join(
        following, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")), "left"
    )
    within = Window.partitionBy(key, "_range").orderBy(order)
    nearest = F.coalesce(F.lead(head).over(within), F.col("_following"))
    out = joined.withColumn("_next", nearest)
    return out.select(*df.columns, *[F.col(f"_next.{c}").alias(prefix + c) for c in columns])

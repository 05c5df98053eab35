"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docquery.session import materialise


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b`` (longs): the root is the smallest node reachable.

    Each round hooks all neighbours of a node onto its smallest one, first the larger neighbours, then the smaller;
    it ends when a round changes nothing (about log of the longest chain). Links are counted and compared by sums on
    the cluster; only those sums reach the driver. Minima are taken map-side first, so a hub is no hot group, and each
    round is written to the shared folder, so a lost executor costs one round at most.
    """
    edges = materialise(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(edges)
    while True:
        large = _star(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), larger=True)
        edges = materialise(_star(large, larger=False), "links")
        last, state = state, _state(edges)
        if state == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    smallest = edges.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    met = edges.join(smallest, "a")
    if larger:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select("b", "m").union(smallest.select("a", "m")).toDF("a", "b")
    return out.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.crc32(
        F.concat_ws(" ", "a", "b").cast("binary")))).first())

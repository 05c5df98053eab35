"""Nearest neighbours by collision counting: sorted single projections, windows around the query, verified candidates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

PROJECTIONS = 32
THRESHOLD = 0.62  # share of the projections in whose windows a vector must lie to be verified
WIDTH = 0.8  # half a window at the first radius, in units of the unit sphere
RATIO = 1.6  # from one radius to the next
BLOCK_VALUES = 1 << 20  # components of the vectors of a block
QUERY_BLOCK = 512


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, not zero."""
    # nothing compares true with a null component; -inf .. inf as text keeps the bound readable
    inf = F.lit(float("inf"))
    good = F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < inf), F.lit(False)))
    return F.coalesce(good & F.exists(vector, lambda v: v != 0), F.lit(False))


class Block:
    """Sorted projections of one block of vectors, lifted so that nearness on the sphere is the inner product.

    A vector x becomes (x / M, sqrt(1 - |x|^2 / M^2)), M the largest norm, a query (q / |q|, 0): then the squared
    distance is 2 - 2 x.q / (M |q|), smallest where the inner product is largest.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float, seed: int = 7):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.axes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, PROJECTIONS))
        scaled = self.vectors / largest
        rest = np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", scaled, scaled)))
        places = np.concatenate([scaled, rest[:, None]], axis=1) @ self.axes
        self.order = np.argsort(places, axis=0, kind="stable").T.astype(np.int32).copy()
        self.sorted = np.take_along_axis(places, self.order.T.astype(np.int64), axis=0).T.copy()
        self.largest = largest

    def search(self, own: int, query: np.ndarray, k: int) -> list[tuple[int, float]]:
        """The k nearest verified vectors but ``own``: (id, inner product), nearest first, ties to the smaller id.

        Virtual rehashing: all windows grow by RATIO around the query until k verified vectors lie inside the
        radius that the windows stand for, or every window holds the whole block.
        """
        n = len(self.ids)
        need = int(np.ceil(THRESHOLD * PROJECTIONS))
        norm = float(np.linalg.norm(query))
        centre = (query / norm) @ self.axes[:-1]
        counts = np.zeros(n, np.int16)
        seen = np.zeros(n, bool)
        low = high = None
        found_at, found = np.zeros(0, np.int64), np.zeros(0)
        half = WIDTH
        while True:
            new_low = np.array([np.searchsorted(s, c - half) for s, c in zip(self.sorted, centre)])
            new_high = np.array([np.searchsorted(s, c + half, "right") for s, c in zip(self.sorted, centre)])
            if low is None:
                parts = [self.order[j, a:b] for j, (a, b) in enumerate(zip(new_low, new_high))]
            else:
                parts = [self.order[j, a:b] for j, (a, b) in enumerate(zip(new_low, low))]
                parts += [self.order[j, a:b] for j, (a, b) in enumerate(zip(high, new_high))]
            counts += np.bincount(np.concatenate(parts), minlength=n).astype(np.int16)
            low, high = new_low, new_high
            fresh = np.flatnonzero((counts >= need) & ~seen)
            seen[fresh] = True
            fresh = fresh[self.ids[fresh] != own]
            found_at = np.concatenate([found_at, fresh])
            found = np.concatenate([found, self.vectors[fresh] @ query])
            if len(found) > k:
                best = np.lexsort((self.ids[found_at], -found))[:k]
                found_at, found = found_at[best], found[best]
            whole = (low == 0).all() and (high == n).all()
            # a vector at this distance lies in a window with the probability that the threshold asks for
            reached = len(found) >= k and 2 - 2 * found[k - 1] / (self.largest * norm) <= (half / REACH) ** 2
            if whole or reached:
                break
            half *= RATIO
        best = np.lexsort((self.ids[found_at], -found))[:k]
        return [(int(self.ids[a]), float(s)) for a, s in zip(found_at[best], found[best])]


# A standard normal value lies within this of zero more often than THRESHOLD asks for, so that nearly every vector
# inside the radius reaches the threshold: the share is 0.72 and its spread over 32 projections 0.08.
REACH = 1.08


def nearest(vectors: DataFrame, asked: Column, k: int = 20, key: str = "vec_id", column: str = "embedding",
            block_values: int = BLOCK_VALUES, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found by inner product (double) for each row with ``asked``.

    Candidates are all rows but those with the query's id; vectors that are null, zero, hold null or non-finite
    components, have no id or another length than most take no part. Fewer candidates than k: all of them. Repeated
    rows are candidates each; a repeated query is asked once. An empty table gives an empty result.

    Blocks of vectors meet blocks of queries, each pair in one task of fixed memory: a task sorts its block's
    projections once and answers its queries; their best k of each block are merged by rank. Two numbers (rows and
    largest norm) reach the driver.
    """
    good = vectors.where(usable(F.col(column)) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"), asked.alias("asked"))
    size = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows, length = size["count"], size.n
    good = good.where(F.size("v") == length)
    sums = good.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("largest"),
                    F.count_if("asked").alias("asked")).first()
    largest = float(np.sqrt(sums.largest))
    blocks = max(1, -(-rows * length // block_values))
    asks = max(1, -(-sums.asked // query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    base = good.select("id", "v", cell(1, blocks).alias("block"), every(asks).alias("ask"))
    queries = (good.where("asked").dropDuplicates(["id"])
               .select("id", "v", every(blocks).alias("block"), cell(2, asks).alias("ask")))

    def answer(key, own, questions):
        import pandas as pd

        columns = {"query_id": [], "vec_id": [], "score": []}
        if len(own) and len(questions):
            block = Block(own.id.to_numpy(), np.stack(own.v.to_list()), largest)
            for q, v in zip(questions.id, questions.v):
                for vec_id, score in block.search(int(q), np.asarray(v), k):
                    columns["query_id"].append(q)
                    columns["vec_id"].append(vec_id)
                    columns["score"].append(score)
        return pd.DataFrame(columns).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = (base.groupBy("block", "ask").cogroup(queries.groupBy("block", "ask"))
             .applyInPandas(answer, "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

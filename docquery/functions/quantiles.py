"""Exact interpolated percentiles that never hold a whole group in one task.

The built-in percentile keeps every distinct value of a group in one buffer. Here a
sketch brackets the wanted ranks, the values outside the bracket collapse to two counters
in the map-side combine, and only the thin slice inside it is ordered. A sketch promises its error
with high probability only: groups whose rank lies outside its bracket get a second pass over all of
their values.

Building the frame runs two jobs: the brackets (a few numbers per group) and the results are written to
the shared folder. The size of the brackets is then a fact the optimizer knows, so it broadcasts them when
they are small and the rows are not shuffled by group; with very many groups it falls back to a shuffled join.

Sketches merge: ``sketch`` over fine cells, ``merged`` over any set of cells (see ``profile_by_slice``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from docquery.session import materialise

SKETCH_ACCURACY = 10_000
# The sketch is off by at most n / accuracy ranks and interpolation reads two neighbours; the bracket is
# four times as wide, enough from n = accuracy on. A smaller group is taken whole.
BRACKET = 4.0 / SKETCH_ACCURACY
# Size of mergeable sketches and half the bracket that goes with it: several times their rank error of about 0.05 %.
MERGEABLE_SIZE = 8_000
MERGEABLE_BRACKET = 0.002


def sketch(value: str) -> Column:
    """A mergeable sketch of a column's non-null values."""
    return F.kll_sketch_agg_double(F.col(value).cast("double"), MERGEABLE_SIZE)


def merged(sketches: str) -> Column:
    return F.kll_merge_agg_double(sketches, MERGEABLE_SIZE)


def sketch_bracket(sketch_column: str, p: float) -> tuple[Column, Column]:
    """Values that the ``p`` quantile lies between, but for a rare failure of the sketch."""
    at = lambda x: F.kll_sketch_get_quantile_double(sketch_column, F.lit(min(max(x, 0.0), 1.0)))
    return at(p - MERGEABLE_BRACKET), at(p + MERGEABLE_BRACKET)


def percentile_exact(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per key with a column per entry of ``probs`` (name -> fraction), interpolated linearly.

    With no keys the result is one row. Groups without a non-null value are absent.
    """
    names = list(probs)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))

    ends = sorted({e for p in probs.values() for e in (max(p - BRACKET, 0.0), min(p + BRACKET, 1.0))})
    summary = rows.groupBy(*keys).agg(
        F.percentile_approx("_v", ends, SKETCH_ACCURACY).alias("_ends"), F.count("_v").alias("_n")
    )

    def bracket(source: Column) -> Column:
        cells = []
        for i, name in enumerate(names):
            p = probs[name]
            lo = ends.index(max(p - BRACKET, 0.0))
            hi = ends.index(min(p + BRACKET, 1.0))
            cells.append(
                F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"),
                         source[lo].alias("lo"), source[hi].alias("hi"))
            )
        return F.array(*cells)

    if keys:
        summary = materialise(summary, "brackets")
        on = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
        joined = rows.alias("r").join(summary.alias("s"), on).select(
            *[F.col(f"r.{k}").alias(k) for k in keys], "_v", "_n", F.explode(bracket(F.col("_ends"))).alias("_b")
        )
    else:
        one = summary.select(F.struct("_ends", "_n").alias("s")).scalar()
        joined = rows.withColumn("_s", one).select(
            "_v", F.col("_s._n").alias("_n"), F.explode(bracket(F.col("_s._ends"))).alias("_b")
        )

    # 0 = below the bracket, 1 = inside, 2 = above; outside values share one row per group.
    large = F.col("_n") > SKETCH_ACCURACY
    side = F.when(large & (F.col("_v") < F.col("_b.lo")), 0).when(large & (F.col("_v") > F.col("_b.hi")), 2).otherwise(1)
    picked = materialise(_picked(joined.select(
        *keys, F.col("_b.i").alias("_i"), F.col("_b.p").alias("_p"), "_n", side.alias("_side"),
        F.when(side == 1, F.col("_v")).alias("_v")), keys), "percentiles")
    missed = picked.where("_q IS NULL").select(*keys, "_i", "_p", "_n")
    if not missed.isEmpty():
        on = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys], F.lit(True))
        whole = rows.alias("r").join(missed.alias("m"), on).select(
            *[F.col(f"r.{k}").alias(k) for k in keys], "_i", "_p", "_n", F.lit(1).alias("_side"), "_v")
        picked = picked.where("_q IS NOT NULL").unionByName(_picked(whole, keys))
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)]
    )


def _picked(sided: DataFrame, keys: list[str]) -> DataFrame:
    """``_q`` for each group and wanted rank: interpolated between its two neighbours, NULL where one lies outside."""
    counted = sided.groupBy(*keys, "_i", "_p", "_n", "_side", "_v").agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*keys, "_i").orderBy("_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_cum", F.sum("_c").over(order))
    return (ranked.groupBy(*keys, "_i", "_p", "_n").agg(*neighbours(F.col("_p"), F.col("_side") == 1))
            .withColumn("_q", interpolated(F.col("_p"))).drop("_a", "_z"))


def neighbours(p: Column, inside: Column) -> tuple[Column, Column]:
    """Aggregates ``_a`` and ``_z`` of rows with ``_v``, ``_c`` and ``_cum`` (rows up to and with it) in groups of ``_n``."""
    position = p * (F.col("_n") - 1)
    covers = lambda r: (F.col("_cum") - F.col("_c") <= r) & (r < F.col("_cum"))
    pick = lambda r: F.max(F.when(covers(r) & inside, F.col("_v")))
    return pick(F.floor(position)).alias("_a"), pick(F.ceil(position)).alias("_z")


def interpolated(p: Column) -> Column:
    position = p * (F.col("_n") - 1)
    return F.col("_a") + (F.col("_z") - F.col("_a")) * (position - F.floor(position))

"""Dashboards, alerts, slices, audits and gates over the request log.

Each is a hash aggregate with a map-side part, so a hot hour, model or user shrinks to one row per
input partition before the exchange. Percentiles go through ``percentile_exact``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from docquery import config
from docquery.functions.quantiles import interpolated, merged, neighbours, percentile_exact, sketch, sketch_bracket
from docquery.functions.text import hash_bits
from docquery.operators.logs import since, since_midnight
from docquery.operators.routing import is_prefixed_error, mentions_error, response_type
from docquery.session import materialise


def _count() -> Column:
    return F.count(F.lit(1))


def percent(part: Column, whole: Column) -> Column:
    """100 x part / whole as double; NULL for an empty whole."""
    return F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double"))


def _hour() -> Column:
    return F.date_trunc("hour", "timestamp")


def requests_per_hour(logs: DataFrame) -> DataFrame:
    return logs.groupBy(_hour().alias("hour")).agg(_count().alias("request_count")).orderBy("hour")


def latency_by_model(logs: DataFrame) -> DataFrame:
    return (logs.groupBy("model_name").agg(F.avg("latency_ms").alias("avg_latency"))
            .orderBy(F.desc("avg_latency"), "model_name"))


def latency_p95_by_hour(logs: DataFrame) -> DataFrame:
    hourly = logs.select(_hour().alias("hour"), "latency_ms")
    return percentile_exact(hourly, ["hour"], "latency_ms", {"p95_latency": 0.95}).orderBy("hour")


def latency_p95_by_hour_approx(logs: DataFrame, accuracy: int = 10_000) -> DataFrame:
    return (logs.groupBy(_hour().alias("hour"))
            .agg(F.percentile_approx("latency_ms", 0.95, accuracy).alias("p95_latency")).orderBy("hour"))


def latency_last_day(logs: DataFrame, as_of) -> DataFrame:
    recent = since(logs, as_of, "24 HOURS").select(_hour().alias("hour"), "latency_ms")
    mean = recent.groupBy("hour").agg(F.avg("latency_ms").alias("avg_latency_ms"))
    p95 = percentile_exact(recent, ["hour"], "latency_ms", {"p95_latency_ms": 0.95})
    return mean.join(p95, "hour", "left").orderBy("hour")


def error_rate_by_endpoint(logs: DataFrame) -> DataFrame:
    return logs.groupBy("endpoint_name").agg(
        percent(F.count_if(is_prefixed_error("response")), _count()).alias("error_rate"))


def feedback_by_day(logs: DataFrame, as_of) -> DataFrame:
    scored = since(logs, as_of, "7 DAYS").where(F.col("feedback_score").isNotNull())
    return (
        scored.groupBy(F.date_trunc("day", "timestamp").alias("day"))
        .agg(F.avg("feedback_score").alias("avg_feedback"),
             percent(F.count_if(F.col("feedback_score") >= 4), _count()).alias("satisfaction_rate"))
        .orderBy("day")
    )


# Items that a frequent-items summary tracks, and how many of them are counted in full.
TRACKED, CANDIDATES = 50_000, 1_000


def top_queries(logs: DataFrame, n: int = 10) -> DataFrame:
    """A top-k report; equal counts are ordered by text. Exact, though only candidates are shuffled by text.

    A mergeable summary over hashes names the candidates; they are counted exactly in a second scan, from which at most
    CANDIDATES rows leave a task. An item that the summary lost is no more frequent than its error, ``rows * 3.5 /
    TRACKED``, one it ranked behind the candidates no more than their last estimate; where the n-th candidate does not
    lie above both, all queries are counted.
    """
    whole = (logs.groupBy("query").agg(_count().alias("frequency")).orderBy(F.desc("frequency"), "query").limit(n))
    key = F.xxhash64("query")
    told = logs.agg(_count().alias("rows"), F.expr(f"approx_top_k(xxhash64(query), {CANDIDATES}, {TRACKED})").alias("top")).first()
    listed = told.top or []
    if len(listed) < n:
        return whole
    # at most CANDIDATES numbers
    chosen = logs.where(key.isin([t["item"] for t in listed]))
    counted = materialise(chosen.groupBy("query").agg(_count().alias("frequency"))
                          .orderBy(F.desc("frequency"), "query").limit(n), "top-queries")
    least = counted.agg(F.min("frequency"), _count()).first()
    behind = listed[-1]["count"] if len(listed) == CANDIDATES else 0
    lost = told["rows"] * 3.5 / TRACKED if len(listed) == CANDIDATES or told["rows"] > TRACKED else 0
    if least[1] == n and least[0] > behind + lost:
        return counted.orderBy(F.desc("frequency"), "query")
    return whole


def top_queries_last_week(logs: DataFrame, as_of, n: int = 10) -> DataFrame:
    return (
        since(logs, as_of, "7 DAYS").groupBy("query")
        .agg(_count().alias("frequency"), F.avg("latency_ms").alias("avg_latency"))
        .orderBy(F.desc("frequency"), "query").limit(n)
    )


def response_types(logs: DataFrame, as_of) -> DataFrame:
    """Counts per kind and share of all. The unpartitioned window sees one row per kind."""
    counted = (since(logs, as_of, "24 HOURS").groupBy(response_type("response").alias("response_type"))
               .agg(_count().alias("count")))
    total = F.sum("count").over(Window.partitionBy())
    return counted.withColumn("percentage", percent(F.col("count"), total))


def latency_today(logs: DataFrame, as_of) -> DataFrame:
    return since_midnight(logs, as_of).agg(F.avg("latency_ms").alias("avg_latency"), _count().alias("request_count"))


def alert_latency(logs: DataFrame, as_of) -> DataFrame:
    return since(logs, as_of, "1 HOUR").agg(F.avg("latency_ms").alias("avg_latency"),
                                            _count().alias("request_count"))


def alert_feedback(logs: DataFrame, as_of) -> DataFrame:
    return since(logs, as_of, "1 HOUR").where(F.col("feedback_score").isNotNull()).agg(
        F.avg("feedback_score").alias("avg_feedback"), _count().alias("request_count"))


def alert_error_rate(logs: DataFrame, as_of) -> DataFrame:
    """NULL when nothing was logged in the hour."""
    return since(logs, as_of, "1 HOUR").agg(
        percent(F.count_if(mentions_error("response")), _count()).alias("error_rate"))


SLICES = ("environment", "endpoint_name", "model_name", "date_day")


def profile_cells(logs: DataFrame, slices=SLICES) -> DataFrame:
    """Sums and a mergeable latency sketch for each combination of the dimensions: what any slice is made of."""
    return logs.groupBy(*slices).agg(
        _count().alias("request_count"), F.sum("latency_ms").alias("latency"), F.count("latency_ms").alias("timed"),
        F.sum("tokens_output").alias("tokens"), F.count("tokens_output").alias("told"), sketch("latency_ms").alias("sketch"))


def profile_by_slice(logs: DataFrame, slices=SLICES, p: float = 0.95) -> DataFrame:
    """Count, mean and p95 latency, mean output tokens: over all rows and per value of each dimension.

    The log is aggregated once to cells; slices are sums and merged sketches of these few rows. For the exact
    percentile each row meets the brackets of its slices and goes on only where it lies inside one; rows below are
    counted by cell. A slice whose rank its bracket misses is done again from all its values.
    """
    cells = materialise(profile_cells(logs, slices), "cells")
    kind = F.coalesce(*[F.when(F.grouping(s) == 0, F.lit(s)) for s in slices], F.lit("all"))
    value = F.coalesce(*[F.when(F.grouping(s) == 0, F.col(s).cast("string")) for s in slices], F.lit("all"))
    sets = lambda df, *aggs: df.groupingSets([[F.col(s)] for s in slices] + [[]], *[F.col(s) for s in slices]).agg(
        kind.alias("slice"), value.alias("slice_value"), *aggs).drop(*slices)
    total = sets(cells, *[F.sum(c).alias(c) for c in ("request_count", "latency", "timed", "tokens", "told")])
    whole = sets(cells.where("timed > 0"), merged("sketch").alias("sketch"), F.sum("timed").alias("_n"))
    low, high = sketch_bracket("sketch", p)
    brackets = materialise(whole.select("slice", "slice_value", "_n", low.alias("lo"), high.alias("hi")), "brackets")

    near = logs.where("latency_ms IS NOT NULL").select(*slices, F.col("latency_ms").cast("double").alias("_v"))
    own = []
    for number, name in enumerate(("all", *slices)):
        side = brackets.where(F.col("slice") == name).select(
            F.col("slice_value").alias(f"_k{number}"), F.struct("slice", "slice_value", "lo", "hi").alias(f"_b{number}"))
        text = F.lit("all") if name == "all" else F.coalesce(F.col(name).cast("string"), F.lit("all"))
        near = near.join(side, text == F.col(f"_k{number}"))
        own.append(F.col(f"_b{number}"))
    below = sets(near.groupBy(*slices).agg(*[F.count_if(F.col("_v") < b["lo"]).alias(f"_u{i}") for i, b in enumerate(own)]),
                 *[F.sum(f"_u{i}").alias(f"_u{i}") for i in range(len(own))])
    names = ("all", *slices)
    below = below.select("slice", "slice_value", F.coalesce(*[
        F.when(F.col("slice") == n, F.col(f"_u{i}")) for i, n in enumerate(names)]).alias("_below"))
    inside = near.select("_v", F.inline(F.filter(F.array(*own), lambda b: (F.col("_v") >= b["lo"]) & (F.col("_v") <= b["hi"]))))
    counted = inside.groupBy("slice", "slice_value", "_v").agg(_count().alias("_c"))
    order = Window.partitionBy("slice", "slice_value").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (counted.withColumn("_at", F.sum("_c").over(order)).join(brackets.select("slice", "slice_value", "_n"), ["slice", "slice_value"])
              .join(below, ["slice", "slice_value"]).withColumn("_cum", F.col("_at") + F.col("_below")))
    picked = materialise(ranked.groupBy("slice", "slice_value", "_n").agg(*neighbours(F.lit(p), F.lit(True))).select(
        "slice", "slice_value", interpolated(F.lit(p)).alias("p95_latency")), "picked").where("p95_latency IS NOT NULL")
    missed = brackets.join(picked, ["slice", "slice_value"], "left_anti").select("slice", "slice_value")
    if not missed.isEmpty():
        every = F.array(*[F.struct(b["slice"].alias("slice"), b["slice_value"].alias("slice_value")) for b in own])
        again = near.select("_v", F.inline(every)).join(missed, ["slice", "slice_value"])
        picked = picked.unionByName(percentile_exact(again, ["slice", "slice_value"], "_v", {"p95_latency": p}))
    return total.join(picked, ["slice", "slice_value"], "left").select(
        "slice", "slice_value", "request_count", F.try_divide("latency", "timed").alias("avg_latency"),
        F.try_divide("tokens", "told").alias("avg_tokens_output"), "p95_latency")


def metrics_by_granularity(logs: DataFrame, widths=("1 hour", "1 day")) -> DataFrame:
    def one(width: str) -> DataFrame:
        return (
            logs.groupBy(F.window("timestamp", width).alias("w"), "model_version")
            .agg(_count().alias("request_count"), F.avg("latency_ms").alias("avg_latency"))
            .select(F.lit(width).alias("granularity"), F.col("w.start").alias("window_start"), "model_version",
                    "request_count", "avg_latency")
        )

    return reduce(DataFrame.unionByName, [one(w) for w in widths])


# Limits of an environment that the table of limits does not list.
DEFAULT_QUERIES_PER_MINUTE, DEFAULT_TOKENS_PER_MINUTE = 20, 20_000


def rate_limit_breaches(logs: DataFrame, limits: DataFrame, default_queries: int = DEFAULT_QUERIES_PER_MINUTE,
                        default_tokens: int = DEFAULT_TOKENS_PER_MINUTE) -> DataFrame:
    """Minutes in which an environment exceeded its query or token limit. ``limits``: one row per
    environment with max_queries_per_minute and max_tokens_per_minute; others have the default limits."""
    per_minute = (
        logs.groupBy("environment", F.window("timestamp", "1 minute").alias("w"))
        .agg(_count().alias("queries"),
             F.sum((F.col("tokens_input") + F.col("tokens_output")).cast("bigint")).alias("tokens"))
        .select("environment", F.col("w.start").alias("minute"), "queries", "tokens")
    )
    over_q = F.col("queries") > F.coalesce("max_queries_per_minute", F.lit(default_queries))
    over_t = F.col("tokens") > F.coalesce("max_tokens_per_minute", F.lit(default_tokens))
    return per_minute.join(limits, "environment", "left").where(over_q | over_t).select(
        "environment", "minute", "queries", "tokens", over_q.alias("over_queries"), over_t.alias("over_tokens"))


def promotion_gate(logs: DataFrame, accuracy: DataFrame, max_latency: float = config.GATE_LATENCY_MS,
                   max_error: float = config.GATE_ERROR_RATE, min_accuracy: float = config.GATE_ACCURACY) -> DataFrame:
    """One row: the three measures and whether each passes. ``accuracy`` is one row, one column."""
    measured = logs.agg(
        F.avg("latency_ms").alias("avg_latency"),
        F.try_divide(F.count_if(is_prefixed_error("response")), _count()).alias("error_rate"),
    ).withColumn("accuracy", accuracy.scalar())
    checks = {
        "accuracy_ok": F.col("accuracy") >= min_accuracy,
        "latency_ok": F.col("avg_latency") <= max_latency,
        "error_rate_ok": F.col("error_rate") <= max_error,
    }
    return measured.withColumns(checks).withColumn(
        "promote", F.col("accuracy_ok") & F.col("latency_ok") & F.col("error_rate_ok"))


def kpi_summary(logs: DataFrame, cache_hits: DataFrame | None = None) -> DataFrame:
    """One row of indicators. ``logs`` also has blocked and rewritten flags, and cache_hit unless ``cache_hits``, a
    frame of one number (see ``sessions.count_repeated``), tells how many rows a cache would have answered.
    """
    share = lambda flag: percent(F.count_if(flag), _count())
    base = logs.agg(
        _count().alias("request_count"), F.avg("latency_ms").alias("avg_latency"),
        F.sum(F.col("tokens_input").cast("bigint")).alias("tokens_input"),
        F.sum(F.col("tokens_output").cast("bigint")).alias("tokens_output"),
        share(is_prefixed_error("response")).alias("error_rate"),
        (percent(cache_hits.scalar(), _count()) if cache_hits is not None else share(F.col("cache_hit"))).alias("cache_hit_rate"),
        share(F.col("blocked")).alias("guardrail_rate"),
        share(F.col("rewritten")).alias("rewrite_rate"),
    )
    tails = percentile_exact(logs, [], "latency_ms", {"p95_latency": 0.95, "p99_latency": 0.99})
    tail = tails.select(F.struct("*")).scalar()
    return base.withColumn("_t", tail).withColumns(
        {c: F.col(f"_t.{c}") for c in ("p95_latency", "p99_latency")}).drop("_t")


def active_users(logs: DataFrame, exact: bool = True) -> DataFrame:
    """Distinct users and sessions per day; the sketch form needs one small buffer per day."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    return logs.groupBy("date_day").agg(distinct("user_id").alias("active_users"),
                                        distinct("session_id").alias("active_sessions"))


# Nominal entries of a distinct-count sketch (log base 2): a standard error of 0.8 %, at most 128 KB a day and column.
SKETCH_BITS = 14


def user_sketches(logs: DataFrame, column: str = "user_id") -> DataFrame:
    """``day, seen``: a theta sketch of each day's users. Sketches unite over any span of days and intersect, so a span
    costs one row a day, whatever the log; kept as a table, a new day is one more row."""
    return logs.groupBy(F.col("date_day").cast("date").alias("day")).agg(F.theta_sketch_agg(column, SKETCH_BITS).alias("seen"))


def active_over(sketches: DataFrame, days: int) -> DataFrame:
    """``day, active, returning``: estimates for each day of the table of the users of the ``days`` days up to it, and of
    those of the day that were seen in the ``days - 1`` before it as well."""
    spans = sketches.select(F.explode(F.sequence("day", F.date_add("day", days - 1))).alias("upto"), "day", "seen")
    earlier = F.when(F.col("day") < F.col("upto"), F.col("seen"))
    united = spans.groupBy("upto").agg(
        F.theta_union_agg("seen", SKETCH_BITS).alias("all"), F.theta_union_agg(earlier, SKETCH_BITS).alias("before"),
        F.count(earlier).alias("days_before"))
    met = united.join(sketches.select(F.col("day").alias("upto"), F.col("seen").alias("own")), "upto")
    again = F.when(F.col("days_before") > 0, F.theta_sketch_estimate(F.theta_intersection("own", "before"))).otherwise(0)
    return met.select(F.col("upto").alias("day"), F.theta_sketch_estimate("all").alias("active"), again.cast("bigint").alias("returning"))


def active_over_exact(logs: DataFrame, days: int, column: str = "user_id") -> DataFrame:
    """The same counted in full: one row for each user, day and span is shuffled."""
    seen = logs.where(F.col(column).isNotNull()).select(F.col(column).alias("who"), F.col("date_day").cast("date").alias("day")).distinct()
    present = seen.select("day").distinct()
    spans = seen.withColumn("upto", F.explode(F.sequence("day", F.date_add("day", days - 1))))
    flags = spans.groupBy("who", "upto").agg(F.max(F.col("day") == F.col("upto")).alias("own"), F.min("day").alias("first"))
    counted = flags.groupBy(F.col("upto").alias("day")).agg(
        _count().alias("active"), F.count_if(F.col("own") & (F.col("first") < F.col("upto"))).alias("returning"))
    return counted.join(present, "day", "left_semi")


def retrieval_quality(hits: DataFrame, truth: DataFrame, k: int, doc_id: str = "doc_id") -> DataFrame:
    """recall@k, precision@k and mean reciprocal rank over the questions in ``truth`` (query_id, doc_id)."""
    relevant = truth.select("query_id", doc_id).distinct()
    wanted = relevant.groupBy("query_id").agg(_count().alias("wanted"))
    found = (
        hits.where(F.col("rank") <= k).join(relevant, ["query_id", doc_id])
        .groupBy("query_id").agg(_count().alias("found"), F.min("rank").alias("first_rank"))
    )
    per_query = wanted.join(found, "query_id", "left").select(
        "query_id", "wanted", F.coalesce("found", F.lit(0)).alias("found"), "first_rank")
    return per_query.agg(
        _count().alias("questions"),
        F.avg(F.col("found") / F.col("wanted")).alias("recall_at_k"),
        F.avg(F.col("found") / F.lit(k)).alias("precision_at_k"),
        F.avg(F.when(F.col("first_rank").isNotNull(), 1.0 / F.col("first_rank")).otherwise(0.0).cast("double"))
        .alias("mrr"),
    )


def canary_arm(session: str = "session_id", share: int = config.CANARY_PERCENT) -> Column:
    """The same session always meets the same arm."""
    return F.when(hash_bits(session) % 100 < share, "canary").otherwise("stable")


def canary_compare(logs: DataFrame, share: int = config.CANARY_PERCENT) -> DataFrame:
    armed = logs.withColumn("arm", canary_arm(share=share))
    base = armed.groupBy("arm").agg(
        _count().alias("request_count"), F.avg("latency_ms").alias("avg_latency"),
        percent(F.count_if(is_prefixed_error("response")), _count()).alias("error_rate"))
    p95 = percentile_exact(armed, ["arm"], "latency_ms", {"p95_latency": 0.95})
    return base.join(p95, "arm", "left")


def sliding_alerts(logs: DataFrame, width: str = "1 hour", step: str = "5 minutes") -> DataFrame:
    """Alert measures per sliding window.

    A row falls into width/step windows, so rows are first summed per step; only those sums are
    spread over the windows.
    """
    ts = F.window("timestamp", step)["start"]
    cells = logs.groupBy(ts.alias("cell")).agg(
        _count().alias("n"), F.sum("latency_ms").alias("lat"), F.count("latency_ms").alias("lat_n"),
        F.count_if(mentions_error("response")).alias("err"),
        F.sum("feedback_score").alias("fb"), F.count("feedback_score").alias("fb_n"))
    return (
        cells.groupBy(F.window("cell", width, step).alias("w"))
        .agg(F.sum("n").alias("request_count"),
             F.try_divide(F.sum("lat"), F.sum("lat_n")).alias("avg_latency"),
             percent(F.sum("err"), F.sum("n")).alias("error_rate"),
             F.try_divide(F.sum("fb"), F.sum("fb_n")).alias("avg_feedback"))
        .select(F.col("w.start").alias("window_start"), "request_count", "avg_latency", "error_rate", "avg_feedback")
    )

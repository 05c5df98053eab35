"""Summaries that merge, against counts in full."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquery.operators import metrics as M, sessions as S


@pytest.mark.parametrize("kind", ["steep", "flat", "few", "ties"])
def test_top_queries_are_exact(spark, kind, monkeypatch):
    """A steep table is settled by its candidates, a flat one needs all counts; both give the same report."""
    monkeypatch.setattr(M, "TRACKED", 256)
    monkeypatch.setattr(M, "CANDIDATES", 32)
    rng = np.random.default_rng(1)
    n = 6000
    drawn = {"steep": rng.zipf(1.5, n), "flat": rng.integers(0, 2000, n), "few": rng.integers(0, 4, n), "ties": np.repeat(np.arange(1500), 4)}[kind]
    texts = [f"q{k}" for k in drawn] + [None] * 900
    log = spark.createDataFrame([(t,) for t in texts], "query string").repartition(7)
    count = Counter(texts)
    want = sorted(count.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))[:10]
    assert [(r.query, r.frequency) for r in M.top_queries(log).collect()] == want
    assert M.top_queries(log.where("false")).collect() == []


def test_user_sketches_over_spans(spark):
    rng = np.random.default_rng(2)
    rows = [(f"u{rng.integers(0, 9000)}", f"2024-03-{d:02d}") for d in (1, 2, 3, 5, 9) for _ in range(4000)] + [(None, "2024-03-01")]
    log = spark.createDataFrame(rows, "user_id string, date_day string").repartition(5)
    exact = {str(r.day): (r.active, r.returning) for r in M.active_over_exact(log, 3).collect()}
    days = {d: {u for u, x in rows if x == d and u} for d in {x for _, x in rows}}
    for day in days:
        at = int(day[-2:])
        before = set().union(*[days.get(f"2024-03-{k:02d}", set()) for k in range(at - 2, at)])
        assert exact[day] == (len(days[day] | before), len(days[day] & before))
    sketches = M.user_sketches(log)
    told = {str(r.day): (r.active, r.returning) for r in M.active_over(sketches, 3).collect()}
    assert told.keys() == exact.keys()
    for day, (active, returning) in exact.items():
        assert abs(told[day][0] - active) <= 0.04 * active and abs(told[day][1] - returning) <= 0.06 * max(active, 1)
    assert M.active_over(sketches.where("false"), 3).collect() == []


def test_repeats_are_counted_narrowly(spark):
    rng = np.random.default_rng(3)
    rows = [(f"q{rng.integers(0, 40)}" if k % 9 else None, int(rng.integers(0, 86400)), f"r{k:05d}") for k in range(2000)]
    log = spark.createDataFrame(rows, "query string, t long, request_id string").withColumn("timestamp", F.timestamp_seconds("t"))
    flagged = S.repeated_within(log, "query", 60, "hit")
    assert S.count_repeated(log, "query", 60).first()[0] == flagged.where("hit").count()
    plan = S.count_repeated(log, "query", 60)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan

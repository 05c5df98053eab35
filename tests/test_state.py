"""Sessions, logs, cache, changes, answers and streams over several batches."""

import json
import os
import sys
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docquery import schemas
from docquery.functions.registered import register_functions
from docquery.operators import answering as A, changes as C, guardrails as G, logs as L, metrics as M, sessions as S
from docquery.operators.chunking import chunk_documents
from docquery.operators.embedding import embed_tfidf, embedding_udf, fit_tfidf, with_embeddings
from docquery.plans import dashboards, retrieval as P
from docquery.plans.ask import ask_batch, log_rows
from docquery.sources import generators, readers, sinks
from docquery.streaming import index_sync, logs as SL, session_state
from docquery.streaming.run import files_as_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not see the tests folder

T0 = datetime(2024, 1, 1)
LOG = "session_id string, timestamp timestamp, request_id string, query string, response string"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def make_logs(spark, spec):
    rows = [(s, at(m), f"r{i:04d}", f"q{i}", f"a{i}") for i, (s, m) in enumerate(spec)]
    return spark.createDataFrame(rows, LOG)


def test_sessionize_edges(spark):
    df = make_logs(spark, [("u", 0), ("u", 59), ("u", 119), ("u", 180), ("v", 59.5), ("v", 60.5), ("v", 120.5), ("v", 200)])
    got = sorted((r.session_id, r.session_no, r.requests) for r in S.sessionize(df, "session_id").collect())
    # a pause of exactly 60 minutes does not end a session, a longer one does
    assert got == [("u", 1, 3), ("u", 2, 1), ("v", 1, 3), ("v", 2, 1)]


def test_expiry_is_strict_and_eviction_is_complete(spark):
    df = make_logs(spark, [("a", 0), ("b", 10), ("c", 10), ("d", 60)])
    records = S.session_records(df.withColumn("user_id", F.lit(None).cast("string")))
    assert {r.session_id for r in S.expired_sessions(records, at(60)).collect()} == set()
    assert {r.session_id for r in S.expired_sessions(records, at(60.1)).collect()} == {"a"}
    assert {r.user_id for r in records.collect()} == {"anonymous"}
    for cap in (1, 2, 3, 4, 9):
        kept, gone = S.evict_sessions(records, cap)
        k, g = {r.session_id for r in kept.collect()}, {r.session_id for r in gone.collect()}
        assert k | g == {"a", "b", "c", "d"} and not k & g and len(k) == min(cap, 4)
    assert {r.session_id for r in S.evict_sessions(records, 2)[0].collect()} == {"d", "b"}


@pytest.mark.parametrize("items,expect", [(None, 20), (0, 20), (2, 2), (50, 20)])
def test_context_limits(spark, items, expect):
    df = make_logs(spark, [("s", m) for m in range(25)])
    text = S.conversation_context(df, "session_id", ["timestamp", "request_id"], "query", "response", items).first().context
    assert text == "Previous conversation:\n" + "".join(f"User: q{i}\nAssistant: a{i}\n" for i in range(25 - expect, 25))


def test_context_of_structured_and_missing_history(spark):
    df = make_logs(spark, [("s", 0)]).withColumn("response", F.lit(None).cast("string"))
    ctx = S.conversation_context(df, "session_id", ["timestamp"], "query", "response")
    out = {r.session_id: r.context for r in S.context_for(
        spark.createDataFrame([("s",), ("t",)], "session_id string"), ctx, "session_id").collect()}
    assert out == {"s": "Previous conversation:\nUser: q0\nAssistant: [Complex response]\n", "t": ""}


def test_repeated_within(spark):
    spec = [("s", 0), ("s", 59), ("s", 119), ("s", 179.5), ("s", 300)]
    df = make_logs(spark, spec).withColumn("query", F.lit("same"))
    got = [r.hit for r in S.repeated_within(df, "query", 60, "hit").orderBy("timestamp").collect()]
    assert got == [False, True, True, False, False]


def test_empty_windows(spark):
    df = make_logs(spark, [("s", 0)]).withColumns({"latency_ms": F.lit(1.0), "feedback_score": F.lit(None).cast("double")})
    later = at(600)
    assert M.alert_error_rate(df, later).first().error_rate is None
    row = M.alert_latency(df, later).first()
    assert (row.avg_latency, row.request_count) == (None, 0)


def test_dashboards_name_every_chart(spark, sf):
    from entries.tables import logs

    df = logs(spark, sf)
    now = L.latest_time(df)
    assert len(dashboards.performance_dashboard(df)) == 5 and len(dashboards.recent_dashboard(df, now)) == 5
    assert all(x.count() > 0 for x in dashboards.recent_dashboard(df, now).values())
    assert set(dashboards.alerts(df, now)) == {"high_latency", "low_feedback_score", "error_rate"}


def test_log_table_prunes_days(spark, sf, tmp_path):
    from entries.tables import logs

    path = str(tmp_path / "log")
    sinks.append_log(logs(spark, sf), path)
    stored = sinks.read_log(spark, path)
    assert stored.schema == schemas.INFERENCE_LOG
    plan = L.filter_logs(stored, "2024-01-05 10:00:00", "2024-01-06 11:00:00")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date_day" in plan
    recent = L.since(stored, L.latest_time(stored), "24 HOURS")
    scans = recent._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1:]
    assert any("date_day" in s.split("PushedFilters")[0] for s in scans)
    df = logs(spark, sf)
    assert recent.count() == L.since(df, L.latest_time(df), "24 HOURS").count()


def test_change_feed_and_freshness(spark):
    a = spark.createDataFrame([(1, "x", "m"), (2, "y", "m"), (3, None, "m")], "id int, t string, m string")
    b = spark.createDataFrame([(2, "y2", "m"), (3, "", "m"), (4, "n", "m")], "id int, t string, m string")
    assert {(r.id, r.change) for r in C.change_feed(a, b, "id", ["t", "m"]).collect()} == {
        (1, "delete"), (2, "update"), (3, "update"), (4, "insert")}
    index = a.select("id", C.content_hash(["t", "m"]).alias("content_hash"))
    assert {r.id for r in C.not_indexed(b, index, "id", ["t", "m"]).collect()} == {2, 3, 4}
    assert C.not_indexed(a, index, "id", ["t", "m"]).count() == 0


class Broken(A.ExtractiveProvider):
    def generate(self, question, context):
        raise RuntimeError("endpoint down")


@pytest.mark.parametrize("style,text", [("message", "endpoint down"), ("prefixed", "Error: endpoint down"), (
    "apology", "I'm sorry, I encountered an error (MODEL_INFERENCE). Please try again or contact support if the issue persists.")])
def test_failed_answers(spark, style, text):
    df = spark.createDataFrame([(1, "q", "c"), (2, "p", None)], "id int, query string, context string")
    rows = A.generate_answers(df, Broken, max_retries=2, wait=0, failure=style).collect()
    assert len(rows) == 2
    for r in rows:
        assert (r.response, r.latency_ms, r.total_tokens, r.status, r.error_type, r.attempts) == (
            text, -1.0, 0, "error", "MODEL_INFERENCE", 3)


def test_context_leaves_out_incomplete_hits(spark):
    df = spark.createDataFrame([("q", 1, "t1", "d1"), ("q", 2, None, "d2"), ("q", 3, "t3", "d3")],
                               "query_id string, rank int, topic string, description string")
    want = "Topic: t1\nDescription: d1\nTopic: t3\nDescription: d3"
    assert A.assemble_context(df, "topic", "description").first().context == want
    both = A.context_and_sources(df, "topic", "description").first()
    assert both.context == want and both.sources == "\n\nSources:\n- t1: Untitled\n- doc-1: Untitled\n- t3: Untitled\n"


def test_prompt_keeps_braces_of_the_context(spark):
    df = spark.createDataFrame([("Q", "has {question}")], "q string, c string")
    out = df.select(A.render_prompt(A.KNOWLEDGE_PROMPT, F.col("q"), F.col("c")).alias("p")).first().p
    assert out == "user query : Q and supporting knowledge: has {question}"


def test_index_tables_are_written_small(spark):
    """Chunk and vector tables are packed by zstd, whatever the session's default."""
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(k, f"text number {k}\nand a line") for k in range(20)], "id int, content string")
    for file in P.build_text_index(docs, "id", "content").chunks.inputFiles():
        meta = pq.ParquetFile(file.removeprefix("file://")).metadata
        assert {meta.row_group(g).column(c).compression for g in range(meta.num_row_groups) for c in range(meta.num_columns)} <= {"ZSTD"}


def test_answer_batch_gives_one_row_per_question(spark):
    docs = spark.createDataFrame([(1, "Spark runs jobs.\nIt is fast."), (2, "Cats sleep all day.")], "id int, content string")
    index = P.build_text_index(docs, "id", "content")
    asked = spark.createDataFrame([("a", "what do cats do all day"), ("b", "how to hack it"), ("c", ""),
                                   ("d", "the document on cats sleep")], "query_id string, query string")
    rows = {r.query_id: r for r in P.answer_batch(asked, index).collect()}
    assert set(rows) == {"a", "b", "c", "d"}
    assert rows["d"].route == "RAG" and rows["d"].safe_response.endswith("\n\nSources:\n- 2: Untitled\n")
    assert rows["a"].safe_response == "Description: Cats sleep all day." and "- 2: Untitled" in rows["a"].sources
    assert rows["b"].status == "blocked" and rows["c"].status == "success"


def test_text_index_with_cells(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} common text number{i}") for i in range(60)] + [(99, "...")], "id int, content string")
    index = P.build_text_index(docs, "id", "content", cells=4)
    assert index.chunks.count() == 61
    asked = spark.createDataFrame([(1, "number17 word3"), (2, "number40 word5")], "query_id int, query string")
    every = index.search(asked, "query_id", "query", 3, nprobe=4)
    exact = index.search(asked, "query_id", "query", 3)
    key = lambda df: {(r.query_id, r.chunk_id, r.rank) for r in df.collect()}
    assert key(every) == key(exact)
    assert {r.document_id for r in index.search(asked, "query_id", "query", 1, nprobe=2).collect()} == {"17", "40"}


def test_requests_through_the_whole_path(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Spark runs jobs."), (2, "Cats sleep all day.")], "id int, content string")
    index = P.build_text_index(docs, "id", "content")
    history = make_logs(spark, [("s1", 0), ("s1", 1)])
    requests = spark.createDataFrame(
        [(1, "s1", "WHAT DO CATS DO"), (2, "nobody", "hi there"), (3, "s1", "how to hack this"), (4, "s1", "Two words")],
        "query_id int, session_id string, query string")
    out = ask_batch(requests, history, index, lambda c, _: F.lower(c), records=history.selectExpr("session_id", "timestamp AS last_active"))
    rows = {r.query_id: r for r in out.collect()}
    assert len(rows) == 4
    assert (rows[1].status, rows[1].effective_query, rows[1].rewritten) == ("success", "what do cats do", True)
    assert (rows[2].status, rows[2].error) == ("error", "SESSION_NOT_FOUND")
    assert (rows[3].status, rows[3].safe_response) == ("blocked", G.BLOCKED_ANSWER)
    assert (rows[4].effective_query, rows[4].rewritten) == ("Two words", False)
    stored = log_rows(out, "dev", "e", "m", F.lit(T0))
    assert stored.schema.fieldNames() == schemas.INFERENCE_LOG.fieldNames()
    sinks.append_log(stored, str(tmp_path / "log"))
    assert sinks.read_log(spark, str(tmp_path / "log")).where("date_day = '2024-01-01'").count() == 4


def test_tfidf_vectors_have_unit_length(spark):
    df = spark.createDataFrame([("Cats, cats AND dogs!",), ("dogs only",), ("birds fly",), ("",)], "content string")
    vectors = [r.embedding for r in embed_tfidf(fit_tfidf(df), df).collect()]
    assert [round(sum(x * x for x in v), 4) for v in vectors] == [1.0, 1.0, 1.0, 0.0]
    assert {len(v) for v in vectors} == {512}


def test_plugged_in_embedding(spark):
    df = with_embeddings(spark.createDataFrame([("ab",), (None,)], "content string"),
                         embedding_udf(lambda: (lambda texts: [[float(len(t)), 1.0] for t in texts])))
    assert [r.embedding for r in df.collect()] == [[2.0, 1.0], [0.0, 1.0]]


def test_text_index_with_a_plugged_in_embedding(spark):
    docs = spark.createDataFrame([(1, "aaa"), (2, "abb"), (3, "bbb")], "id int, content string")
    count = embedding_udf(lambda: (lambda texts: [[float(t.count("a")), float(t.count("b"))] for t in texts]))
    asked = spark.createDataFrame([("q", "bab"), ("r", "aa")], "query_id string, query string")
    hits = P.build_text_index(docs, "id", "content", embedder=count).search(asked, "query_id", "query", 1)
    assert {(r.query_id, r.document_id) for r in hits.collect()} == {("q", "2"), ("r", "1")}


def test_functions_from_sql(spark):
    register_functions(spark, load_model=lambda: (lambda texts: [[float(len(t))] for t in texts]))
    row = spark.sql("SELECT embed_text('abc') AS v, ask('which line', 's', 'a line\nwhich line is it') AS a").first()
    assert row.v == [3.0]
    assert json.loads(row.a) == {"query": "which line", "response": "which line is it", "status": "success", "session_id": "s"}
    pieces = spark.sql("SELECT * FROM split_text('ab\n\ncdefg', 'paragraph', 2)").collect()
    assert [(r.position, r.chunk) for r in pieces] == [(0, "ab"), (1, "cd"), (2, "ef"), (3, "g")]


def test_passage_truth_against_brute_force(spark):
    docs = spark.createDataFrame([(1, "xone two three four fivey"), (2, "two three"), (3, "one two\nthree four"), (4, "")], "d int, t string")
    passages = spark.createDataFrame([("p", "one two three four five"), ("q", "two three four"), ("r", "one two\nthree"), ("s", "two three fo")], "p string, t string")
    want = {(p.p, d.d) for p in passages.collect() for d in docs.collect() if p.t in d.t}
    assert {(r.query_id, r.doc_id) for r in P.passage_truth(docs, passages, "d", "t", "p", "t").collect()} == want


def test_passage_truth_with_short_passages(spark):
    docs = spark.createDataFrame([(1, "two three"), (2, "xtwo threex four"), (3, "Zwölf\u4e2d\u6587\u5b57"), (4, ""), (5, None)], "d int, t string")
    passages = spark.createDataFrame([("a", "two three"), ("b", "o"), ("c", ""), ("d", None), ("e", "\u4e2d\u6587"), ("f", "two three four"),
                                      ("g", "absent words"), ("h", " ")], "p string, t string")
    want = {(p.p, d.d) for p in passages.collect() for d in docs.collect() if None not in (p.t, d.t) and p.t in d.t}
    assert {(r.query_id, r.doc_id) for r in P.passage_truth(docs, passages, "d", "t", "p", "t").collect()} == want
    assert P.passage_truth(docs, passages.limit(0), "d", "t", "p", "t").count() == 0


def test_passages_over_several_files(spark, monkeypatch):
    """Passages with common beginnings, more files than one, repeated passages and documents, hits of any length."""
    import random

    from docquery.operators import passages as automata

    monkeypatch.setattr(automata, "SLICE", 7)
    monkeypatch.setattr(automata, "ANCHOR", 5)
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("ab \n") for _ in range(n))
    docs = spark.createDataFrame([(k % 25, text(rng.randint(0, 60))) for k in range(40)], "d int, t string").repartition(3)
    passages = spark.createDataFrame([(f"p{k % 50}", text(rng.randint(1, 9))) for k in range(60)] + [("e", ""), ("n", None)], "p string, t string")
    want = {(p.p, d.d) for p in passages.collect() for d in docs.collect() if p.t is not None and p.t in d.t}
    found = automata.passages_in(docs, passages, "d", "t", "p", "t")
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_batch_client_waits_once_a_round():
    import threading
    import time

    from docquery.operators.answering import BatchClient

    class Busy:
        def __init__(self):
            self.calls, self.now, self.most, self.lock = {}, 0, 0, threading.Lock()

        def generate(self, question, context):
            with self.lock:
                n = self.calls[question] = self.calls.get(question, 0) + 1
                self.now += 1
                self.most = max(self.most, self.now)
            time.sleep(0.001)
            with self.lock:
                self.now -= 1
            number = int(question[1:])
            if number % 20 == 0 and n <= 1 + number % 40 // 20 or question == "q7":
                raise RuntimeError("busy")
            return question.upper()

    busy = Busy()
    requests = [(f"q{k}", "c") for k in range(1000)] + [("q3", "c")] * 5
    started = time.monotonic()
    told = BatchClient(busy, 2, 0.5, in_flight=6).answers(requests)
    assert time.monotonic() - started < 5  # fifty rows fail once or twice: two waits in all
    assert 1 < busy.most <= 6 and busy.calls["q3"] == 1
    assert told[("q1", "c")][0] == "Q1" and told[("q1", "c")][2] == 1
    assert {told[(f"q{k}", "c")][2] for k in range(0, 1000, 40)} == {2} and {told[(f"q{k}", "c")][2] for k in range(20, 1000, 40)} == {3}
    assert isinstance(told[("q7", "c")][0], RuntimeError) and told[("q7", "c")][2] == 3
    started = time.monotonic()
    BatchClient(Busy(), 0, 0, rate=50).answers([(f"q{k}", "c") for k in range(1, 11)])
    assert time.monotonic() - started >= 0.17


def test_session_path_rewrites_once_and_screens_the_original(spark, tmp_path):
    from docquery.operators.rewrite import rewriter_udf

    docs = spark.createDataFrame([(1, "Spark runs jobs.", "On Spark"), (2, "Cats sleep all day.", None)], "id int, content string, title string")
    index = P.build_text_index(docs, "id", "content", title_col="title")
    history = make_logs(spark, [("s1", 0), ("s2", 100)])
    requests = spark.createDataFrame(
        [(1, "s1", "my ssn 123-45-6789 what do cats do"), (2, "new", "the document on spark jobs"), (3, "s2", "please fail this one"),
         (4, "s2", "what do cats do"), (5, "s2", None), (6, None, "no session at all")], "query_id int, session_id string, query string")
    calls = tmp_path / "calls"

    def model(query, context):
        with open(calls, "a") as f:
            f.write(f"{query}|{len(context)}\n")
        if "fail" in query:
            raise ValueError("model down")
        return query.replace("123-45-6789", "")

    udf = rewriter_udf(model)
    out = ask_batch(requests, history, index, lambda q, c: udf(q, c))
    rows = {r.query_id: r for r in out.collect()}
    assert sorted(x.split("|")[0] for x in calls.read_text().splitlines()) == sorted(
        ["my ssn 123-45-6789 what do cats do", "the document on spark jobs", "please fail this one", "what do cats do"])
    assert rows[1].status == "success" and "sleep" in rows[1].response and "sleep" not in rows[1].safe_response
    assert rows[2].status == "success" and rows[2].sources.startswith("\n\nSources:\n- 1: On Spark\n")
    assert (rows[3].rewritten, rows[3].effective_query, rows[3].rewrite_error) == (False, "please fail this one", "model down")
    assert rows[4].rewritten and rows[5].status == "success" and rows[6].error == "SESSION_NOT_FOUND"
    records = history.selectExpr("session_id", "timestamp AS last_active")
    late = ask_batch(requests, history, index, records=records, as_of=at(100.5))
    assert {r.query_id: r.error for r in late.collect() if r.error} == {k: "SESSION_NOT_FOUND" for k in (1, 2, 6)}


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line one\nline two", encoding="utf-8")
    row = readers.read_text_files(spark, [str(tmp_path / "a.txt"), str(tmp_path / "absent.txt")]).collect()
    assert len(row) == 1 and row[0].id == row[0].title == "a.txt" and row[0].content == "line one\nline two"
    assert row[0].metadata.size_bytes == 17 and row[0].metadata.format == "text"
    assert readers.read_text_files(spark, str(tmp_path / "a.txt"), "pdf").count() == 0


def test_loud_failures(spark):
    with pytest.raises(ValueError, match="table not found"):
        readers.read_table(spark, "no_such_table")
    with pytest.raises(ValueError, match="No data found"):
        readers.require_rows(spark.range(0))


def test_generated_rows_are_in_range(spark):
    docs = generators.generate_documents(spark.range(200), "id", seed=3)
    parsed = readers.parse_metadata(docs, schemas.DOCUMENT_METADATA, keep=["topics", "source", "word_count"])
    for r in parsed.collect():
        paragraphs = r.content.split("\n\n")
        assert 1 <= len(set(r.topics)) == len(r.topics) <= 3 and 3 <= len(paragraphs) <= 7
        assert r.word_count == len(r.content.split()) and r.source == "synthetic"
        assert all(3 <= p.count("This is a synthetic") <= 9 for p in paragraphs)
    orders = generators.generate_orders(spark.range(300), "id", 10, 5).collect()
    assert {o.quantity for o in orders} == set(range(1, 10))
    assert {o.customer_id for o in orders} == {f"CUST{i:04d}" for i in range(10)}


def test_index_sync_over_batches(spark, tmp_path):
    src, path, ckpt = (str(tmp_path / x) for x in ("src", "index", "ckpt"))
    schema = "id string, content string, gone boolean"
    model = fit_tfidf(spark.createDataFrame([("a b c",), ("d e",)], "content string"))

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        index_sync.sync_index(files_as_stream(spark, src, schema), model, path, ckpt, deleted="gone")
        return {r.document_id: r.content for r in index_sync.read_index(spark, path).collect()}

    assert arrive([("1", "one", None), ("2", "two", None)]) == {"1": "one", "2": "two"}
    assert arrive([("2", "two again", None), ("3", "three", None)]) == {"1": "one", "2": "two again", "3": "three"}
    assert arrive([("1", "one", True), ("3", "", None)]) == {"2": "two again"}
    folded = str(tmp_path / "folded")
    index_sync.compact(spark, path, folded)
    assert {r.content for r in index_sync.read_index(spark, folded).collect()} == {"two again"}
    # a new checkpoint on the folded index counts its batches from zero again and must lose nothing
    later = str(tmp_path / "later")
    spark.createDataFrame([("4", "four", None)], schema).write.parquet(later)
    index_sync.sync_index(files_as_stream(spark, later, schema), model, folded, str(tmp_path / "ckpt2"), deleted="gone")
    assert {r.content for r in index_sync.read_index(spark, folded).collect()} == {"two again", "four"}
    # chunks whose keys are not written yet are not read
    rows = spark.read.parquet(f"{folded}/chunks").where("document_id = '4'").drop("batch")
    rows.write.parquet(f"{folded}/chunks/batch={(1 << 32) + 9}")
    assert index_sync.read_index(spark, folded).count() == 2
    index_sync.compact(spark, folded, str(tmp_path / "again"))
    assert {r.content for r in index_sync.read_index(spark, str(tmp_path / "again")).collect()} == {"two again", "four"}


@pytest.mark.parametrize("many", [32, 0])
def test_bucketed_index_moves_neither_old_rows_nor_vectors(spark, tmp_path, monkeypatch, many):
    """Vectors are made after new rows are dealt out, rows that stay are copied in place; beyond MANY_FILES they are dealt
    out anew. The rows are the same."""
    from docquery.streaming import bucketed_index

    monkeypatch.setattr(bucketed_index, "MANY_FILES", many)
    model = fit_tfidf(spark.createDataFrame([("a b c",), ("d e",)], "content string"))
    index = bucketed_index.BucketedIndex(spark, str(tmp_path / "index"), bucketed_index.chunk_schema(spark, model), 2)
    chunks = lambda rows: chunk_documents(spark.createDataFrame(rows, "id string, content string"))
    hinted, finished = [], []
    frame = type(index.read())
    hint = frame.hint
    monkeypatch.setattr(frame, "hint", lambda self, *a: hinted.append(set(self.columns)) or hint(self, *a))

    def finish(rows):
        finished.append("RebalancePartitions" in rows._jdf.queryExecution().optimizedPlan().toString())
        return embed_tfidf(model, rows)

    texts = {str(k): f"a text {k}" for k in range(12)}
    for version, ids in enumerate([range(12), range(0, 12, 2), range(0, 12, 3)]):
        texts |= {str(k): f"version {version} of {k}" for k in ids}
        new = [(str(k), texts[str(k)]) for k in ids]
        index.upsert(chunks(new), spark.createDataFrame([(i,) for i, _ in new], "id string"), version, finish)
    assert {r.document_id: r.content for r in index.read().collect()} == texts
    assert index.read().count() == 12 and all(len(r.embedding) == 512 for r in index.read().collect())
    wide = [c for c in hinted if "embedding" in c]
    assert finished == [True] * 3 and len(hinted) - len(wide) == 3 and len(wide) == (2 if many == 0 else 0)


def test_bucketed_index(spark, tmp_path, monkeypatch):
    """Upserts, deletions, documents left without chunks, a version that stops before its log, and its second run."""
    from docquery.streaming import bucketed_index

    src, path, ckpt = (str(tmp_path / x) for x in ("src", "index", "ckpt"))
    schema = "id string, content string, gone boolean"
    model = fit_tfidf(spark.createDataFrame([("a b c",), ("d e",)], "content string"))
    index = bucketed_index.BucketedIndex(spark, path, bucketed_index.chunk_schema(spark, model), 4)
    now = lambda: {r.document_id: r.content for r in index.read().collect()}

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        bucketed_index.sync_bucketed(files_as_stream(spark, src, schema), model, index, ckpt, deleted="gone")
        return now()

    assert now() == {}
    assert arrive([(str(k), f"text {k}", None) for k in range(9)]) == {str(k): f"text {k}" for k in range(9)}
    folders = set(index.folders())
    assert arrive([("2", "two again", None)])["2"] == "two again"
    assert len(folders & set(index.folders())) == len(folders) - 1  # one bucket was written anew
    want = arrive([("1", "one", True), ("3", "", None), (None, "no id", None)])
    assert want == {**{str(k): f"text {k}" for k in range(9) if k not in (1, 2, 3)}, "2": "two again"}
    assert "Join" not in index.read()._jdf.queryExecution().executedPlan().toString()

    # a crash between data and log: the old rows stay; the same version run again replaces them
    chunks = embed_tfidf(model, chunk_documents(spark.createDataFrame([("5", "five again")], "id string, content string")))
    keys = spark.createDataFrame([("5",), ("6",)], "id string")
    class Stop(Exception):
        pass

    before = spark.createDataFrame
    def fail(data, schema=None, *a, **k):
        if schema == "bucket int":
            raise Stop()
        return before(data, schema, *a, **k)
    monkeypatch.setattr(spark, "createDataFrame", fail)
    with pytest.raises(Stop):
        index.upsert(chunks, keys, 50)
    monkeypatch.setattr(spark, "createDataFrame", before)
    assert now() == want
    index.upsert(chunks, keys, 50)
    assert now() == {k: v for k, v in want.items() if k not in "56"} | {"5": "five again"}
    index.upsert(chunks.where("false"), before([(k,) for k in want], "id string"), 51)
    assert now() == {}


def test_unlisted_environment_has_default_limits(spark):
    rows = [("new", at(0), 1, 1)] * 21 + [("dev", at(0), 1, 1)] * 21 + [("few", at(0), 1, 1)] * 20
    log = spark.createDataFrame(rows, "environment string, timestamp timestamp, tokens_input int, tokens_output int")
    limits = spark.createDataFrame([("dev", 50, 10_000)], "environment string, max_queries_per_minute int, max_tokens_per_minute int")
    got = M.rate_limit_breaches(log, limits).collect()
    assert [(r.environment, r.queries, r.over_queries, r.over_tokens) for r in got] == [("new", 21, True, False)]


def test_session_state_over_batches(spark, tmp_path):
    src, path, ckpt = (str(tmp_path / x) for x in ("src", "history", "ckpt"))

    def arrive(spec, first):
        rows = [(s, at(m), f"r{first + i:04d}", f"q{first + i}", "a") for i, (s, m) in enumerate(spec)]
        spark.createDataFrame(rows, LOG).repartition(3).write.mode("append").parquet(src)
        stream = files_as_stream(spark, src, spark.createDataFrame([], LOG).schema)
        session_state.track_history(stream, path, ckpt, keep=3)
        out = {}
        for r in session_state.read_history(spark, path, 3).orderBy("session_id", "timestamp").collect():
            out.setdefault(r.session_id, []).append(r.query)
        return out

    assert arrive([("s", m) for m in range(5)] + [("t", 4)], 0) == {"s": ["q2", "q3", "q4"], "t": ["q5"]}
    assert arrive([("s", 10)], 10) == {"s": ["q3", "q4", "q10"], "t": ["q5"]}
    # t pauses for more than an hour, then returns with a new history
    assert arrive([("t", 100), ("s", 60)], 20) == {"s": ["q4", "q10", "q21"], "t": ["q20"]}
    # state ends with the session: an hour after its last row nothing of it is held, its last snapshot stays readable
    assert arrive([("u", 500)], 30)["u"] == ["q30"]
    held = lambda: spark.read.format("statestore").option("path", ckpt).option("stateVarName", "history").load()
    arrive([("u", 501)], 40)
    assert {r.key.session_id for r in held().select("key").collect()} == {"u"}
    # merged snapshots read alike, and an unnamed base is not read
    before = sorted(session_state.read_history(spark, path, 3).collect())
    session_state.merge_history(spark, path)
    assert sorted(session_state.read_history(spark, path, 3).collect()) == before
    spark.createDataFrame([], session_state.SNAPSHOT).write.parquet(f"{path}/base=99")  # a merge that stopped half-way
    assert sorted(session_state.read_history(spark, path, 3).collect()) == before
    assert arrive([("u", 502)], 50)["u"] == ["q30", "q40", "q50"]


def test_late_rows_are_dropped(spark, tmp_path):
    src, path, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    schema = "timestamp timestamp, latency_ms double, response string, model_version string"

    def arrive(minutes):
        spark.createDataFrame([(at(m), 1.0, "ok", "1") for m in minutes], schema).coalesce(1).write.mode("append").parquet(src)
        SL.write_append(SL.tumbling_metrics(files_as_stream(spark, src, schema)), path, ckpt)
        return {r.window_start: r.request_count for r in spark.read.parquet(path).collect()} if os.path.exists(path) else {}

    assert arrive([5, 50, 65]) == {}
    assert arrive([55, 75]) == {at(0): 3}  # 55 is within ten minutes of 65; the hour closes at 70
    assert arrive([10, 140]) == {at(0): 3, at(60): 2}  # 10 comes after its hour was closed

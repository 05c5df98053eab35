"""Chunking, embedding, search, ranking, context and answers."""

from pyspark.sql import functions as F

from docquery import config
from docquery.functions.text import token_count
from docquery.functions.windows import top_per_key
from docquery.operators import answering as A, rerank as R, rewrite, search
from docquery.operators.chunking import chunk_documents
from docquery.operators.embedding import embed_tfidf, fit_tfidf
from docquery.operators.guardrails import INPUT_MESSAGES, Policy
from docquery.operators.index import CompressedIndex, HyperplaneIndex, IvfIndex, check_dimension
from docquery.plans import retrieval as P
from docquery.plans.ask import ask_batch, log_rows
from docquery.session import materialise, scratch_path
from docquery.sources.sinks import append_log, read_log

from entries.guard import PAIRS, docs, pairs, violations_sql
from entries.tables import knn_sql, load, questions, register

LIMIT = config.CHUNK_CHARS
PIECES = f"""pieces AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY a, b)::INTEGER - 1 AS position, piece
  FROM (SELECT doc_id, source, a, b, substr(p, b, {LIMIT}) AS piece
        FROM (SELECT doc_id, source, a, p, unnest(range(1, greatest(length(p), 1) + 1, {LIMIT})) AS b
              FROM (SELECT doc_id, source, unnest(string_split_regex(text, '\\n+')) AS p,
                           generate_subscripts(string_split_regex(text, '\\n+'), 1) AS a FROM documents) WHERE p <> '')))"""


@register("chunk_paragraphs", f"""WITH {PIECES}
SELECT doc_id || '-chunk-' || position AS chunk_id, doc_id::VARCHAR AS document_id, position, piece AS content, source FROM pieces""")
def _(spark, sf):
    return chunk_documents(docs(spark, sf), "doc_id", "text", ["source"], packed=False)


@register("chunk_packed", f"""WITH RECURSIVE {PIECES},
walk AS (SELECT doc_id, position, length(piece) AS open_len, 0 AS chunk FROM pieces WHERE position = 0
  UNION ALL
  SELECT p.doc_id, p.position, CASE WHEN w.open_len + 1 + length(p.piece) <= {LIMIT} THEN w.open_len + 1 + length(p.piece)
     ELSE length(p.piece) END, CASE WHEN w.open_len + 1 + length(p.piece) <= {LIMIT} THEN w.chunk ELSE w.chunk + 1 END
  FROM walk w JOIN pieces p ON p.doc_id = w.doc_id AND p.position = w.position + 1)
SELECT w.doc_id || '-chunk-' || chunk AS chunk_id, w.doc_id::VARCHAR AS document_id, chunk::INTEGER AS position,
  string_agg(piece, chr(10) ORDER BY w.position) AS content
FROM walk w JOIN pieces p ON p.doc_id = w.doc_id AND p.position = w.position GROUP BY w.doc_id, chunk""")
def _(spark, sf):
    return chunk_documents(docs(spark, sf), "doc_id", "text")


@register("token_count", r"""
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+'), lambda x: x <> ''))::INTEGER AS tokens
FROM documents""")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", token_count("text").alias("tokens"))


def _knn(k, metric="cosine"):
    def run(spark, sf):
        hits = search.top_k(load(spark, sf, "embeddings"), questions(spark, sf), k, metric)
        return hits.withColumn("score", F.round("score", 6))

    return run


for _k in (1, 3, 5):
    register(f"knn_exact_k{_k}", f"WITH {knn_sql(_k)} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM hits")(_knn(_k))
for _m in ("l2", "dot"):
    register(f"knn_{_m}", f"WITH {knn_sql(5, _m)} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM hits")(_knn(5, _m))


@register("knn_left", f"""WITH {knn_sql(5)}
SELECT q.query_id, coalesce(h.vec_id, -1) AS vec_id, round(h.score, 6) AS score, coalesce(h.rank, 0)::INTEGER AS rank
FROM q LEFT JOIN (SELECT * FROM hits WHERE score >= 0.4) h USING (query_id)""")
def _(spark, sf):
    asked = questions(spark, sf)
    hits = search.top_k(load(spark, sf, "embeddings"), asked, 5).where("score >= 0.4")
    kept = search.keep_unanswered(asked, hits)
    return kept.select("query_id", F.coalesce("vec_id", F.lit(-1)).alias("vec_id"), F.round("score", 6).alias("score"),
                       F.coalesce("rank", F.lit(0)).alias("rank"))


@register("hits_with_docs", f"""WITH {knn_sql(5)}
SELECT h.query_id, h.rank, h.vec_id AS doc_id, d.source, d.lang FROM hits h JOIN documents d ON d.doc_id = h.vec_id""")
def _(spark, sf):
    hits = search.top_k(load(spark, sf, "embeddings"), questions(spark, sf), 5).withColumnRenamed("vec_id", "doc_id")
    docs = load(spark, sf, "documents").select("doc_id", "source", "lang")
    return search.hits_with_documents(hits, docs, "doc_id").select("query_id", "rank", "doc_id", "source", "lang")


def ivf(spark, sf, asked, work=None):
    """Index table laid out by cell, then a probe of eight of sixteen cells per question."""
    vectors = load(spark, sf, "embeddings")
    index = IvfIndex.fit(vectors, 16)
    path = scratch_path(spark, "ivf")
    index.write(vectors, path)
    return index.search(spark.read.parquet(path), asked, 5, nprobe=8, work=work)


def lsh(spark, sf, asked, work=None):
    """Index table with band keys; vectors sharing a band with a question are compared."""
    index = HyperplaneIndex(64, bands=24, bits=6)
    path = scratch_path(spark, "lsh")
    index.write(load(spark, sf, "embeddings"), path)
    return index.search(spark.read.parquet(path), asked, 5, work=work)


def pq(spark, sf, asked, work=None):
    """Codes of sixteen bytes a vector; the best hundred by codes are scored exactly."""
    vectors = load(spark, sf, "embeddings")
    index = CompressedIndex.fit(vectors, 16)
    path = scratch_path(spark, "codes")
    index.write(vectors, path)
    return index.search(spark.read.parquet(path), vectors, asked, 5, work=work)


for _name, _find in (("ivf", ivf), ("lsh", lsh), ("pq", pq)):
    register(f"knn_{_name}")(lambda spark, sf, find=_find: find(spark, sf, questions(spark, sf)))


def reworded(spark, sf):
    """Every twentieth vector as a question, moved a little by hashes of its id and component: its own vector and what
    lies around it are to be found."""
    shift = lambda x, i: x + (F.pmod(F.xxhash64("vec_id", i), F.lit(1000)) / 1000 - 0.5) * 0.1
    return load(spark, sf, "embeddings").where("vec_id % 20 = 0").select(
        F.col("vec_id").alias("query_id"), F.transform(F.col("embedding").cast("array<double>"), shift).alias("query_vector"))


# What each index is held to: every question has five hits, its own vector first.
for _name, _find in (("ivf", ivf), ("lsh", lsh), ("pq", pq)):

    @register(f"knn_{_name}_flags", """
SELECT vec_id AS query_id, 5::BIGINT AS hits, true AS own_first FROM embeddings WHERE vec_id % 20 = 0""")
    def _(spark, sf, find=_find):
        hits = find(spark, sf, materialise(reworded(spark, sf), "asked"))
        return hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.bool_or(
            (F.col("rank") == 1) & (F.col("vec_id") == F.col("query_id"))).alias("own_first"))


@register("index_build", """
SELECT (SELECT count(*) FROM embeddings) AS vectors, true AS cells_fit, 64::INTEGER AS dimension, true AS nearest""")
def _(spark, sf):
    vectors = check_dimension(load(spark, sf, "embeddings"), 64)
    index = IvfIndex.fit(vectors, 16)
    path = scratch_path(spark, "ivf")
    index.write(vectors, path)
    stored = index.probes(spark.read.parquet(path).withColumn("query_vector", F.col("embedding").cast("array<double>")), 1)
    return stored.agg(F.count("*").alias("vectors"), F.bool_and(F.col("cell").between(0, 15)).alias("cells_fit"),
                      F.max(F.size("embedding")).alias("dimension"),
                      # each vector lies in the cell that a question of the same place probes first
                      F.bool_and(F.element_at("query_cells", 1) == F.col("cell")).alias("nearest"))


# Second-stage scores are hashes of the pair, the repeatable form of a random scorer.
PAIR_SCORE = """0.5::DOUBLE + 0.5::DOUBLE * (('0x' || substr(sha256(query_id || '|' || vec_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"""
SCORED = f"""{knn_sql(50)},
s AS (SELECT query_id, vec_id AS doc_id, round(score, 9) AS score, {PAIR_SCORE} AS cross_score FROM hits),
f AS (SELECT *, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))
   + 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY cross_score DESC, doc_id)) AS fused FROM s)"""


def scored_hits(spark, sf):
    hits = search.top_k(load(spark, sf, "embeddings"), questions(spark, sf), 50)
    return hits.select("query_id", F.col("vec_id").alias("doc_id"), "score",
                       R.hashed_score("query_id", "vec_id").alias("cross_score"))


@register("rrf_fuse", f"WITH {SCORED} SELECT query_id, doc_id, round(fused, 9) AS fused_score FROM f")
def _(spark, sf):
    fused = R.fuse_ranks(scored_hits(spark, sf), "score", "cross_score")
    return fused.select("query_id", "doc_id", F.round("fused_score", 9).alias("fused_score"))


def rerank_sql(order: str, limit: str, threshold: float, top: int) -> str:
    return f"""WITH {SCORED},
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order} DESC, doc_id) AS place,
   bool_or({limit} >= {threshold}) OVER (PARTITION BY query_id) AS passes FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place)::INTEGER AS rank FROM p
   WHERE {limit} >= {threshold} OR (NOT passes AND place = 1))
SELECT query_id, doc_id, rank, round({order}, 9) AS relevance_score FROM k WHERE rank <= {top}"""


def reranked(df):
    return df.select("query_id", "doc_id", "rank", F.round("relevance_score", 9).alias("relevance_score"))


@register("rerank_threshold", rerank_sql("cross_score", "cross_score", 0.75, 10))
def _(spark, sf):
    return reranked(R.rerank(scored_hits(spark, sf), "cross_score", threshold=0.75))


@register("rerank_faithful_rrf", rerank_sql("fused", "fused", 0.5, 10))
def _(spark, sf):
    return reranked(R.rerank(scored_hits(spark, sf), "cross_score", "score"))


@register("rerank_relevance_rrf", rerank_sql("fused", "cross_score", 0.75, 10))
def _(spark, sf):
    return reranked(R.rerank(scored_hits(spark, sf), "cross_score", "score", threshold=0.75, threshold_on="relevance"))


@register("score_aggregate", f"""WITH {SCORED}
SELECT query_id, doc_id, round(avg(v), 9) AS mean_score, round(max(v), 9) AS max_score, round(sum(v), 9) AS sum_score
FROM (SELECT query_id, doc_id, unnest([score, cross_score]) AS v FROM s) GROUP BY 1, 2""")
def _(spark, sf):
    both = scored_hits(spark, sf).select("query_id", "doc_id", F.explode(F.array("score", "cross_score")).alias("score"))
    out = None
    for how in ("mean", "max", "sum"):
        one = R.aggregate_scores(both, how).withColumn(f"{how}_score", F.round("score", 9)).drop("score")
        out = one if out is None else out.join(one, ["query_id", "doc_id"])
    return out


WORDS = "list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> '')"


@register("pair_score_overlap", f"""WITH {PAIRS}
SELECT conv_id, turn, round(len(list_intersect(q, t))::DOUBLE / len(list_distinct(q)), 6) AS score
FROM (SELECT conv_id, turn, {WORDS.format('query')} AS q, {WORDS.format('response')} AS t FROM pairs)""")
def _(spark, sf):
    return pairs(spark, sf).select("conv_id", "turn", F.round(R.overlap_score("query", "response"), 6).alias("score"))


CONTEXT = f"""WITH {knn_sql(5)},
x AS (SELECT h.query_id, h.rank, d.doc_id, d.source, d.text FROM hits h JOIN documents d ON d.doc_id = h.vec_id)"""


def context_hits(spark, sf):
    hits = search.top_k(load(spark, sf, "embeddings"), questions(spark, sf), 5).withColumnRenamed("vec_id", "doc_id")
    return search.hits_with_documents(hits, load(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")


CONTEXT_TEXT = "string_agg('Topic: ' || source || chr(10) || 'Description: ' || text, chr(10) ORDER BY rank)"


@register("context_assemble", f"{CONTEXT} SELECT query_id, {CONTEXT_TEXT} AS context FROM x GROUP BY 1")
def _(spark, sf):
    return A.assemble_context(context_hits(spark, sf), "source", "text")


@register("prompt_render", f"""{CONTEXT}
SELECT query_id, 'Question: ' || 'label ' || query_id || chr(10) || chr(10) || 'Context:' || chr(10) || {CONTEXT_TEXT} || chr(10) || chr(10)
  || 'Please provide a helpful answer based on the context provided.' AS prompt FROM x GROUP BY 1""")
def _(spark, sf):
    made = A.assemble_context(context_hits(spark, sf), "source", "text")
    asked = F.concat(F.lit("label "), F.col("query_id").cast("string"))
    return made.select("query_id", A.render_prompt(A.CONTEXT_PROMPT, asked, F.col("context")).alias("prompt"))


@register("cite_sources", f"""{CONTEXT}
SELECT query_id, chr(10) || chr(10) || 'Sources:' || chr(10) || string_agg('- ' ||
  coalesce(CASE WHEN rank <> 2 THEN doc_id::VARCHAR END, 'doc-' || (rank - 1)) || ': ' ||
  coalesce(CASE WHEN rank <> 3 THEN source END, 'Untitled') || chr(10), '' ORDER BY rank) AS sources FROM x GROUP BY 1""")
def _(spark, sf):
    hits = context_hits(spark, sf).select(
        "query_id", "rank", F.when(F.col("rank") != 2, F.col("doc_id")).alias("id"),
        F.when(F.col("rank") != 3, F.col("source")).alias("title"))
    return A.cite_sources(hits, "id", "title")


@register("embed_tfidf")
def _(spark, sf):
    chunks = materialise(chunk_documents(docs(spark, sf), "doc_id", "text"), "chunks")
    made = embed_tfidf(fit_tfidf(chunks), chunks)
    return made.select("chunk_id", F.size("embedding").alias("dimension"), F.array_max("embedding").alias("largest"))


_INDEXES: dict = {}


def text_index(spark, sf):
    """The corpus index, built once per application and kept as tables in the shared folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        _INDEXES[key] = P.build_text_index(load(spark, sf, "documents"), "doc_id", "text")
    return _INDEXES[key]


def asked_passages(spark, sf):
    return load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@register("answer_batch")
def _(spark, sf):
    return P.answer_batch(asked_passages(spark, sf), text_index(spark, sf))


def flagship(spark, sf):
    """Every benchmark passage asked against the corpus: five ranked documents and one answer each."""
    index, asked = text_index(spark, sf), asked_passages(spark, sf)
    hits = materialise(index.search(asked, "query_id", "query"), "hits")
    answers = P.answer_batch(asked, index, hits=hits).select("query_id", "safe_response")
    return hits.join(answers, "query_id").select(
        F.col("query_id").alias("item_id"), "rank", F.col("document_id").cast("bigint").alias("doc_id"),
        F.round("score", 6).alias("score"), F.col("safe_response").alias("answer"))


register("flagship")(flagship)


@register("passage_truth", """
SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def _(spark, sf):
    return P.passage_truth(load(spark, sf, "documents"), load(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text")


@register("retrieval_quality_text")
def _(spark, sf):
    from docquery.operators.metrics import retrieval_quality

    truth = P.passage_truth(load(spark, sf, "documents"), load(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text")
    hits = text_index(spark, sf).search(asked_passages(spark, sf), "query_id", "query", 10)
    best = hits.groupBy("query_id", F.col("document_id").cast("bigint").alias("doc_id")).agg(F.min("rank").alias("rank"))
    return retrieval_quality(best, truth, 10)


@register("knn_multi_variant")
def _(spark, sf):
    """Each passage, its first line and its last line are searched; scores are averaged per passage."""
    asked = asked_passages(spark, sf)
    lines = F.split("query", "\n")
    variants = asked.withColumn("variants", F.array_distinct(F.array("query", F.get(lines, F.lit(0)), F.element_at(lines, -1))))
    flat = rewrite.explode_variants(variants, "query_id", "variants")
    hits = text_index(spark, sf).search(flat.select("variant_id", "query"), "variant_id", "query")
    back = hits.select(F.substring_index("query_id", "#", 1).cast("bigint").alias("query_id"), "chunk_id", "score")
    return P.merge_variants(back, 5)


def _turns(spark, sf):
    return pairs(spark, sf).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
        "conv_id", "turn", "query", F.col("response").alias("context"))


# The extractive provider answers with the context line sharing most words, the first of equals.
SPLIT = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> ''))"


@register("generate_batch", f"""WITH {PAIRS},
l AS (SELECT conv_id, turn, query, unnest(string_split(response, chr(10))) AS line,
             generate_subscripts(string_split(response, chr(10)), 1) AS pos FROM pairs),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn
        ORDER BY len(list_intersect({SPLIT.format('query')}, {SPLIT.format('line')})) DESC, pos) AS place
      FROM l WHERE trim(line) <> '')
SELECT conv_id, turn, line AS response, 'success' AS status,
  len(list_filter(regexp_split_to_array(query, '\\s+'), lambda x: x <> ''))::INTEGER AS prompt_tokens,
  len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> ''))::INTEGER AS completion_tokens
FROM r WHERE place = 1""")
def _(spark, sf):
    out = A.generate_answers(_turns(spark, sf), A.ExtractiveProvider)
    return out.select("conv_id", "turn", "response", "status", "prompt_tokens", "completion_tokens")


class UnsteadyProvider(A.ExtractiveProvider):
    """Fails by question: some once, some always. Stands for a remote model under load."""

    model = "unsteady"

    def __init__(self):
        self.failed = set()

    def generate(self, question, context):
        kind, request = len(question or "") % 5, (question, context)
        if kind == 0:
            raise RuntimeError("endpoint overloaded")
        if kind == 1 and request not in self.failed:
            self.failed.add(request)
            raise RuntimeError("vector index unavailable")
        self.failed.discard(request)
        return super().generate(question, context)


@register("generate_retry", f"""WITH {PAIRS}
SELECT conv_id, turn, CASE WHEN length(query) % 5 = 0 THEN 'error' ELSE 'success' END AS status,
  CASE WHEN length(query) % 5 = 0 THEN 'MODEL_INFERENCE' END AS error_type,
  CASE length(query) % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END::INTEGER AS attempts FROM pairs""")
def _(spark, sf):
    out = A.generate_with_retry(_turns(spark, sf), UnsteadyProvider, wait=0)
    return out.select("conv_id", "turn", "status", "error_type", "attempts")


@register("run_report")
def _(spark, sf):
    return A.run_report(A.generate_answers(_turns(spark, sf), UnsteadyProvider))


def session_requests(spark, sf):
    """(requests, history): the last user turn of each conversation and the exchanges before it.

    Conversations have no clock, so the turn number stands for the minute.
    """
    turns = load(spark, sf, "conversations").where("role = 'user'")
    asked = top_per_key(turns, ["conv_id"], [F.desc("turn")], 1, "r").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("last_turn"), F.col("text").alias("query"))
    history = pairs(spark, sf).withColumnRenamed("conv_id", "session_id").join(
        asked.select("session_id", "last_turn"), "session_id").where("turn < last_turn").select(
        "session_id", F.timestamp_seconds(F.col("turn") * 60).alias("timestamp"),
        F.col("turn").cast("string").alias("request_id"), "query", "response")
    return asked.select(F.col("session_id").alias("query_id"), "session_id", "query"), history


@register("answer_session")
def _(spark, sf):
    requests, history = session_requests(spark, sf)
    expand = lambda c, _: rewrite.expand(c, synonyms={"that": "which"}, stop_words=["the", "le"])
    return ask_batch(requests, history, text_index(spark, sf), expand)


@register("answer_log", f"""WITH u AS (SELECT conv_id, arg_max(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT conv_id::VARCHAR AS request_id, conv_id::VARCHAR AS session_id, '2024-02-01' AS date_day, query, 'dev' AS environment,
  len(list_filter(regexp_split_to_array(query, '\\s+'), lambda x: x <> ''))::INTEGER AS tokens_input,
  CASE WHEN len({violations_sql(Policy(), "query", INPUT_MESSAGES)}) > 0 THEN 'blocked' ELSE 'success' END AS status
FROM u""")
def _(spark, sf):
    """Answers written to the day-partitioned log and read back."""
    requests, history = session_requests(spark, sf)
    rows = log_rows(ask_batch(requests, history, text_index(spark, sf)), "dev", "rag-assistant-dev", "extractive",
                    F.lit("2024-02-01 08:00:00").cast("timestamp"))
    path = scratch_path(spark, "log")
    append_log(rows, path)
    return read_log(spark, path).select(
        "request_id", "session_id", "date_day", "query", "environment", "tokens_input", "status")

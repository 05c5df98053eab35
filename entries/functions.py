"""Scalar functions in use, and the functions callable from SQL."""

from pyspark.sql import functions as F

from docquery.functions.registered import register_functions
from docquery.operators import answering as A

from entries.retrieval import PIECES, asked_passages, text_index
from entries.tables import WITH_LOGS, load, logs, register


@register("fn_string", r"""
SELECT doc_id, source || '-' || lang AS joined, lower(text) AS lowered, trim('  ' || source || ' ') AS trimmed,
       text LIKE '%tion%' AS liked, contains(text, 'is') AS contained, text LIKE 'E%' AS started,
       split_part(text, ' ', 1) AS first_word, length(text)::INTEGER AS characters,
       array_to_string(string_split(source, 'r'), '/') AS rejoined, regexp_matches(text, '[0-9]{4}') AS has_number,
       regexp_replace(source, '[0-9]+', '#', 'g') AS masked FROM documents""")
def _(spark, sf):
    t = F.col("text")
    return load(spark, sf, "documents").select(
        "doc_id", F.concat("source", F.lit("-"), "lang").alias("joined"), F.lower(t).alias("lowered"),
        F.trim(F.concat(F.lit("  "), "source", F.lit(" "))).alias("trimmed"), t.like("%tion%").alias("liked"),
        t.contains("is").alias("contained"), t.startswith("E").alias("started"),
        F.split_part(t, F.lit(" "), F.lit(1)).alias("first_word"), F.length(t).alias("characters"),
        F.array_join(F.split("source", "r"), "/").alias("rejoined"), t.rlike("[0-9]{4}").alias("has_number"),
        F.regexp_replace("source", "[0-9]+", "#").alias("masked"))


@register("fn_date", WITH_LOGS + """
SELECT request_id, date_trunc('hour', "timestamp") AS hour, date_trunc('day', "timestamp")::TIMESTAMP AS day,
       "timestamp" - INTERVAL 24 HOURS AS day_before, strftime("timestamp", '%Y-%m-%d') AS date_day, "timestamp"::DATE::VARCHAR AS on_date,
       round((epoch_us("timestamp") - epoch_us(date_trunc('hour', "timestamp"))) / 1000.0::DOUBLE, 3) AS ms_into_hour FROM logs""")
def _(spark, sf):
    ts, hour = F.col("timestamp"), F.date_trunc("hour", "timestamp")
    return logs(spark, sf).select(
        "request_id", hour.alias("hour"), F.date_trunc("day", ts).alias("day"),
        (ts - F.expr("INTERVAL 24 HOURS")).alias("day_before"), F.date_format(ts, "yyyy-MM-dd").alias("date_day"),
        F.to_date(ts).cast("string").alias("on_date"),
        F.round((F.unix_micros(ts) - F.unix_micros(hour)) / 1000, 3).alias("ms_into_hour"))


@register("fn_math", """
SELECT l_returnflag, round(avg(l_quantity), 4) AS mean, round(sum(l_extendedprice), 2) AS total, count(*) AS n,
       round(count(*) FILTER (l_discount > 0.05) * 100.0::DOUBLE / count(*), 6) AS share,
       round(sum(1.0::DOUBLE / (60 + l_linenumber)), 6) AS reciprocal FROM lineitem GROUP BY 1""")
def _(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.avg("l_quantity"), 4).alias("mean"), F.round(F.sum("l_extendedprice"), 2).alias("total"),
        F.count(F.lit(1)).alias("n"),
        F.round(F.count_if(F.col("l_discount") > 0.05) * F.lit(100.0) / F.count(F.lit(1)), 6).alias("share"),
        F.round(F.sum(F.lit(1.0) / (60 + F.col("l_linenumber"))), 6).alias("reciprocal"))


@register("fn_hash", """
SELECT doc_id, sha256(text) AS content_hash, doc_id || '-' || lang AS stable_id, md5(source) AS source_hash FROM documents""")
def _(spark, sf):
    return load(spark, sf, "documents").select(
        "doc_id", F.sha2("text", 256).alias("content_hash"), F.concat_ws("-", "doc_id", "lang").alias("stable_id"),
        F.md5("source").alias("source_hash"))


@register("fn_array", """
SELECT vec_id, len(embedding)::INTEGER AS dimension, round(list_sort(embedding, 'DESC')[1]::DOUBLE, 6) AS largest,
       len(list_filter(embedding, lambda x: x > 0))::INTEGER AS positive,
       round(list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE)), 6) AS head_sum FROM embeddings""")
def _(spark, sf):
    e = F.col("embedding")
    return load(spark, sf, "embeddings").select(
        "vec_id", F.size(e).alias("dimension"), F.round(F.sort_array(e, asc=False)[0].cast("double"), 6).alias("largest"),
        F.size(F.filter(e, lambda x: x > 0)).alias("positive"),
        F.round(F.aggregate(F.slice(e, 1, 8), F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("head_sum"))


@register("fn_map", WITH_LOGS + """
SELECT request_id, coalesce(CASE WHEN k::INTEGER % 2 = 0 THEN k END, 'none') AS k_or_default,
       CASE WHEN k::INTEGER % 2 = 0 THEN 1 ELSE 0 END::INTEGER AS entries FROM logs""")
def _(spark, sf):
    even = F.col("metadata")["k"].cast("int") % 2 == 0
    m = F.when(even, F.col("metadata")).otherwise(F.create_map().cast("map<string,string>"))
    return logs(spark, sf).select("request_id", F.coalesce(F.try_element_at(m, F.lit("k")), F.lit("none")).alias("k_or_default"),
                                  F.size(m).alias("entries"))


@register("fn_json", """
SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k, json_extract_string(props, '$.none') AS missing,
       '{"id":' || event_id || ',"kind":"' || event_type || '"}' AS made FROM events""")
def _(spark, sf):
    return load(spark, sf, "events").select(
        "event_id", F.from_json("props", "k int")["k"].alias("k"), F.get_json_object("props", "$.none").alias("missing"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("made"))


@register("udtf_split_text", f"WITH {PIECES} SELECT doc_id, position, piece AS chunk FROM pieces")
def _(spark, sf):
    register_functions(spark)
    load(spark, sf, "documents").createOrReplaceTempView("split_source")
    return spark.sql("SELECT doc_id, position, chunk FROM split_source, LATERAL split_text(text, 'paragraph', 1000)")


@register("udf_ask")
def _(spark, sf):
    """SQL over questions joined with their retrieved context."""
    register_functions(spark)
    hits = text_index(spark, sf).search(asked_passages(spark, sf), "query_id", "query")
    context = A.assemble_context(hits, "document_id", "content")
    asked_passages(spark, sf).join(context, "query_id", "left").createOrReplaceTempView("asked_source")
    return spark.sql("SELECT query_id, ask(query, 'session-1', context) AS response FROM asked_source")

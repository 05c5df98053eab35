"""Scans, sinks, catalog, generators and ingest steps: written to the shared folder and read back."""

import uuid

from pyspark.sql import functions as F

from docquery.operators.text_columns import project_chunks
from docquery.session import scratch_path
from docquery.sources import generators as G, readers as R, sinks as W

from entries.tables import WITH_LOGS, load, logs, register


def _name(stem: str) -> str:
    return f"{stem}_{uuid.uuid4().hex}"


@register("scan_csv_header", """
SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_acctbal::VARCHAR AS c_acctbal,
       c_mktsegment FROM customer""")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    load(spark, sf, "customer").write.option("header", True).csv(path)
    return R.read_csv(spark, path)


@register("scan_csv_schema", "SELECT * FROM part")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    part = load(spark, sf, "part")
    part.write.option("header", True).csv(path)
    return R.read_csv(spark, path, part.schema)


@register("scan_table", "SELECT * FROM supplier")
def _(spark, sf):
    name = _name("scan")
    W.write_external_table(load(spark, sf, "supplier"), name, scratch_path(spark, "table"))
    return R.read_table(spark, name)


@register("scan_path_format", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def _(spark, sf):
    path = scratch_path(spark, "orc")
    cols = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]
    W.write_path(load(spark, sf, "orders").select(cols), path, "orc")
    return R.read_path(spark, path, "orc")


@register("sql_source", """
SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE c_acctbal >= 5000 GROUP BY 1""")
def _(spark, sf):
    return R.read_sql(
        spark, "SELECT n_name AS nation, count(*) AS customers FROM src_customer JOIN src_nation ON c_nationkey = n_nationkey "
        "WHERE c_acctbal >= :least GROUP BY n_name", {"least": 5000},
        src_customer=load(spark, sf, "customer"), src_nation=load(spark, sf, "nation"))


# The corpus is written as text files, one folder per source; every file becomes one row.
@register("scan_text_files", "SELECT source, sum(length(text) + 1)::BIGINT AS characters FROM documents GROUP BY 1")
def _(spark, sf):
    path = scratch_path(spark, "text")
    (load(spark, sf, "documents").select("source", "text").write
     .option("maxRecordsPerFile", 1000).partitionBy("source").text(path))
    files = R.read_text_files(spark, [f"{path}/source=*/", f"{path}/absent.txt"])
    source = F.regexp_extract("metadata.source", "source=([^/]+)", 1)
    return files.groupBy(source.alias("source")).agg(F.sum(F.length("content")).alias("characters"))


@register("sink_parquet", "SELECT * FROM lineitem")
def _(spark, sf):
    path = scratch_path(spark, "parquet")
    W.write_path(load(spark, sf, "lineitem"), path)
    return R.read_path(spark, path)


@register("sink_table", "SELECT * FROM orders")
def _(spark, sf):
    name = _name("sink")
    W.write_table(load(spark, sf, "orders"), name)
    return R.read_table(spark, name)


@register("sink_external_table", "SELECT doc_id, text, lang FROM documents")
def _(spark, sf):
    name = _name("external")
    W.write_external_table(load(spark, sf, "documents").select("doc_id", "text", "lang"), name, scratch_path(spark, "ext"))
    return R.read_table(spark, name)


# Two appended batches, then a read of ten days that prunes the other folders.
@register("log_append", WITH_LOGS + """
SELECT request_id, "timestamp", query, latency_ms, environment, date_day FROM logs
WHERE date_day BETWEEN '2024-01-10' AND '2024-01-19'""")
def _(spark, sf):
    path = scratch_path(spark, "log")
    df = logs(spark, sf)
    for part in (F.col("environment") == "prod", F.col("environment") != "prod"):
        W.append_log(df.where(part), path)
    return W.read_log(spark, path).where("date_day BETWEEN '2024-01-10' AND '2024-01-19'").select(
        "request_id", "timestamp", "query", "latency_ms", "environment", "date_day")


@register("catalog_summary")
def _(spark, sf):
    schema = "docquery_checks"
    W.ensure_namespace(spark, schema)
    name = f"{schema}.{_name('log')}"
    W.ensure_log_table(spark, name)
    W.ensure_log_table(spark, name)
    copy = f"{schema}.{_name('orders')}"
    W.write_external_table(load(spark, sf, "orders"), copy, scratch_path(spark, "orders"))
    return W.describe_tables(spark, [name, copy]).withColumn("table", F.regexp_replace("table", "_[0-9a-f]{32}$", ""))


@register("preview", "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 10")
def _(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").orderBy("doc_id").limit(10)


@register("assert_nonempty", "SELECT page_id, url FROM pages")
def _(spark, sf):
    return R.require_rows(load(spark, sf, "pages")).select("page_id", "url")


@register("ingest_stamp", """
SELECT sha256(url || '|' || html) AS record_id, url, TIMESTAMP '2024-01-01 00:00:00' AS created_at,
       TIMESTAMP '2024-01-01 00:00:00' AS updated_at FROM pages""")
def _(spark, sf):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return R.stamp_ingest(load(spark, sf, "pages"), ["url", "html"], at).select("record_id", "url", "created_at", "updated_at")


@register("flatten_metadata", """
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k,
       CASE WHEN event_id % 9 = 0 THEN '{"k": ' ELSE props END AS props FROM events""")
def _(spark, sf):
    from pyspark.sql import types as T

    # every ninth record is cut off in the middle
    cut = load(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 9 == 0, '{"k": ').otherwise(F.col("props")).alias("props"))
    return R.parse_metadata(cut, T.StructType([T.StructField("k", T.IntegerType())]), "props").withColumn("k", F.col("k").cast("string"))


@register("project_rename", """
SELECT doc_id || '-chunk-0' AS chunk_id, doc_id AS document_id, source AS title, text AS content,
       '{"lang":"' || lang || '","n_chars":' || n_chars || '}' AS metadata FROM documents""")
def _(spark, sf):
    return project_chunks(load(spark, sf, "documents"))


def draw(n: int | str, *parts: str) -> str:
    """SQL of the generators' integer in [0, n)."""
    text = " || '|' || ".join(parts)
    return f"(('0x' || substr(sha256({text}), 1, 8))::BIGINT % {n})"


def bits(*parts: str) -> str:
    return "('0x' || substr(sha256(" + " || '|' || ".join(parts) + "), 1, 8))::BIGINT"


def paragraph_sql(i: int) -> str:
    topic = "topics[" + draw("len(topics)", "'0'", "key", f"'pick{i}'") + " + 1]"
    times = f"(({draw(200, chr(39) + '0' + chr(39), 'key', f'{chr(39)}length{i}{chr(39)}')} + 100) // 30)"
    return f"repeat('This is a synthetic paragraph about ' || {topic} || '. ', {times})"


TOPIC_LIST = ", ".join(f"{{'h': {bits(chr(39) + '0' + chr(39), 'key', f'{chr(39)}topic{i}{chr(39)}')}, 't': '{t}'}}"
                       for i, t in enumerate(G.TOPICS))
Z = "'0'"
QUOTE = chr(39)


@register("gen_documents", f"""
WITH k AS (SELECT doc_id::VARCHAR AS key FROM documents),
t AS (SELECT key, list_transform(list_sort([{TOPIC_LIST}])[1:{draw(3, Z, 'key', "'topics'")} + 1], lambda x: x.t) AS topics FROM k),
c AS (SELECT *, array_to_string([{', '.join(paragraph_sql(i) for i in range(7))}][1:{draw(5, Z, 'key', "'paragraphs'")} + 3],
   chr(10) || chr(10)) AS content FROM t)
SELECT sha256('0|' || key) AS id, 'Document about ' || array_to_string(topics, ', ') AS title, content,
  len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> ''))::INTEGER AS word_count FROM c""")
def _(spark, sf):
    """One synthetic document per key of the corpus."""
    made = G.generate_documents(load(spark, sf, "documents"), "doc_id")
    return made.select("id", "title", "content",
                       F.get_json_object("metadata", "$.word_count").cast("int").alias("word_count"))


def pick_sql(values, *parts):
    return "[" + ", ".join(f"'{v}'" for v in values) + "][" + draw(len(values), *parts) + " + 1]"


@register("gen_star", f"""
WITH n AS (SELECT (SELECT count(*) FROM customer) AS nc, (SELECT count(*) FROM part) AS np),
o AS (SELECT o_orderkey::VARCHAR AS key, {draw('nc', Z, 'o_orderkey::VARCHAR', "'customer'")} AS c,
   {draw('np', Z, 'o_orderkey::VARCHAR', "'product'")} AS p FROM orders, n)
SELECT 'ORD' || CASE WHEN length(key) < 5 THEN lpad(key, 5, '0') ELSE key END AS order_id,
  'CUST' || CASE WHEN c < 1000 THEN lpad(c::VARCHAR, 4, '0') ELSE c::VARCHAR END AS customer_id,
  {pick_sql(G.SEGMENTS, Z, 'c::VARCHAR', "'segment'")} AS segment, {pick_sql(G.REGIONS, Z, 'c::VARCHAR', "'region'")} AS region,
  strftime(DATE '2020-01-01' + {draw(1000, Z, 'c::VARCHAR', "'signup'")}::INTEGER, '%Y-%m-%d') AS signup_date,
  'PROD' || CASE WHEN p < 100 THEN lpad(p::VARCHAR, 3, '0') ELSE p::VARCHAR END AS product_id,
  {pick_sql(G.CATEGORIES, Z, 'p::VARCHAR', "'category'")} AS category,
  ({draw(99001, Z, 'p::VARCHAR', "'price'")} + 1000) / 100.0::DOUBLE AS price,
  ({draw(9, Z, 'key', "'quantity'")} + 1)::INTEGER AS quantity,
  strftime(DATE '2021-01-01' + {draw(730, Z, 'key', "'date'")}::INTEGER, '%Y-%m-%d') AS order_date FROM o""")
def _(spark, sf):
    """As many customers, products and orders as the tables hold, joined back to one wide row per order."""
    customers, parts = load(spark, sf, "customer"), load(spark, sf, "part")
    c = G.generate_customers(customers, "c_custkey")
    p = G.generate_products(parts, "p_partkey")
    o = G.generate_orders(load(spark, sf, "orders"), "o_orderkey", customers.count(), parts.count())
    return o.join(c.drop("name"), "customer_id").join(p.drop("name"), "product_id")

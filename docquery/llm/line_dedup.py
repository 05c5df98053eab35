"""Line dedup: lines that several documents share stay only in the first of them. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Drop repeated lines: ``doc_id, text, n_lines, n_dropped`` and the input's other columns.

    A text is split at line feeds (null or empty: one empty line). A key (see ``line_key``) of at least ``min_chars``
    code points that at least ``min_docs`` documents hold loses all its lines, except in the holder with the smallest
    doc_id. Other lines stay in order, joined by line feeds.

    Rows that repeat a doc_id with another text are judged by doc_id and rebuilt each from its own text; fully
    repeated rows all come back alike. Rows without doc_id count as no document: they lose lines that another
    document keeps and never make a line frequent. An empty table gives an empty result.

    Plan: lines are reduced to two 64-bit hashes before they are shuffled, counted per (hash, document) with map-side
    sums, and only positions to drop are sent back, so a line in a third of all documents is a sum like any other and
    no text takes part in the count. The texts meet the positions in one shuffle by document.
    """
    own = "__row"
    numbered = docs.withColumn(own, F.xxhash64("text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = numbered.select("doc_id", own, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keyed = (lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
             .select("doc_id", own, "pos", F.xxhash64("key").alias("h1"),
                     F.xxhash64(F.concat(F.lit("\n"), "key")).alias("h2")))
    held = keyed.where("doc_id IS NOT NULL").groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    shared = (held.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
              .where(F.col("n") >= min_docs).select("h1", "h2", "first"))
    drops = (keyed.join(shared, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
             .groupBy("doc_id", own).agg(F.array_sort(F.collect_set("pos")).alias("__drops"))
             .select(F.col("doc_id").alias("__doc"), F.col(own).alias("__own"), "__drops"))
    met = numbered.join(drops.hint("shuffle_hash"),
                        F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col(own) == F.col("__own")), "left")
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return met.select(
        *others,
        F.array_join(F.zip_with(F.split(text, "\n"), _flags(F.col("__drops")),
                                lambda line, drop: F.when(drop, None).otherwise(line)), "\n").alias("text"),
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        F.when(F.col("__drops").isNull(), 0).otherwise(F.size("__drops")).cast("long").alias("n_dropped"))


def _flags(drops: Column) -> Column:
    """Ascending positions to booleans: false over each gap, then true; null where nothing is dropped."""
    before = F.slice(F.concat(F.array(F.lit(-1)), drops), F.lit(1), F.size(drops))
    runs = F.zip_with(drops, before, lambda at, last: F.concat(
        F.array_repeat(F.lit(False), at - last - 1), F.array(F.lit(True))))
    return F.coalesce(F.flatten(runs), F.array().cast("array<boolean>"))


LINE_DEDUP_SQL = """
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
         GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT k.doc_id, k.pos, k.line, s.first IS NOT NULL AND s.first <> k.doc_id AS dropped
         FROM keyed k LEFT JOIN shared s ON s.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

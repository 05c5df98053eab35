"""Synthetic corpora and sales tables, one row per key of a given frame.

Draws are hashes of (seed, key, purpose), so a rerun or a retried task gives the same rows and no
state crosses tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docquery.functions.text import hash_bits, token_count

# Fixed values.
TOPICS = ["Machine Learning", "Data Engineering", "Cloud Computing", "Artificial Intelligence", "DevOps",
          "Big Data", "Business Intelligence", "Data Science", "Software Engineering"]
SEGMENTS = ["Enterprise", "SMB", "Consumer"]
REGIONS = ["North America", "Europe", "Asia", "South America"]
CATEGORIES = ["Software", "Hardware", "Service", "Subscription"]
SENTENCE = ("This is a synthetic paragraph about ", ". ")


def _below(n, *parts) -> Column:
    """An integer in [0, n)."""
    wide = isinstance(n, int) and n > 1 << 31  # keys of more rows than 32 bits count
    return F.pmod(hash_bits(*parts), F.lit(n) if isinstance(n, int) else n).cast("long" if wide else "int")


def _one_of(values: list[str], *parts) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), _below(len(values), *parts) + 1)


def generate_documents(keys: DataFrame, key: str, seed: int = 0, created_at: str = "2024-01-01T00:00:00") -> DataFrame:
    """1-3 distinct topics, 3-7 paragraphs of a repeated sentence, JSON metadata."""
    s = F.lit(seed)
    shuffled = F.array_sort(F.array(*[
        F.struct(hash_bits(s, key, F.lit(f"topic{i}")).alias("h"), F.lit(t).alias("t"))
        for i, t in enumerate(TOPICS)]))
    n_topics = _below(3, s, key, F.lit("topics")) + 1
    picked = F.transform(F.slice(shuffled, F.lit(1), n_topics), lambda x: x["t"])

    def paragraph(i: int) -> Column:
        topic = F.element_at(F.col("topics"), _below(F.size("topics"), s, key, F.lit(f"pick{i}")) + 1)
        times = F.floor((_below(200, s, key, F.lit(f"length{i}")) + 100) / 30).cast("int")
        return F.repeat(F.concat(F.lit(SENTENCE[0]), topic, F.lit(SENTENCE[1])), times)

    n_paragraphs = _below(5, s, key, F.lit("paragraphs")) + 3
    base = keys.select(F.col(key).cast("string").alias(key)).withColumn("topics", picked)
    body = base.select(
        F.sha2(F.concat_ws("|", s.cast("string"), F.col(key)), 256).alias("id"),
        F.concat(F.lit("Document about "), F.array_join("topics", ", ")).alias("title"),
        F.array_join(F.slice(F.array(*[paragraph(i) for i in range(7)]), F.lit(1), n_paragraphs), "\n\n").alias("content"),
        "topics",
    )
    metadata = F.to_json(F.struct("id", "title", "topics", F.lit(created_at).alias("created_at"),
                                  F.lit("synthetic").alias("source"), token_count("content").alias("word_count")))
    return body.select("id", "title", "content", metadata.alias("metadata"))


def _code(prefix: str, key: str, width: int) -> Column:
    """Zero-padded to ``width``; longer numbers keep all their digits."""
    text = F.col(key).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))


def generate_customers(keys: DataFrame, key: str, seed: int = 0) -> DataFrame:
    s = F.lit(seed)
    return keys.select(
        _code("CUST", key, 4).alias("customer_id"),
        F.concat(F.lit("Customer "), F.col(key).cast("string")).alias("name"),
        _one_of(SEGMENTS, s, key, F.lit("segment")).alias("segment"),
        _one_of(REGIONS, s, key, F.lit("region")).alias("region"),
        F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), _below(1000, s, key, F.lit("signup"))),
                      "yyyy-MM-dd").alias("signup_date"))


def generate_products(keys: DataFrame, key: str, seed: int = 0) -> DataFrame:
    s = F.lit(seed)
    cents = _below(99001, s, key, F.lit("price")) + 1000
    return keys.select(
        _code("PROD", key, 3).alias("product_id"),
        F.concat(F.lit("Product "), F.col(key).cast("string")).alias("name"),
        _one_of(CATEGORIES, s, key, F.lit("category")).alias("category"),
        (cents / 100.0).alias("price"))


def generate_orders(keys: DataFrame, key: str, customers: int, products: int, seed: int = 0) -> DataFrame:
    """Foreign keys point into customers 0..n-1 and products 0..m-1."""
    s = F.lit(seed)
    drawn = keys.select(key, _below(customers, s, key, F.lit("customer")).alias("_c"),
                        _below(products, s, key, F.lit("product")).alias("_p"))
    return drawn.select(
        _code("ORD", key, 5).alias("order_id"), _code("CUST", "_c", 4).alias("customer_id"),
        _code("PROD", "_p", 3).alias("product_id"),
        (_below(9, s, key, F.lit("quantity")) + 1).alias("quantity"),
        F.date_format(F.date_add(F.lit("2021-01-01").cast("date"), _below(730, s, key, F.lit("date"))),
                      "yyyy-MM-dd").alias("order_date"))

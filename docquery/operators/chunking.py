"""Document -> chunk rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docquery.config import CHUNK_CHARS
from docquery.functions.text import split_paragraphs


def _cut(piece: Column, limit: int) -> Column:
    """A piece longer than the limit becomes consecutive slices of ``limit`` characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(piece), F.lit(1)), F.lit(limit))
    return F.transform(starts, lambda s: F.substring(piece, s, F.lit(limit)))


def pieces(text: Column, limit: int) -> Column:
    return F.flatten(F.transform(split_paragraphs(text), lambda p: _cut(p, limit)))


def pack(text: Column, limit: int) -> Column:
    """Join neighbouring pieces by a line break while the chunk stays within ``limit`` characters."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc, piece):
        fits = F.length(acc["open"]) + 1 + F.length(piece) <= limit
        return (
            F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), piece.alias("open")))
            .when(fits, F.struct(acc["done"].alias("done"),
                                 F.concat(acc["open"], F.lit("\n"), piece).alias("open")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), piece.alias("open")))
        )

    return F.aggregate(
        pieces(text, limit), start, step,
        lambda acc: F.when(acc["open"].isNull(), acc["done"])
        .otherwise(F.concat(acc["done"], F.array(acc["open"]))),
    )


def chunk_documents(docs: DataFrame, id_col: str = "id", text_col: str = "content",
                    carry: list[str] | None = None, limit: int = CHUNK_CHARS, packed: bool = True) -> DataFrame:
    """One row per chunk, keyed ``<id>-chunk-<position>`` so a rerun gives the same keys.

    ``packed=False`` keeps one chunk per paragraph piece. No shuffle: the explode is local.
    """
    text = F.col(text_col)
    parts = pack(text, limit) if packed else pieces(text, limit)
    exploded = docs.select(
        F.col(id_col).cast("string").alias("document_id"),
        *[F.col(c) for c in (carry or [])],
        F.posexplode(parts).alias("position", "content"),
    )
    return exploded.select(
        F.concat_ws("-chunk-", "document_id", F.col("position").cast("string")).alias("chunk_id"),
        "document_id", "position", "content", *(carry or []),
    )

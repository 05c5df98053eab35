"""A corpus pipeline in five stages, each over all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from docquery.llm import decontam, language, line_dedup, pieces, shingles
from docquery.llm.common import documents
from docquery.session import apply_conf, materialise

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
ORACLE_SQL = None  # models, fingerprints and tokenizers are beyond SQL


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; it learns from all labelled documents of the stage's input."""
    apply_conf(spark)
    return language.keep_identified(docs, language.fit(docs, F.lit(True)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document holds; n_chars follows the text where the table has it."""
    apply_conf(spark)
    kept = line_dedup.dedup_lines(docs).drop("n_lines", "n_dropped")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return kept.select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: sets of five-word shingles with a Jaccard similarity from 0.8 on."""
    apply_conf(spark)
    return shingles.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    apply_conf(spark)
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each document that is left."""
    apply_conf(spark)
    return pieces.encode_pieces(docs, PIECE_MODEL, pieces.DIGESTS, pieces.digests)


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_duplicates", dedup_near),
    ("decontamination", decontaminate),
    ("pieces", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read back."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

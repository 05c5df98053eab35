"""The registered queries of the corpus operators, with their DuckDB twins where SQL can state them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from docquery.llm import (alignment, codes, collision_search, decontam, language, line_dedup, mixing, pieces, quality, simhash,
                          suffix_dedup, token_files, toxicity)
from docquery.llm.common import documents, remainder

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_simhash(spark, sf_dir):
    groups = simhash.near_groups(documents(spark, sf_dir), words=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), 100, suffix_dedup.DIGESTS, suffix_dedup.digests)


def op3_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    fold = F.coalesce(remainder(3) != 1, F.lit(True))
    model = language.fit(docs, fold)
    return (language.identify(docs, model, ["doc_id"]).withColumn("held_out", ~fold)
            .select("doc_id", "held_out", "lang_pred", "score", "rejected"))


def op4_line_dedup(spark, sf_dir):
    kept = line_dedup.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_quality(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = F.coalesce(remainder(3) != 1, F.lit(True))
    scored = quality.score_quality(docs, quality.fit(docs, labels, fold), ["doc_id"])
    return scored.select("doc_id", (~fold).alias("held_out"), "score", "predicted")


def op6_token_files(spark, sf_dir):
    manifest = token_files.write_token_files(documents(spark, sf_dir), WORD_TOKENIZER, end_id=1)
    return token_files.read_token_files(manifest)


def op7_sentencepiece(spark, sf_dir):
    return pieces.encode_pieces(documents(spark, sf_dir), PIECE_MODEL, pieces.DIGESTS, pieces.digests)


def op8_nearest(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return collision_search.nearest(vectors, F.col("vec_id") % 20 == 0)


def op9_toxicity(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = F.coalesce(remainder(5) != 0, F.lit(True))
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, labels, fold), ["doc_id"])
    return scored.select("doc_id", (~fold).alias("held_out"), "score", "predicted")


def op10_decontamination(spark, sf_dir):
    found = decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "edits", "first_byte", "end_byte")


def op11_alignment(spark, sf_dir):
    return alignment.link_counts(documents(spark, sf_dir), BYTE_TOKENIZER, PIECE_MODEL)


def op12_vector_codes(spark, sf_dir):
    coded, books = codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.withColumn("codebooks_sha256", F.sha2(F.lit(books.text), 256))


def op13_mixing(spark, sf_dir):
    taken = mixing.words_taken(mixing.mix(documents(spark, sf_dir)))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


REGISTRY = {
    "op1_simhash": (op1_simhash, None),
    "op2_suffix_dedup": (op2_suffix_dedup, None),
    "op3_language": (op3_language, None),
    "op4_line_dedup": (op4_line_dedup, line_dedup.LINE_DEDUP_SQL),
    "op5_quality": (op5_quality, None),
    "op6_token_files": (op6_token_files, None),
    "op7_sentencepiece": (op7_sentencepiece, None),
    "op8_nearest": (op8_nearest, None),
    "op9_toxicity": (op9_toxicity, None),
    "op10_decontamination": (op10_decontamination, None),
    "op11_alignment": (op11_alignment, None),
    "op12_vector_codes": (op12_vector_codes, codes.compress_sql()),
    "op13_mixing": (op13_mixing, None),
}

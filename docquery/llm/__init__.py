"""Operators of a training-data pipeline: dedup, language, quality, toxicity, tokens, decontamination, vectors."""

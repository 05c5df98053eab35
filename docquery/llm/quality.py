"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from docquery.llm import linear
from docquery.llm.sampling import labelled

SIZE = 1 << 18  # coordinates; the last one is the bias
TRAIN_ROWS = 8_000  # most labelled rows that a model is fitted on
# The outline of a word. Capitals A, other letters a, digits 0, white space and marks as they are.
OUTLINE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c
                for c in range(256))
PIECE = 1 << 16


def word_ngrams(size: int = SIZE):
    """Text bytes to hashed word features: words and word pairs, lower-cased, and the same of word outlines.

    An outline keeps the first two and last three places of a word's pattern, so that marks glued to words, capitals
    and numbers count whatever the word is. Values are dampened counts of unit length, over the whole text.
    """
    from zlib import crc32

    salts = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint64)

    def hashed(words: list[bytes], one: int, two: int) -> list[np.ndarray]:
        h = np.fromiter(map(crc32, words), np.uint64, len(words))
        pairs = h[:-1] * np.uint64(31) + h[1:] * np.uint64(0x1F35)
        return [h * salts[one], pairs * salts[two]]

    def features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = data.lower().split()
        outlines = [w if len(w) < 5 else w[:2] + w[-3:] for w in data.translate(OUTLINE).split()]
        at = np.concatenate([(h >> np.uint64(13)) % np.uint64(size - 1)
                             for h in (*hashed(words, 0, 1), *hashed(outlines, 2, 3))]).astype(np.int64)
        found, counts = np.unique(at, return_counts=True)
        values = np.log1p(counts)
        norm = np.linalg.norm(values)
        return np.append(found, size - 1), np.append(values / norm if norm else values, 1.0)

    return features


def fit(docs: DataFrame, labels: DataFrame, fold: Column, label: str = "quality", rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learned from at most ``rows`` labelled documents of the fold."""
    return linear.train(labelled(docs, labels, label, fold, rows), word_ngrams, SIZE)


def score_quality(docs: DataFrame, weights: np.ndarray, columns: list[str]) -> DataFrame:
    """``columns`` plus ``score`` (0 to 1, higher: better) and ``predicted`` for every row.

    Whole texts are scored; null and empty texts get the bias alone. Repeated rows get equal scores; an empty table
    gives an empty result. Narrow: no shuffle, one broadcast of a fixed number of weights.
    """
    return linear.score(docs, word_ngrams, weights, columns).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))

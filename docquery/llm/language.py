"""Language identification: TF-IDF n-gram vectors against several centroids of each language, by cosine."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from docquery.llm.common import keep_rows, map_rows, small_batches
from docquery.llm.sampling import bounded

SIZE = 4096  # hashed three-byte n-grams
SAMPLE = 500  # most rows of a language whose vectors are clustered
CLUSTERS = 4
REJECT_SHARE = 0.3  # of the similarity that all but one in a hundred of a centroid's texts reach
FULL_GRAMS = 400  # distinct n-grams from which on the whole floor holds; similarity falls with the root of their number
PIECE = 1 << 22
# ASCII other than letters separates words.
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def gram_counts(data: bytes) -> np.ndarray:
    """How often each hashed n-gram occurs in the lower-cased words of the whole text, word borders included."""
    words = data.decode("utf-8", "replace").lower().encode().translate(LETTERS).split()
    joined = b" " + b" ".join(words) + b" "
    counts = np.zeros(SIZE, np.int64)
    for low in range(0, len(joined) - 2, PIECE):
        a = np.frombuffer(joined[low:low + PIECE + 2], np.uint8).astype(np.uint32)
        grams = a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]
        counts += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(20), minlength=SIZE)
    return counts


def vector(data: bytes, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vector; zero for a text without letters."""
    values = np.log1p(gram_counts(data)) * idf
    norm = np.linalg.norm(values)
    return (values / norm if norm else values).astype(np.float32)


def has_letter(data: bytes | None) -> bool:
    return data is not None and any(map(str.isalpha, data.decode("utf-8", "replace")))


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    floors: np.ndarray  # below it a text is rejected

    def predict(self, data: bytes | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, whether it is rejected. ``und`` only for no text, no letter or no model."""
        if not self.languages or not has_letter(data):
            return "und", 0.0, True
        own = vector(data, self.idf)
        near = self.centroids @ own
        best = int(np.argmax(near))
        top: dict[str, float] = {}
        for language, value in zip(self.languages, near.tolist()):
            top[language] = max(value, top.get(language, -1.0))
        shares = np.exp(20 * (np.array(list(top.values())) - near[best]))
        return self.languages[best], float(1 / shares.sum()), bool(
            near[best] < self.floors[best] * min(1.0, (np.count_nonzero(own) / FULL_GRAMS) ** 0.5))


def cluster(vectors: np.ndarray, count: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids by cosine, and each one's floor before the share; starts from far apart vectors."""
    chosen = [int(np.argmax(vectors @ vectors.mean(axis=0)))]
    for _ in range(min(count, len(vectors)) - 1):
        near = (vectors @ vectors[chosen].T).max(axis=1)
        # half-way out rather than the very oddest text
        chosen.append(int(np.argsort(near, kind="stable")[len(near) // 20]))
    centroids = vectors[sorted(set(chosen))]
    for _ in range(rounds):
        own = (vectors @ centroids.T).argmax(axis=1)
        centroids = np.stack([vectors[own == k].mean(axis=0) for k in range(len(centroids)) if (own == k).any()])
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    near = vectors @ centroids.T
    own = near.argmax(axis=1)
    floors = np.array([np.quantile(near[own == k, k], 0.01) if (own == k).any() else 0.0
                       for k in range(len(centroids))])
    return centroids, floors


def fit(docs: DataFrame, fold: Column, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model:
    """Document frequencies of all labelled rows of the fold, centroids of at most ``sample`` rows a language.

    Only ``text`` and non-null ``lang`` are learned from. To the driver come SIZE sums and ``clusters`` centroids a
    language. Without labelled rows the model knows no language.
    """
    rows = docs.where(fold & F.col("lang").isNotNull() & F.col("text").isNotNull())
    texts = F.col("text").cast("binary").alias("text")

    def frequencies(batches):
        import pyarrow as pa

        held = np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held[:-1] += gram_counts(text) > 0
                held[-1] += 1
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[used])], names=["gram", "docs"])

    sums = (small_batches(rows.select(texts)).mapInArrow(frequencies, "gram long, docs long")
            .groupBy("gram").agg(F.sum("docs").alias("docs")).collect())
    held = np.zeros(SIZE + 1)
    for gram, count in sums:
        held[gram] = count
    idf = np.log((1 + held[-1]) / (1 + held[:-1])) + 1
    vectors = map_rows(bounded(rows, sample, "lang").select("lang", texts), "lang string, v binary",
                       lambda: lambda lang, text: (lang, vector(text, idf).tobytes()))

    def clustered(key, frame):
        import pandas as pd

        centroids, floors = cluster(np.stack([np.frombuffer(v, np.float32) for v in frame.v.sort_values()]), clusters)
        return pd.DataFrame({"lang": key[0], "v": [c.astype(np.float32).tobytes() for c in centroids], "floor": floors})

    found = sorted(vectors.groupBy("lang").applyInPandas(clustered, "lang string, v binary, floor double").collect(),
                   key=lambda r: (r.lang, bytes(r.v)))
    return Model(idf, [r.lang for r in found],
                 np.stack([np.frombuffer(r.v, np.float32) for r in found]) if found else np.zeros((0, SIZE), np.float32),
                 np.array([r.floor for r in found]) * REJECT_SHARE)


def identify(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` plus ``lang_pred, score, rejected`` for every row, from its whole text alone.

    Null texts and texts without a letter are ``und``, score 0, rejected; texts far from every centroid keep the
    nearest language and are marked rejected. Repeated rows get equal results; an empty table gives an empty one.
    Narrow: no shuffle, one broadcast of the model.
    """
    # plain values: what is broadcast must load without this package
    shared = docs.sparkSession.sparkContext.broadcast((model.idf, model.languages, model.centroids, model.floors))
    kinds = dict(docs.dtypes)

    def make():
        held = Model(*shared.value)
        return lambda *values: (*values[:-1], *held.predict(values[-1]))

    return map_rows(docs.select(*columns, F.col("text").cast("binary").alias("text")),
                    ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", lang_pred string, score double, rejected boolean",
                    make)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose language is identified and not rejected, all columns, in one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast((model.idf, model.languages, model.centroids, model.floors))

    def make():
        held = Model(*shared.value)
        return lambda texts: [not held.predict(text)[2] for text in texts]

    return keep_rows(docs, make)

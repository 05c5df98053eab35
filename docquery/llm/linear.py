"""Sparse logistic regression trained by follow-the-regularised-leader updates, one row at a time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from docquery.llm.common import map_rows, small_batches


class Ftrl:
    """Per-coordinate follow-the-regularised-leader (proximal): weights follow from sums of gradients and squares."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        self.sums, self.squares = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        sums = self.sums[at]
        rate = (self.beta + np.sqrt(self.squares[at])) / self.alpha + self.l2
        return np.where(np.abs(sums) <= self.l1, 0.0, -(sums - np.sign(sums) * self.l1) / rate)

    def update(self, at: np.ndarray, values: np.ndarray, target: float) -> None:
        """One step on a row of distinct coordinates; ``target`` may lie between 0 and 1."""
        weights = self.weights(at)
        gradient = (sigmoid(weights @ values) - target) * values
        grown = self.squares[at] + gradient * gradient
        sigma = (np.sqrt(grown) - np.sqrt(self.squares[at])) / self.alpha
        self.sums[at] += gradient - sigma * weights
        self.squares[at] = grown


def sigmoid(value: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(value, -35, 35))))


def train(rows: DataFrame, features, size: int, epochs: int = 3) -> np.ndarray:
    """Weights from ``doc_id, text, label`` (a bounded sample, see ``sampling``).

    ``features`` is called in a task and gives the function from text bytes to (coordinates, values). Features are
    made where the texts are; one task then follows them as a sorted stream, each row once in each epoch, and keeps
    nothing but the sums. Without rows all weights are zero.
    """
    kind = dict(rows.dtypes)["doc_id"]
    made = map_rows(rows.select("doc_id", F.col("label").cast("double"), F.col("text").cast("binary").alias("text")),
                    f"doc_id {kind}, label double, at array<int>, value array<float>",
                    lambda: _featured(features))
    stream = (made.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
              .repartition(1).sortWithinPartitions("epoch", F.xxhash64("doc_id"), "doc_id", "at"))

    def follow(batches):
        import pyarrow as pa

        model = Ftrl(size)
        for batch in batches:
            for label, at, value in zip(*(batch.column(c).to_pylist() for c in ("label", "at", "value"))):
                model.update(np.array(at, np.int64), np.array(value), label)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f8").tobytes()])], names=["weights"])

    found = small_batches(stream).mapInArrow(follow, "weights binary").first()
    return np.frombuffer(found.weights, "<f8") if found else np.zeros(size)


def _featured(features):
    of = features()

    def row(doc_id, label, text):
        at, value = of(text or b"")
        return doc_id, label, at.astype(np.int32), value.astype(np.float32)

    return row


def score(docs: DataFrame, features, weights: np.ndarray, columns: list[str]) -> DataFrame:
    """``columns`` plus ``score``: the logistic of the sparse dot product, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # a fixed number of coordinates
    kinds = dict(docs.dtypes)

    def make():
        of, held = features(), shared.value

        def row(*values):
            at, value = of(values[-1] or b"")
            return *values[:-1], sigmoid(held[at] @ value)

        return row

    return map_rows(docs.select(*columns, F.col("text").cast("binary").alias("text")),
                    ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", score double", make)

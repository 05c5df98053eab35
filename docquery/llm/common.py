"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Rows of an Arrow batch: the byte limit of a batch counts fixed-width columns well, long texts less so.
BATCH_ROWS = 1000


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a row without id falls into no fold (null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def raw_text(text: str = "text") -> Column:
    """A text's UTF-8 bytes; null stays null."""
    return F.col(text).cast("binary")


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """One output row for each input row, made in Arrow batches.

    ``make`` is called once in each task (to load models); what it returns takes a row's columns in order.
    Memory: one batch of at most BATCH_ROWS rows.
    """
    out = arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in batches:
            made = [row(*values) for values in zip(*(column.to_pylist() for column in batch.columns))]
            if made:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, field.type) for values, field in zip(zip(*made), out)], schema=out)

    return small_batches(df).mapInArrow(run, schema)


def flat_map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[..., dict]], columns: list[str]) -> DataFrame:
    """Any number of output rows for each input row: the function returns a tuple of equally long numpy arrays or lists.

    Rows are handed on in pieces of about 100,000, so a very long text never fills a worker.
    """
    out = arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        rows = make()
        held: list[tuple] = []
        count = 0

        def flush():
            arrays = []
            for k, field in enumerate(out):
                parts = [h[k] for h in held]
                if all(isinstance(p, np.ndarray) for p in parts):
                    arrays.append(pa.array(np.concatenate(parts), field.type))
                else:
                    arrays.append(pa.array([v for p in parts for v in p], field.type))
            return pa.RecordBatch.from_arrays(arrays, schema=out)

        for batch in batches:
            for values in zip(*(column.to_pylist() for column in batch.columns)):
                for made in rows(*values):
                    if len(made[0]):
                        held.append(made)
                        count += len(made[0])
                    if count >= 100_000:
                        yield flush()
                        held, count = [], 0
        if held:
            yield flush()

    return small_batches(df.select(*columns)).mapInArrow(run, schema)


def keep_rows(df: DataFrame, make: Callable[[], Callable[[list[bytes | None]], list[bool]]]) -> DataFrame:
    """The rows whose ``text`` (its bytes, or None) passes, all columns as they are: one narrow pass.

    ``make`` is called once in each task and returns the test of a batch of texts.
    """
    taken = {c.lower() for c in df.columns}
    name = "__text"
    while name in taken:
        name += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make()
        for batch in batches:
            keep = test(batch.column(batch.num_columns - 1).to_pylist())
            if any(keep):
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(keep, pa.bool_()))

    return small_batches(df.select("*", raw_text().alias(name))).mapInArrow(run, df.schema)


class _Sliced:
    """An Arrow function over batches of at most BATCH_ROWS rows, whatever size Spark sends."""

    def __init__(self, df: DataFrame):
        self.df = df

    def mapInArrow(self, run, schema) -> DataFrame:
        rows = BATCH_ROWS

        def sliced(batches):
            return run(batch.slice(low, rows) for batch in batches for low in range(0, batch.num_rows, rows))

        return self.df.mapInArrow(sliced, schema)


def small_batches(df: DataFrame) -> _Sliced:
    """Slices share the memory of Spark's batch, which is bounded in bytes; Python values are made a slice at a time."""
    return _Sliced(df)


def arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def per_worker(key, make: Callable[[], object]):
    """What ``make`` returns, made once in a Python worker and kept for its later tasks (models, bounded stores)."""
    import sys
    import types

    kept = sys.modules.setdefault("_docquery_worker", types.ModuleType("_docquery_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]

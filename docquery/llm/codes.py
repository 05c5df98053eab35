"""Vector code compression: product quantisation in integers, nearest entries found in Walsh-Hadamard coefficients."""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from docquery.llm.common import small_batches

PARTS = 16
ENTRIES = 64
SCALE = 256  # a component x becomes floor(SCALE * x)
ROUNDS = 2
CHUNK = 1 << 12  # vectors whose distances are held at once
SALTS = 16  # pieces of a label's rows when its sum is handed out


def finite(vector: Column) -> Column:
    """Not null, no null and no non-finite component."""
    return F.coalesce(F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))), F.lit(False))


def sequency_order(width: int) -> np.ndarray:
    """Rows of the Hadamard matrix of this width (a power of two) by their number of sign changes."""
    signs = transform(np.eye(width, dtype=np.int64), None)
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1), kind="stable")


def transform(parts: np.ndarray, order: np.ndarray | None) -> np.ndarray:
    """The Walsh-Hadamard transform of the last axis by additions alone, coefficients in the order given."""
    out, width, step = parts.copy(), parts.shape[-1], 1
    while step < width:
        pairs = out.reshape(*out.shape[:-1], width // (2 * step), 2, step)
        out = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], axis=-2).reshape(out.shape)
        step *= 2
    return out if order is None else out[..., order]


@dataclass
class Codebooks:
    """``entries``: parts x entries x length, 64-bit integers."""

    entries: np.ndarray

    @property
    def text(self) -> str:
        """All integers by part, entry and position, joined by commas."""
        return ",".join(map(str, self.entries.ravel().tolist()))

    def prepared(self) -> "Nearest":
        return Nearest(self.entries)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """Vectors (in units of 1 / SCALE) of codes: rows x parts indexes to rows x components."""
        return self.entries[np.arange(self.entries.shape[0]), codes].reshape(len(codes), -1)


class Nearest:
    """The nearest entry of each part, exactly: squared distances of the transforms are those of the parts times the width."""

    def __init__(self, entries: np.ndarray):
        self.parts, self.count, self.length = entries.shape
        self.width = 1 << (self.length - 1).bit_length()
        self.order = sequency_order(self.width)
        self.entries = self._transformed(entries)

    def _transformed(self, parts: np.ndarray) -> np.ndarray:
        padded = np.zeros((*parts.shape[:-1], self.width), np.int64)
        padded[..., :self.length] = parts
        return transform(padded, self.order)

    def __call__(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of integers to (indexes, squared distances), each rows x parts; ties go to the lower index."""
        parts = vectors.reshape(len(vectors), self.parts, self.length)
        codes = np.zeros((len(vectors), self.parts), np.int64)
        errors = np.zeros((len(vectors), self.parts), np.int64)
        for low in range(0, len(vectors), CHUNK):
            some = self._transformed(parts[low:low + CHUNK])
            for part in range(self.parts):
                codes[low:low + CHUNK, part], errors[low:low + CHUNK, part] = self._part(some[:, part], self.entries[part])
        return codes, errors

    def _part(self, rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # sums of the first coefficients only grow: an entry above the whole distance of another one is out
        sums = (rows[:, :1] - entries[:, 0]) ** 2
        bound = ((rows - entries[sums.argmin(axis=1)]) ** 2).sum(axis=1)
        row, entry = np.nonzero(sums <= bound[:, None])
        left = sums[row, entry]
        for k in range(1, self.width):
            left = left + (rows[row, k] - entries[entry, k]) ** 2
            if k + 1 < self.width:
                if k == 1:  # a second, closer guess: the best entry after two coefficients
                    begins = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                    least = np.repeat(np.minimum.reduceat(left, begins), np.diff(np.append(begins, len(row))))
                    guess = np.flatnonzero(left == least)
                    guess = guess[np.append(True, row[guess][1:] != row[guess][:-1])]
                    bound = np.minimum(bound, ((rows - entries[entry[guess]]) ** 2).sum(axis=1))
                keep = left <= bound[row]
                row, entry, left = row[keep], entry[keep], left[keep]
        begins = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        least = np.minimum.reduceat(left, begins)
        best = np.flatnonzero(left == np.repeat(least, np.diff(np.append(begins, len(row)))))
        best = best[np.append(True, row[best][1:] != row[best][:-1])]
        return entry[best], left[best] // self.width


def limit_of(length: int, parts: int = PARTS) -> int:
    """The largest size of an integer component whose distances, summed over all parts, fit 64 bits with certainty."""
    width = 1 << (length // parts - 1).bit_length()
    return isqrt(((1 << 63) - 1) // (4 * width * width * parts))


def integers(vectors: DataFrame, key: str, column: str, others: list[str], parts: int, scale: int) -> tuple[DataFrame, int]:
    """``id, v`` (array of longs) and the other columns of the rows that take part, with the vectors' length."""
    good = vectors.where(finite(F.col(column))).select(
        F.col(key).alias("id"), F.col(column).cast("array<double>").alias("__v"), *others)
    sizes = good.groupBy(F.size("__v").alias("n")).count().where(F.col("n") > 0).orderBy(F.desc("count"), "n").first()
    length = sizes.n if sizes else parts
    if length % parts:
        raise ValueError(f"vectors of {length} components do not fall into {parts} equal parts")
    most = float(limit_of(length, parts))
    fits = (F.size("__v") == length) & F.forall("__v", lambda x: F.abs(x * scale) < most)
    return good.where(fits).select("id", F.transform("__v", lambda x: F.floor(x * scale)).alias("v"), *others), length


def _matrix(column, length: int) -> np.ndarray:
    """A batch's list column as a matrix; no list is null and all have this length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def train(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks for ``id, v``: they start as the vectors of the smallest ids, then ``rounds`` times each entry becomes
    the mean (rounded down) of the parts nearest to it; entries without parts stay.

    An id that several rows hold counts once, with its smallest vector; rows without id start no entry. Sums are made
    in each task and then by Spark, one row for each entry: a book of parts x entries x length numbers is all that
    reaches the driver or a task, whatever the table.
    """
    import pyarrow as pa

    seeds = (rows.where("id IS NOT NULL").groupBy("id").agg(F.min("v").alias("v")).orderBy("id").limit(entries).collect())
    part = length // parts
    book = np.array([r.v for r in sorted(seeds, key=lambda r: r.id)], np.int64).reshape(-1, parts, part).transpose(1, 0, 2)
    if not len(seeds):
        return Codebooks(book)
    for _ in range(rounds):

        def sums(batches, book=book):
            nearest = Nearest(book)
            total = np.zeros(book.shape, np.int64)
            count = np.zeros(book.shape[:2], np.int64)
            for batch in batches:
                vectors = _matrix(batch.column(0), length)
                codes, _ = nearest(vectors)
                for p in range(parts):
                    np.add.at(total[p], codes[:, p], vectors[:, p * part:(p + 1) * part])
                    count[p] += np.bincount(codes[:, p], minlength=book.shape[1])
            at, entry = np.nonzero(count)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(at, part)), pa.array(np.repeat(entry, part)), pa.array(np.tile(np.arange(part), len(at))),
                     pa.array(total[at, entry].ravel()), pa.array(np.repeat(count[at, entry], part))],
                    names=["part", "entry", "place", "total", "n"])

        merged = small_batches(rows.select("v")).mapInArrow(sums, "part long, entry long, place long, total long, n long").groupBy(
            "part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        book = book.copy()
        for r in merged:
            book[r.part, r.entry, r.place] = r.total // r.n
    return Codebooks(book)


def compress(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """Codes of vectors, ``<key>, code, error, label_error``, and the codebooks that decode them.

    A code has two hex digits for each part. ``error`` is the squared distance (in units of 1 / scale) between a
    vector's integers and its decoded ones, ``label_error`` its sum over the rows of an equal label (null is one).

    Left out are vectors that are null, empty, hold a null or non-finite component, are of another length than most,
    or hold a component so large (see ``limit_of``; from about 370,000 on for 64 components) that a distance might not fit 64
    bits. Rows that repeat one another are coded each, and count each for the means. Without any row that has an id
    there is no entry and the result is empty; fewer rows than entries make smaller books. Vectors are read once for
    the first entries, once a round and once for the codes; they are not shuffled, only labels are, in SALTS pieces.
    """
    import pyarrow as pa

    rows, length = integers(vectors, key, column, [F.col(label).alias("label")], parts, scale)
    kinds = dict(vectors.select(F.col(key).alias("id"), F.col(label).alias("label")).dtypes)
    schema = f"id {kinds['id']}, label {kinds['label']}, code string, error long"
    books = train(rows, length, parts, entries, rounds)
    book = books.entries

    def run(batches):
        nearest = Nearest(book)
        for batch in batches:
            codes, errors = nearest(_matrix(batch.column(1), length))
            texts = np.char.mod("%02x", codes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(["".join(t) for t in texts.tolist()]), pa.array(errors.sum(axis=1))],
                names=["id", "label", "code", "error"])

    coded = (small_batches(rows).mapInArrow(run, schema) if book.size else vectors.sparkSession.createDataFrame([], schema))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = coded.withColumn("__salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int")).join(
        sums.withColumnRenamed("label", "__label"),
        F.col("label").eqNullSafe(F.col("__label")) & (F.col("__salt") == F.col("salt")))
    return met.select(F.col("id").alias(key), "code", "error", "label_error"), books


def compress_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same over ``embeddings`` in DuckDB: every part against every entry of its book, in whole numbers."""
    steps = [f"""
kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
cut AS (SELECT vec_id, label, p, list_transform(embedding[p * (len(embedding) // {parts}) + 1:(p + 1) * (len(embedding) // {parts})],
  lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM kept, (SELECT unnest(range({parts})) AS p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}),
book0 AS (SELECT p, e, v FROM cut JOIN first USING (vec_id))"""]
    near = """
near{k} AS (SELECT vec_id, label, p, v, min(struct_pack(d := d, e := e)) AS best FROM (
  SELECT c.vec_id, c.label, c.p, c.v, b.e, CAST(list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
  FROM cut c JOIN book{k} b ON b.p = c.p) GROUP BY vec_id, label, p, v)"""
    for k in range(rounds):
        steps.append(near.format(k=k))
        steps.append(f"""
mean{k} AS (SELECT p, e, list(m ORDER BY i) AS v FROM (
  SELECT p, e, i, (s - ((s % n) + n) % n) // n AS m FROM (
    SELECT p, best.e AS e, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n
    FROM (SELECT p, best, v, unnest(range(1, len(v) + 1)) AS i FROM near{k}) GROUP BY p, best.e, i)) GROUP BY p, e),
book{k + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.e = b.e)""")
    steps.append(near.format(k=rounds))
    steps.append(f"""
coded AS (SELECT vec_id, label, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY vec_id, label),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})""")
    return "WITH" + ",".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, digest"""

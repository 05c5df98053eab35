"""Approximate search: cells, bands and codes that spare most of the multiplications of an exact scan.

Each ``search`` takes ``work``, an accumulator that adds up the pairs of vector and question multiplied in full.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from docquery.operators.search import (BLOCK, SCORE_DIGITS, Board, TileStore, _ids, _matrix, _same_dimension, _unit, best,
                                       cosines, every, scan, slack_of, with_vector, write_tiles)
from docquery.session import materialise

# Pairs under a key of a band, on average, from which whole matrices are multiplied key by key.
CROWD = 1024
# Vectors in a file of a band index, so that a scan has tasks whatever the files of the table.
FILE_ROWS = 1 << 14


def _has_length(vector_col: str):
    return F.exists(vector_col, lambda x: x != 0)


class IvfIndex:
    """Inverted-file index: each vector belongs to the cell of its nearest centre."""

    def __init__(self, model, metric: str = "cosine"):
        self.centres = np.array(model.clusterCenters(), dtype=np.float64)
        self.model = model
        self.metric = metric

    @classmethod
    def fit(cls, vectors: DataFrame, cells: int, vector_col: str = "embedding", metric: str = "cosine",
            seed: int = 7) -> "IvfIndex":
        rows = vectors.where(_has_length(vector_col)).select(array_to_vector(F.col(vector_col)).alias("features"))
        kmeans = KMeans(k=cells, seed=seed, maxIter=10, initSteps=2,
                        distanceMeasure="cosine" if metric == "cosine" else "euclidean")
        return cls(kmeans.fit(rows), metric)

    def assign(self, vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
        """Adds ``cell``; runs in the JVM, no shuffle. Vectors of length zero go with the first centre."""
        first = F.array(*[F.lit(float(x)) for x in self.centres[0]])
        placed = F.when(_has_length(vector_col), F.col(vector_col).cast("array<double>")).otherwise(first)
        out = self.model.setFeaturesCol("_f").setPredictionCol("cell").transform(
            vectors.withColumn("_f", array_to_vector(placed))
        )
        return out.drop("_f")

    def probes(self, questions: DataFrame, nprobe: int) -> DataFrame:
        """Adds ``query_cells``: the nprobe cells nearest to the question."""
        centres = self.centres
        cosine = self.metric == "cosine"

        @F.pandas_udf("array<int>")
        def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            unit = centres / np.linalg.norm(centres, axis=1, keepdims=True).clip(1e-12)
            for rows in batches:
                q = np.stack(rows.to_numpy()).astype(np.float64)
                # |q - c|^2 without the part that is the same for all centres
                gap = -(q @ unit.T) if cosine else (centres**2).sum(1) - 2 * (q @ centres.T)
                yield pd.Series(list(np.argsort(gap, axis=1, kind="stable")[:, :nprobe].astype(np.int32)))

        return questions.withColumn("query_cells", nearest("query_vector"))

    def write(self, vectors: DataFrame, path: str, vector_col: str = "embedding") -> None:
        """Index table laid out by cell, so a probe reads only its folders.

        Rebalancing splits a cell holding a third of all vectors over many tasks.
        """
        assigned = self.assign(vectors, vector_col)
        assigned.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)

    def search(self, index: DataFrame, questions: DataFrame, k: int, nprobe: int,
               id_col: str = "vec_id", vector_col: str = "embedding", work=None) -> DataFrame:
        """Questions are written by the cells they probe; a vector is multiplied with its own cell's questions only, and
        folders of cells that no question probes are not read."""
        probed = self.probes(with_vector(questions).select("query_id", "query_vector"), nprobe)
        files = write_tiles(probed.select("query_id", "query_vector", F.explode("query_cells").alias("cell")), "cell")
        metric = self.metric

        def score(board, tiles, batch):
            cells = batch.column(2).to_numpy(zero_copy_only=False)
            vectors, ids = _matrix(batch.column(1)), _ids(batch.column(0))
            for cell in np.unique(cells).tolist():
                own = cells == cell
                every(board, tiles, files.get(cell, []), vectors[own], ids[own], metric)

        # at most as many distinct cells as the index has centres
        pruned = index.where(F.col("cell").isin(sorted(files)))
        return best(scan(pruned, questions, ["cell"], score, k, id_col, vector_col, work=work), k, metric, id_col)


class HyperplaneIndex:
    """Locality-sensitive bands: the sign pattern under ``bits`` random planes, ``bands`` times over."""

    def __init__(self, dimension: int, bands: int = 16, bits: int = 6, seed: int = 7):
        self.bands, self.bits = bands, bits
        self.planes = np.random.default_rng(seed).normal(size=(bands, bits, dimension))

    def cells(self, vector_col: str):
        planes, bands, bits = self.planes, self.bands, self.bits

        @F.pandas_udf("array<int>")
        def band_keys(rows: pd.Series) -> pd.Series:
            m = np.stack(rows.to_numpy()).astype(np.float64)
            signs = (m @ planes.reshape(bands * bits, -1).T).reshape(len(m), bands, bits) >= 0
            codes = (signs * (1 << np.arange(bits))).sum(2)
            return pd.Series(list((codes + np.arange(bands) * (1 << bits)).astype(np.int32)))

        return band_keys(F.col(vector_col))

    def write(self, vectors: DataFrame, path: str, vector_col: str = "embedding") -> None:
        """Index table with the band keys stored beside the vectors; no shuffle."""
        vectors.withColumn("band_keys", self.cells(vector_col)).write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)

    def search(self, vectors: DataFrame, questions: DataFrame, k: int, metric: str = "cosine",
               id_col: str = "vec_id", vector_col: str = "embedding", work=None) -> DataFrame:
        """``vectors`` is the written index, or any vectors: then the keys are computed on the way.

        In each task the band keys of a block of vectors meet those of a tile of questions, and only pairs that share one
        are multiplied. Cosines are looked over as in an exact search: where many rows and questions lie under the keys,
        key by key in one product each, so a pair that shares several keys is multiplied again; else question by
        question with the rows under any of its keys, each pair once.
        """
        keys = F.col("band_keys") if "band_keys" in vectors.columns else self.cells(vector_col)
        index = vectors.where(F.col(vector_col).isNotNull()).select(id_col, vector_col, keys.alias("_keys"))
        asked = with_vector(questions).select("query_id", "query_vector", self.cells("query_vector").alias("query_keys"))
        files = write_tiles(asked).get(None, [])

        def score(board, tiles, batch):
            banded(board, tiles, files, _matrix(batch.column(1)), _ids(batch.column(0)),
                   _matrix(batch.column(2)).astype(np.int64), metric)

        columns = ("query_id", "query_vector", "query_keys")
        return best(scan(index, questions, ["_keys"], score, k, id_col, vector_col, columns, work, BLOCK), k, metric, id_col)


def banded(board: Board, tiles: TileStore, files: list[str], vectors: np.ndarray, ids: np.ndarray, keys: np.ndarray,
           metric: str) -> None:
    """Vectors against the questions that share a key with them."""
    listed, cosine = Postings(keys), metric == "cosine"
    if cosine:
        vectors = _unit(vectors)
        single = vectors.astype(np.float32)
        slack, whole = slack_of(vectors), not np.isnan(single).any()
    for file in files:
        tile = tiles[file]
        _same_dimension(vectors, tile.vectors)
        asked = _unit(tile.vectors) if cosine else tile.vectors
        if cosine:
            brief = asked.astype(np.float32)
            if whole and listed.crowded(tile.keys) and not np.isnan(brief).any():
                for band, rows, places in listed.shared(tile.keys):
                    def exact(r, c):
                        r, c = places[r], rows[c]
                        first = (tile.keys[r, :band] != keys[c, :band]).all(axis=1)  # else a band before has had the pair
                        scores = np.full(len(r), np.nan)
                        scores[first] = cosines(asked[r[first]], vectors[c[first]])
                        return scores

                    scores = brief.take(places, axis=0) @ single.take(rows, axis=0).T
                    board.matrix(tile.numbers[places], scores, ids[rows], slack, exact)
                continue
        for place, rows in enumerate(listed.sharing(tile.keys)):
            number = tile.numbers[place:place + 1]
            if cosine:
                scores = single.take(rows, axis=0) @ brief[place]
                board.matrix(number, scores[None], ids[rows], slack,
                             lambda r, c: cosines(asked[place + r], vectors[rows[c]]))
            else:
                scores = _pair_scores(vectors[rows], asked[place:place + 1], metric)
                board.matrix(number, scores[None], ids[rows])
            lost = rows[np.isnan(scores)]
            if len(lost):  # a score that is not a number fills a place that no other takes
                board.offer(np.repeat(number, len(lost)), np.full(len(lost), np.nan), ids[lost])


class Postings:
    """The rows of a block listed by their key in each band."""

    def __init__(self, keys: np.ndarray):
        self.rows = len(keys)
        self.order = [np.argsort(own, kind="stable") for own in keys.T]
        self.sorted = [own[order] for own, order in zip(keys.T, self.order)]

    def crowded(self, keys: np.ndarray) -> bool:
        """Whether the keys of some questions hold CROWD pairs each, on average."""
        pairs = sum(np.sum(np.searchsorted(own, asked, "right") - np.searchsorted(own, asked, "left"))
                    for own, asked in zip(self.sorted, keys.T))
        return bool(pairs >= CROWD * sum(len(np.unique(asked)) for asked in keys.T))

    def shared(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(band, rows, questions) under each key that has both."""
        for band, (own, order, asked) in enumerate(zip(self.sorted, self.order, keys.T)):
            theirs = np.argsort(asked, kind="stable")
            each, begins, count = np.unique(asked[theirs], return_index=True, return_counts=True)
            for low, high, begin, many in zip(*(x.tolist() for x in (
                    np.searchsorted(own, each, "left"), np.searchsorted(own, each, "right"), begins, count))):
                if low < high:
                    yield band, order[low:high], theirs[begin:begin + many]

    def sharing(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        """For each question the rows with an equal key in the same band, each once, ascending."""
        first, last = (np.array([np.searchsorted(own, asked, side) for own, asked in zip(self.sorted, keys.T)]).T
                       for side in ("left", "right"))
        marked = np.zeros(self.rows, bool)
        for begins, ends in zip(first.tolist(), last.tolist()):
            marked[:] = False
            for order, begin, end in zip(self.order, begins, ends):
                marked[order[begin:end]] = True
            yield np.flatnonzero(marked)


def _pair_scores(vectors: np.ndarray, questions: np.ndarray, metric: str) -> np.ndarray:
    """Row by row what ``_scores`` has for the pair."""
    if metric == "l2":
        return -np.round(np.linalg.norm(vectors - questions, axis=1), SCORE_DIGITS)
    if metric == "cosine":
        vectors, questions = _unit(vectors), _unit(questions)
    return cosines(vectors, questions)


class CompressedIndex:
    """Product quantisation: a vector is ``parts`` one-byte codes, a sixteenth of its bytes with four components a part.

    A question is compared with codes through tables of its scores with every entry; the best ``shortlist`` vectors are
    then scored exactly from the vectors themselves.
    """

    ENTRIES = 256

    def __init__(self, books: np.ndarray, metric: str = "cosine"):
        self.books, self.metric = books, metric  # parts x entries x components of a part

    @classmethod
    def fit(cls, vectors: DataFrame, parts: int, vector_col: str = "embedding", id_col: str = "vec_id",
            metric: str = "cosine", sample: int = 20_000, rounds: int = 10) -> "CompressedIndex":
        """Codebooks of at most 256 entries, one group of tasks for each part, from a bounded sample: the ``sample``
        vectors whose ids have the smallest hashes (fewer: all). Each book starts as evenly spaced sample rows."""
        usable = vectors.where(F.col(vector_col).isNotNull()).select(F.xxhash64(id_col).alias("_h"), F.col(vector_col).alias("_v"))
        rows = usable.orderBy("_h").limit(sample)
        unit = metric == "cosine"
        schema = "part int, entry int, centre array<double>"

        def learn(key, frame):
            own = np.stack(frame["piece"].to_numpy()).astype(np.float64)
            centres = own[np.linspace(0, len(own) - 1, min(cls.ENTRIES, len(own))).astype(int)]
            for _ in range(rounds):
                near = _nearest_entry(own, centres)
                count = np.bincount(near, minlength=len(centres))
                sums = np.stack([np.bincount(near, own[:, j], len(centres)) for j in range(own.shape[1])], axis=1)
                centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
            return pd.DataFrame({"part": key[0], "entry": np.arange(len(centres)), "centre": list(centres)})

        def cut(batches):
            for batch in batches:
                m = _matrix(batch.column(0))
                m = (_unit(m) if unit else m).reshape(len(m), parts, -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(parts, dtype=np.int32), len(m))), pa.array(list(m.reshape(len(m) * parts, -1)))],
                    names=["part", "piece"])

        pieces = rows.select("_v").mapInArrow(cut, "part int, piece array<double>")
        learned = pieces.groupBy("part").applyInPandas(learn, schema).orderBy("part", "entry").collect()
        if not learned:
            raise ValueError("no vector to learn from")
        return cls(np.array([r.centre for r in learned]).reshape(parts, -1, len(learned[0].centre)), metric)

    def encode(self, vector_col: str = "embedding"):
        """The codes of a vector column, one byte a part."""
        books, unit = self.books, self.metric == "cosine"

        @F.pandas_udf("binary")
        def codes(rows: pd.Series) -> pd.Series:
            m = np.stack(rows.to_numpy()).astype(np.float64)
            m = (_unit(m) if unit else m).reshape(len(m), len(books), -1)
            return pd.Series([c.tobytes() for c in np.stack(
                [_nearest_entry(m[:, p], book) for p, book in enumerate(books)], axis=1).astype(np.uint8)])

        return codes(F.col(vector_col))

    def write(self, vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
        """Ids and codes; no shuffle."""
        vectors.where(F.col(vector_col).isNotNull()).select(id_col, self.encode(vector_col).alias("code")).write.parquet(path)

    def tables(self, questions: np.ndarray) -> np.ndarray:
        """questions x parts x entries: what an entry adds to a question's score (for l2, minus the squared distance)."""
        cut = (_unit(questions) if self.metric == "cosine" else questions).reshape(len(questions), len(self.books), -1)
        products = np.einsum("qpd,ped->qpe", cut, self.books)
        if self.metric != "l2":
            return products
        return 2 * products - (self.books**2).sum(2)[None] - (cut**2).sum(2)[..., None]

    def search(self, codes: DataFrame, vectors: DataFrame, questions: DataFrame, k: int, shortlist: int = 100,
               id_col: str = "vec_id", vector_col: str = "embedding", work=None) -> DataFrame:
        """The best k of each question's ``shortlist``. Codes are scanned in place; vectors only meet the short lists."""
        asked = with_vector(questions).select("query_id", "query_vector")
        files = write_tiles(asked).get(None, [])
        index = self

        def rough(board, tiles, batch):
            own = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            ids = _ids(batch.column(0))
            for file in files:
                tile = tiles[file]
                for low in range(0, len(tile.numbers), 64):
                    tables = index.tables(tile.vectors[low:low + 64]).transpose(1, 2, 0)
                    scores = np.zeros((len(own), tables.shape[2]))
                    for part, table in enumerate(tables):
                        scores += table[own[:, part]]
                    board.matrix(tile.numbers[low:low + 64], np.ascontiguousarray(scores.T), ids)

        listed = materialise(best(scan(codes, questions, [], rough, shortlist, id_col, "code"), shortlist, "dot", id_col)
                             .select("query_id", id_col), "shortlist")
        met = (vectors.select(id_col, vector_col).join(listed, id_col)
               .join(asked.select(F.col("query_id").alias("_q"), "query_vector"), F.col("query_id").eqNullSafe(F.col("_q"))))
        metric = self.metric
        q_type, v_type = (df.schema[c].dataType.simpleString() for df, c in ((questions, "query_id"), (vectors, id_col)))

        def exact(batches):
            for batch in batches:
                if work is not None:
                    work.add(batch.num_rows)
                scores = _pair_scores(_matrix(batch.column(2)), _matrix(batch.column(3)), metric)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], names=["query_id", id_col, "_s"])

        scored = met.select("query_id", id_col, vector_col, "query_vector").mapInArrow(
            exact, f"query_id {q_type}, `{id_col}` {v_type}, _s double")
        return best(scored, k, metric, id_col)


def _nearest_entry(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    lengths = (entries**2).sum(1)
    return np.concatenate([np.zeros(0, np.int64), *[
        (lengths - 2 * (rows[low:low + 4096] @ entries.T)).argmin(1) for low in range(0, len(rows), 4096)]])


def check_dimension(vectors: DataFrame, dimension: int, vector_col: str = "embedding") -> DataFrame:
    """Fail the job on the first vector whose length is not ``dimension``; no extra pass."""
    ok = F.size(vector_col) == dimension
    return vectors.withColumn(
        vector_col,
        F.when(ok, F.col(vector_col)).otherwise(
            F.raise_error(F.concat(F.lit("vector of dimension "), F.size(vector_col).cast("string")))
            .cast("array<float>")),
    )

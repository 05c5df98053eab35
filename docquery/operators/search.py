"""Top-k vector search.

The corpus stays where it lies. Questions are written to the shared folder in tiles; each scan task opens the tiles one
after another, scores its vectors against them and keeps the best k per question, so the exchange carries at most
``partitions x questions x k`` rows and memory holds one block of vectors, a bounded store of tiles and those best rows.
More than SCAN_ROWS questions take a scan for each so many, so the best rows a task keeps are bounded, too. Cosines are looked over in single precision, and only pairs that may be among the best
k get their score, in double precision. Indexes narrow the tiles that a vector meets (see ``index.py``).
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from docquery.functions.windows import top_per_key
from docquery.session import materialise, scratch_path
from docquery.sources.shared import read_columns

# Questions of a tile (a file), and how many of them are scored at once.
TILE_ROWS = 4096
STRIP = 256
# Questions that an exact scan of the vectors meets.
SCAN_ROWS = 1 << 16
# Vectors scored at once, and bytes of vectors that meet a tile each time it is opened.
ROWS = 4096
BLOCK = 16 << 20
# Pairs whose exact scores are taken at once.
EXACT = 1 << 13
# Bytes of tiles that a task keeps open.
TILE_STORE = 128 << 20
# Rows that wait on a board before they are cut to the best k per question.
PENDING = 1 << 19
# Scores are compared after rounding, then ties fall to the smaller key.
SCORE_DIGITS = 9
METRICS = ("cosine", "dot", "l2")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = len(column)
    if rows and flat.size % rows:
        raise ValueError("vectors of different dimension")
    return flat.reshape(rows, -1) if rows else np.empty((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _same_dimension(vectors: np.ndarray, questions: np.ndarray) -> None:
    if vectors.shape[1] != questions.shape[1]:
        raise ValueError(f"index dimension {vectors.shape[1]}, question dimension {questions.shape[1]}")


def _scores(vectors: np.ndarray, questions: np.ndarray, metric: str) -> np.ndarray:
    """Larger is nearer; L2 distance is negated."""
    _same_dimension(vectors, questions)
    if metric == "cosine":
        return np.round(_unit(vectors) @ _unit(questions).T, SCORE_DIGITS)
    if metric == "dot":
        return np.round(vectors @ questions.T, SCORE_DIGITS)
    gaps = (
        (vectors**2).sum(1)[:, None] - 2.0 * (vectors @ questions.T) + (questions**2).sum(1)[None, :]
    )
    return -np.round(np.sqrt(np.maximum(gaps, 0.0)), SCORE_DIGITS)


def cosines(vectors: np.ndarray, questions: np.ndarray) -> np.ndarray:
    """Cosines of unit vectors, row by row."""
    return np.round(np.einsum("ij,ij->i", vectors, questions), SCORE_DIGITS)


def slack_of(vectors: np.ndarray) -> float:
    """Twice the most that rounding to single precision can add up to over the products of two unit vectors."""
    return 2.0 * (vectors.shape[1] + 8) * 2.0**-24


@dataclass
class Tile:
    """Some questions: their numbers on the task's board, vectors, and band keys where an index has them."""

    numbers: np.ndarray
    vectors: np.ndarray
    keys: np.ndarray | None = None


@dataclass
class Board:
    """The best k rows per question seen so far in one task."""

    k: int
    names: dict = field(default_factory=dict)  # question to number
    pairs: int = 0  # vectors multiplied with questions

    def __post_init__(self):
        # at most the k-th best score so far: a row below it cannot enter
        self.floor = np.full(0, -np.inf)
        self.top = np.full((0, self.k), -np.inf)  # the best scores so far, in no order
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def enrol(self, questions: list) -> np.ndarray:
        numbers = np.array([self.names.setdefault(q, len(self.names)) for q in questions], np.int64)
        fresh = len(self.names) - len(self.floor)
        if fresh:
            self.floor = np.append(self.floor, np.full(fresh, -np.inf))
            self.top = np.append(self.top, np.full((fresh, self.k), -np.inf), axis=0)
        return numbers

    def offer(self, numbers: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(numbers):
            self.rows.append((numbers, scores, ids))
            self.pending += len(numbers)
            if self.pending > PENDING + len(self.names) * self.k:
                self.cut()

    def cut(self) -> None:
        if self.pending:
            numbers, scores, ids = (np.concatenate(c) for c in zip(*self.rows))
            order = np.lexsort((ids, -scores, numbers))
            numbers = numbers[order]
            begins = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
            place = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
            keep = order[place < self.k]
            self.rows = [(numbers[place < self.k], scores[keep], ids[keep])]
            last = place == self.k - 1
            self.floor[numbers[last]] = np.nan_to_num(scores[order[last]], nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        self.pending = 0

    def matrix(self, numbers: np.ndarray, scores: np.ndarray, ids: np.ndarray, slack: float = 0.0, exact=None) -> None:
        """Every question (row) against every vector (column).

        With ``exact`` the scores are off by less than ``slack``; it gives the right ones for rows and columns of pairs.
        """
        self.pairs += scores.size
        width, many = scores.shape[1], 8 * self.k
        if width > many:
            self.lift(numbers, scores, np.flatnonzero(np.isneginf(self.floor[numbers])), slack)
        found = self.above(numbers, scores, slack)
        crowded = np.flatnonzero(np.bincount(found // width, minlength=len(numbers)) > many) if len(found) > many else []
        if len(crowded):
            self.lift(numbers, scores, crowded, slack)
            found = self.above(numbers, scores, slack)
        row, column = found // width, found % width
        if exact is None:
            self.offer(numbers[row], scores[row, column], ids[column])
            return
        for low in range(0, len(row), EXACT):
            r, c = row[low:low + EXACT], column[low:low + EXACT]
            right = exact(r, c)
            kept = right >= self.floor[numbers[r]]
            r, right = r[kept], right[kept]
            self.offer(numbers[r], right, ids[c[kept]])
            self.raise_floors(numbers, r, right)

    def raise_floors(self, numbers: np.ndarray, row: np.ndarray, scores: np.ndarray) -> None:
        """Put scores among the best of their questions (``row`` ascending)."""
        if len(row):
            some, begins, count = np.unique(row, return_index=True, return_counts=True)
            wide = np.full((len(some), self.k + count.max()), -np.inf)
            own = numbers[some]
            wide[:, :self.k] = self.top[own]
            place = np.arange(len(row)) - np.repeat(begins, count)
            wide[np.repeat(np.arange(len(some)), count), self.k + place] = scores
            wide.partition(wide.shape[1] - self.k, axis=1)
            best = wide[:, wide.shape[1] - self.k:]
            self.top[own] = best
            self.floor[own] = np.maximum(self.floor[own], best[:, 0])

    def above(self, numbers: np.ndarray, scores: np.ndarray, slack: float) -> np.ndarray:
        """Places of the (flattened) scores that may enter."""
        bar = (self.floor[numbers] - slack).astype(scores.dtype)
        return np.flatnonzero(scores >= bar[:, None])

    def lift(self, numbers: np.ndarray, scores: np.ndarray, some: np.ndarray, slack: float) -> None:
        """Raise the floors of some questions (rows) to their k-th best score here."""
        if len(some):
            own = scores[some]
            own[np.isnan(own)] = -np.inf
            least = np.partition(own, own.shape[1] - self.k, axis=1)[:, own.shape[1] - self.k] - slack
            self.floor[numbers[some]] = np.maximum(self.floor[numbers[some]], least)

    def table(self, names, types) -> pa.RecordBatch:
        self.cut()
        numbers, scores, ids = self.rows[0] if self.rows else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        questions = list(self.names)
        return pa.RecordBatch.from_arrays(
            [pa.array([questions[n] for n in numbers.tolist()], types[0]), pa.array(ids.tolist(), types[1]),
             pa.array(scores, pa.float64())], names=names)


class TileStore:
    """Tiles by file, the last used ones kept up to TILE_STORE bytes."""

    def __init__(self, board: Board, columns: list[str]):
        self.board, self.columns = board, columns
        self.kept: OrderedDict[str, tuple[Tile, int]] = OrderedDict()
        self.bytes = 0

    def __getitem__(self, path: str) -> Tile:
        if path not in self.kept:
            table = read_columns(path, self.columns)
            vectors = _matrix(table["query_vector"])
            keys = _matrix(table["query_keys"]).astype(np.int64) if "query_keys" in self.columns else None
            tile = Tile(self.board.enrol(table["query_id"].to_pylist()), vectors, keys)
            self.kept[path] = tile, vectors.nbytes + (keys.nbytes if keys is not None else 0)
            self.bytes += self.kept[path][1]
            while self.bytes > TILE_STORE and len(self.kept) > 1:
                self.bytes -= self.kept.popitem(last=False)[1][1]
        self.kept.move_to_end(path)
        return self.kept[path][0]


def _ids(column) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def with_vector(questions: DataFrame) -> DataFrame:
    """The questions that can be searched for: those without a vector find nothing."""
    return questions.where(F.col("query_vector").isNotNull())


def write_tiles(questions: DataFrame, cell: str | None = None) -> dict:
    """Write questions in files of at most TILE_ROWS; returns the files (by cell, or all under None)."""
    spark = questions.sparkSession
    path = scratch_path(spark, "questions")
    writer = questions.hint("rebalance", cell) if cell else questions
    writer = writer.write.option("maxRecordsPerFile", TILE_ROWS)
    (writer.partitionBy(cell) if cell else writer).parquet(path)
    files: dict = {}
    for file in spark.read.schema(questions.schema).parquet(path).inputFiles():
        files.setdefault(int(file.rpartition(f"/{cell}=")[2].partition("/")[0]) if cell else None, []).append(file)
    return files


def top_k(vectors: DataFrame, questions: DataFrame, k: int, metric: str = "cosine",
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Nearest k vectors per question: (query_id, <id_col>, score, rank), rank 1 = best.

    ``questions`` has query_id and query_vector; it is evaluated once, whatever its size. Vectors that are NULL take no
    part; those of another length than the questions fail the job.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    files = write_tiles(with_vector(questions).select("query_id", "query_vector")).get(None, [])

    def scanned(files: list[str]) -> DataFrame:
        def score(board, tiles, batch):
            every(board, tiles, files, _matrix(batch.column(1)), _ids(batch.column(0)), metric)

        return scan(vectors, questions, [], score, k, id_col, vector_col, block=BLOCK)

    parts = [scanned(some) for some in by_scan(questions.sparkSession, files)]
    return best(reduce(DataFrame.union, parts), k, metric, id_col)


def by_scan(spark, files: list[str]) -> list[list[str]]:
    """Files of questions in groups of at most SCAN_ROWS rows, one group at least."""
    if len(files) * TILE_ROWS <= SCAN_ROWS:
        return [files]
    rows = dict(spark.read.parquet(*files).groupBy(F.input_file_name()).count().collect())
    groups, held = [[]], 0
    for file in files:
        if groups[-1] and held + rows.get(file, TILE_ROWS) > SCAN_ROWS:
            groups.append([])
            held = 0
        groups[-1].append(file)
        held += rows.get(file, TILE_ROWS)
    return groups


def every(board: Board, tiles: TileStore, files: list[str], vectors: np.ndarray, ids: np.ndarray, metric: str) -> None:
    coarse = metric == "cosine"
    if coarse:
        vectors = _unit(vectors)
        single = vectors.astype(np.float32)
        slack = slack_of(vectors)
    for file in files:
        tile = tiles[file]
        for low in range(0, len(tile.numbers), STRIP):
            numbers, asked = tile.numbers[low:low + STRIP], tile.vectors[low:low + STRIP]
            if coarse:
                _same_dimension(vectors, asked)
                asked = _unit(asked)
                brief = asked.astype(np.float32)
            for begin in range(0, len(vectors), ROWS):
                own = vectors[begin:begin + ROWS]
                if coarse:
                    exact = lambda r, c: cosines(asked[r], own[c])
                    board.matrix(numbers, brief @ single[begin:begin + ROWS].T, ids[begin:begin + ROWS], slack, exact)
                else:
                    board.matrix(numbers, np.ascontiguousarray(_scores(own, asked, metric).T), ids[begin:begin + ROWS])


def scan(vectors: DataFrame, questions: DataFrame, others: list[str], score, k: int, id_col: str, vector_col: str,
         columns: tuple[str, ...] = ("query_id", "query_vector"), work=None, block: int = 0) -> DataFrame:
    """(query_id, <id_col>, _s): what ``score`` offers to each task's board; ``work`` adds up the pairs it multiplied.

    Batches are put together up to ``block`` bytes, so tiles beyond the store are opened once for many vectors.
    """
    q_type, v_type = questions.schema["query_id"].dataType, vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField("query_id", q_type), T.StructField(id_col, v_type), T.StructField("_s", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_type

    types, names = (to_arrow_type(q_type), to_arrow_type(v_type)), schema.fieldNames()

    def run(batches):
        board = Board(k)
        tiles = TileStore(board, list(columns))
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
                if size >= block:
                    score(board, tiles, pa.Table.from_batches(held).combine_chunks())
                    held, size = [], 0
        if held:
            score(board, tiles, pa.Table.from_batches(held).combine_chunks())
        if work is not None:
            work.add(board.pairs)
        yield board.table(names, types)

    return vectors.select(id_col, vector_col, *others).where(F.col(vector_col).isNotNull()).mapInArrow(run, schema)


def best(scored: DataFrame, k: int, metric: str, id_col: str) -> DataFrame:
    """The best k of all tasks, with their distance or similarity."""
    ranked = top_per_key(scored, ["query_id"], [F.desc("_s"), F.col(id_col)], k)
    return ranked.select("query_id", id_col, (-F.col("_s") if metric == "l2" else F.col("_s")).alias("score"), "rank")


def keep_unanswered(questions: DataFrame, hits: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """A question without a hit keeps one row with NULLs instead of vanishing."""
    return questions.select("query_id").join(hits, "query_id", "left").select("query_id", id_col, "score", "rank")


def hits_with_documents(hits: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Hits are written first, so the join knows their real size: where they are few, the corpus is scanned once for the
    needed columns and not shuffled; where they are many, both sides are dealt by key."""
    return docs.join(materialise(hits, "hits"), key)

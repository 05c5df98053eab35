"""Removal of long repeated byte strings by suffixes: cover-sample names file suffixes in buckets, ties are sorted there.

A suffix counts by its first ``length`` bytes (a window). The cover sample is content-defined, the counterpart of a
difference cover for texts whose alignment is unknown: of each window it holds the gram with the smallest hash, so equal
windows hold equal sample grams at equal offsets, and neighbouring windows share theirs. The sample's name is the
bucket. A bucket's suffixes come as runs (neighbouring windows with one sample gram) and are settled run by run; only
where a bucket holds different runs, or one that repeats itself, are its windows compared one by one.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from docquery.llm.common import map_rows, per_worker, small_batches
from docquery.session import materialise

LENGTH = 100  # bytes of a repeated string
GRAM = 37  # bytes of a sample gram; a window has LENGTH - GRAM + 1 of them
CHUNK = 1 << 18  # windows of a text handled at once
GROUP = 8 << 20  # bytes of text whose runs are pre-aggregated in a task
GROUP_ENTRIES = 400_000  # and the most entries
NO_ID = -(1 << 63)
# A run's place: 31 bits of start, 16 of length, 1 of self-repeat. Its text is named by doc and row (the text's hash).
LENGTH_BITS, START_BITS = 16, 31


class Hashes:
    """Rolling hashes that name sample grams: prefix sums modulo 2^64 of random values times powers.

    Equal grams have equal names; other grams may share one only at the cost of a mixed bucket. Whether strings are
    equal is never judged by these, which long patterned strings can fool, but by ``contents``.
    """

    def __init__(self, size: int = CHUNK + LENGTH + 1):
        random = np.random.default_rng(20)
        self.table = random.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.powers = np.full(size, 0x9E3779B97F4A7C15, np.uint64)
        self.powers[0] = 1
        self.powers = np.multiply.accumulate(self.powers)
        self.size = size

    def sums(self, data: np.ndarray) -> np.ndarray:
        values = self.table[data] * self.powers[:len(data)]
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])

    def of(self, sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [first, end): shifted to one power, then mixed."""
        value = (sums[end] - sums[first]) * self.powers[self.size - 1 - first]
        value ^= value >> np.uint64(32)
        value *= np.uint64(0xD6E8FEB86659FD93)
        return value ^ value >> np.uint64(29)


class WindowHashes:
    """Polynomial hashes of windows modulo two primes of 31 bits, at bases drawn once: 62 bits in all.

    Modulo a prime two different windows agree for at most ``length`` of all bases, whatever their pattern.
    """

    PRIMES = (2147483647, 2147483629)

    def __init__(self, size: int = (1 << LENGTH_BITS) + LENGTH):
        random = np.random.default_rng(21)
        self.size, self.powers = size, []
        for prime in self.PRIMES:
            base, powers = int(random.integers(1 << 30, prime)), np.ones(1, np.uint64)
            while len(powers) < size:
                step = np.uint64(pow(base, len(powers), prime))
                powers = np.concatenate([powers, powers * step % np.uint64(prime)])
            self.powers.append(powers[:size])

    def __call__(self, part: np.ndarray, length: int) -> np.ndarray:
        """Of each window of ``length`` bytes of a part of at most ``size``."""
        at = np.arange(len(part) - length + 1)
        out = np.zeros(len(at), np.uint64)
        values = part.astype(np.uint64) + np.uint64(1)
        for prime, powers in zip(map(np.uint64, self.PRIMES), self.powers):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[:len(part)] % prime)])
            own = (sums[at + length] - sums[at]) % prime * powers[self.size - 1 - at] % prime
            out = out << np.uint64(31) | own
        return out.view(np.int64)


def contents(data: bytes, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH3 of each [first, end) of the bytes: no sum over places, so no pattern of a text makes two of them meet."""
    from xxhash import xxh3_64_intdigest

    return np.array([xxh3_64_intdigest(data[a:b], 20) for a, b in zip(first.tolist(), end.tolist())], np.uint64).view(np.int64)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:len(values)] = values
    cells = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(cells, axis=1).ravel()
    behind = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1:width - 1 + count])


def runs(data: bytes, hashes: Hashes, length: int = LENGTH, gram: int = GRAM):
    """Name, content hash, start, number of windows and self-repeat flag of each run of windows with one sample gram."""
    width = length - gram + 1
    whole = np.frombuffer(data, np.uint8)
    for low in range(0, len(whole) - length + 1, CHUNK):
        part = whole[low:low + CHUNK + length - 1]
        one = hashes.sums(part)
        at = np.arange(len(part) - gram + 1)
        grams = hashes.of(one, at, at + gram)
        names = sliding_minimum(grams, width)
        starts = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
        # a run's place holds its length in 16 bits
        if len(starts) == 1 or np.diff(np.append(starts, len(names))).max() >= 1 << LENGTH_BITS:
            starts = np.union1d(starts, np.arange(0, len(names), (1 << LENGTH_BITS) - 1))
        counts = np.diff(np.append(starts, len(names)))
        name = names[starts]
        lanes = np.arange(width)
        left = starts + (grams[starts[:, None] + lanes] == name[:, None]).argmax(axis=1)
        last = starts + counts - 1
        right = last + width - 1 - (grams[last[:, None] + lanes[::-1]] == name[:, None]).argmax(axis=1)
        starts += low
        yield name.view(np.int64), contents(data, starts, starts + counts + length - 1), starts, counts, left != right


def _place(starts: np.ndarray, counts: np.ndarray, again: np.ndarray) -> np.ndarray:
    return (starts << LENGTH_BITS | counts) << 1 | again


def _repeats(keys: list[np.ndarray], *place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries without copies (equal key and place: fully repeated rows), and which of them have an equal key at
    an earlier place (columns, most significant first) among these."""

    def as_before(columns, order):
        same = np.ones(len(order) - 1, bool)
        for column in columns:
            ordered = column[order]
            same &= ordered[1:] == ordered[:-1]
        return np.append(False, same)

    order = np.lexsort((*place[::-1], *keys[::-1]))
    order = order[~as_before((*keys, *place), order)]
    return order, as_before(keys, order)


ENTRIES = "h1 long, h2 long, doc long, row long, place long, later boolean"
NAMES = ["h1", "h2", "doc", "row", "place", "later"]


def _entries(rows: DataFrame, find) -> DataFrame:
    """Hash pairs with their places; ``later``: an equal one lies earlier in the same few megabytes of text (no hashes).

    That is the map-side sum of this search: a string in a third of all documents is shuffled once for each group of
    texts instead of once for each document.
    """

    def run(batches):
        import pyarrow as pa

        hashes, held, size, count = Hashes(), [], 0, 0

        def flush():
            h1, h2, doc, row, place = (np.concatenate(c) for c in zip(*held))
            kept, later = _repeats([h1, h2], doc, row, place)
            # what repeats an earlier entry is settled: it goes on without its hashes
            names = (np.where(later, 0, h[kept]) for h in (h1, h2))
            return pa.RecordBatch.from_arrays(
                [*map(pa.array, names), *(pa.array(c[kept]) for c in (doc, row, place)), pa.array(later)], names=NAMES)

        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                for h1, h2, place in find(hashes, *values[2:]):
                    held.append((h1, h2, *(np.full(len(h1), v, np.int64) for v in values[:2]), place))
                    count += len(h1)
                    if count >= GROUP_ENTRIES:
                        yield flush()
                        held, size, count = [], 0, 0
                size += len(values[2])
                if size >= GROUP and held:
                    yield flush()
                    held, size, count = [], 0, 0
        if held:
            yield flush()

    return small_batches(rows).mapInArrow(run, ENTRIES)


def _ranked(entries: DataFrame) -> DataFrame:
    """A bucket's entries in one place, sorted by content and place; equal ones numbered (streamed, with spill).

    Copies of an entry (fully repeated rows, met in different tasks) have one number: none is earlier than another.
    Entries already known to repeat an earlier one need no bucket: they are dealt out by their own place.
    """
    bucket = F.when(F.col("later"), F.xxhash64("doc", "row", "place")).otherwise(F.col("h1"))
    same = Window.partitionBy("bucket", "h2").orderBy("doc", "row", "place")
    return (entries.withColumn("bucket", bucket).repartition("bucket").withColumn("nth", F.dense_rank().over(same))
            .withColumn("covered", F.col("later") | (F.col("nth") > 1)))


def _settled(entries: DataFrame) -> DataFrame:
    """``contested``: first of its content in a bucket that holds others (or repeats itself); ``covered``: not first."""
    whole = Window.partitionBy("bucket")
    return (_ranked(entries)
            .withColumn("mixed", F.min("h2").over(whole) != F.max("h2").over(whole))
            .select("doc", "row", "place", "covered", (~F.col("covered") & (F.col("mixed") | (F.col("place") % 2 != 0)))
                    .alias("contested"))
            .where("covered OR contested"))


def _by_text(places: DataFrame) -> DataFrame:
    """One row for each text with its places (at most as many as it has bytes)."""
    return places.groupBy("doc", "row").agg(F.collect_set("place").alias("places"))


def _joined(texts: DataFrame, places: DataFrame, how: str) -> DataFrame:
    marked = _by_text(places).withColumnsRenamed({"doc": "__doc", "row": "__row"})
    return texts.join(marked.hint("shuffle_hash"),
                      (F.col("doc") == F.col("__doc")) & (F.col("row") == F.col("__row")), how)


def _spans(places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    starts = places >> (LENGTH_BITS + 1) & ((1 << START_BITS) - 1)
    return starts, starts + (places >> 1 & ((1 << LENGTH_BITS) - 1)) + length - 1


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, text, spans``: each row's bytes and its maximal runs of bytes that repeat something earlier.

    A byte is covered if a string of ``length`` bytes that holds it also starts earlier: in a smaller doc_id, or
    earlier in the same text. Null texts are empty; strings never cross documents. Rows that repeat a doc_id with
    another text follow each other by text hash and are documents of their own; fully repeated rows count as one
    document and come back alike; rows without doc_id come before all others. An empty table gives an empty result.

    Equality is that of a run's 64-bit XXH3, or of a window's hashes modulo two primes, and of the sample gram's name. Shuffled are: one narrow
    row for each run (about 32 windows), texts twice (for contested runs, for the result), and one row for each
    window of contested runs. All of it is by hash; equal strings are reduced in each task before.
    """
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
                        F.xxhash64("text").alias("row"),
                        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))

    def of_text(hashes, text):
        for name, content, starts, counts, again in runs(text, hashes, length, gram):
            yield name, content, _place(starts, counts, again)

    def of_windows(hashes, text, places):
        data = np.frombuffer(text, np.uint8)
        windows = per_worker("suffix-windows", WindowHashes)
        starts, ends = _spans(np.array(places), length)
        for first, end in zip(starts.tolist(), ends.tolist()):
            at = np.arange(end - first - length + 1)
            one = hashes.sums(data[first:first + length])
            grams = np.arange(length - gram + 1)
            name = hashes.of(one, grams, grams + gram).min()  # of the run, as all its windows share it
            yield (np.full(len(at), name).view(np.int64), windows(data[first:end], length),
                   _place(at + first, np.ones(len(at), np.int64), np.zeros(len(at), np.int64)))

    settled = materialise(_settled(_entries(texts, of_text)), "runs")
    asked = settled.where("contested").select("doc", "row", "place")
    distinct = _joined(texts, asked, "inner").select("doc", "row", "text", "places")
    repeated = _ranked(_entries(distinct, of_windows)).where("covered")
    covered = settled.where("covered").select("doc", "row", "place").union(
        repeated.select("doc", "row", "place"))
    marked = _joined(texts, covered, "left").select("doc", "text", "places")

    def make():
        def row(doc, text, places):
            if not places:
                return (None if doc == NO_ID else doc), text, []
            starts, ends = _spans(np.array(places), length)
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], np.maximum.accumulate(ends[order])
            new = np.append(True, starts[1:] > ends[:-1])
            last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
            return ((None if doc == NO_ID else doc), text,
                    [{"first": int(a), "end": int(b)} for a, b in zip(starts[new], ends[last])])

        return row

    return map_rows(marked, f"doc_id {kind}, text binary, spans array<struct<first: long, end: long>>", make)


def remove_repeats(docs: DataFrame, length: int = LENGTH, columns: str = "text binary", row=None) -> DataFrame:
    """``doc_id`` and the text without its repeated bytes, or what ``row`` makes of (bytes, spans, kept bytes)."""
    row = row or (lambda text, spans, kept: (kept,))

    def make():
        def one(doc_id, text, spans):
            kept, at = [], 0
            for span in spans:
                kept.append(text[at:span["first"]])
                at = span["end"]
            kept.append(text[at:])
            return doc_id, *row(text, spans, b"".join(kept))

        return one

    return map_rows(repeated_spans(docs, length), f"doc_id {dict(docs.dtypes)['doc_id']}, {columns}", make)


DIGESTS = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digests(text: bytes, spans: list, kept: bytes) -> tuple:
    return len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()

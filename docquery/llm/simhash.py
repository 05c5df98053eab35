"""SimHash near-dedup: fingerprints that meet in the middle of a small ball are verified and linked."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from docquery.llm.common import map_rows
from docquery.llm.components import components
from docquery.session import materialise

BITS = 64
PIECE = 1 << 16  # shingles whose bits are summed at once


def shingle_hashes(text: bytes, words: int, seed: int = 42):
    """The shingles' XXH64 values in order, with repeats, in pieces; a text of fewer words is one shingle, no word: none."""
    from xxhash import xxh64_intdigest

    tokens = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return
    shingles = max(1, len(tokens) - words + 1)
    width = min(words, len(tokens))
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    for low in range(0, shingles, PIECE):
        high = min(low + PIECE, shingles)
        yield np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(
            starts[low:high].tolist(), (ends[low + width - 1:high + width - 1] - 1).tolist())], np.uint64)


def fingerprint(text: bytes, words: int, seed: int = 42) -> int:
    """A bit is set if over half of the shingles' XXH64 values have it; no word: zero."""
    return majority(shingle_hashes(text, words, seed))


def majority(pieces) -> int:
    """The bits that over half of all hashes have."""
    votes, shingles = np.zeros(BITS, np.int64), 0
    for hashes in pieces:
        shingles += len(hashes)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(votes * 2 > shingles, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """``doc_id, __row, fp``: a row for each row; ``__row`` tells texts that repeat a doc_id apart."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("__row"), F.col("text").cast("binary").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    return map_rows(rows, f"doc_id {kind}, __row long, fp long",
                    lambda: lambda doc_id, row, text: (doc_id, row, fingerprint(text or b"", words)))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _masks(radius: int) -> tuple[list[int], list[int]]:
    """Variants that every fingerprint files itself under, and those under which one of even weight looks besides."""
    bit = [1 << k for k in range(BITS)]
    if radius == 0:
        return [0], []
    if radius == 1:
        return [0], bit  # the neighbour itself, one step from the even one
    if radius == 2:
        return bit, [0]
    if radius == 3:
        # of three places two lie in one half: only pairs inside a half are needed
        halves = [bit[:BITS // 2], bit[BITS // 2:]]
        return bit, [0, *(a | b for half in halves for a, b in combinations(half, 2))]
    raise ValueError("radius 0 to 3")


def near_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp`` whose components are those of all pairs within ``radius``.

    Two fingerprints within the radius share a variant no further than half of it from either. Fingerprints of the
    same weight parity differ in an even number of bits and meet one step from both; others differ in an odd number,
    and there it is enough that the odd one steps once and the even one twice (or not at all). So an odd fingerprint
    makes 64 variants and an even one 1,057, instead of 2,081 each.

    All holders of a variant are linked to its smallest holder: each link is verified by its bit count, and those
    that stay connect the same groups as all pairs would, since holders of one step each are within two bits of each
    other and every pair of odd and even holders meets at a variant whose odd holders are linked. A variant has at
    most 65 holders one step away, whatever the table: no group grows with the data.
    """
    step, reach = _masks(radius)
    # variants are many and fingerprints small: they are spread before they fan out
    cells = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = fps.select("fp").distinct().repartition(cells, F.xxhash64("fp"))
    array = lambda masks: "array(" + ",".join(f"{_signed(m)}L" for m in masks) + ")"
    even = F.bit_count("fp") % 2 == 0
    filed = distinct.select("fp", F.explode(F.expr(array(step))).alias("mask"))
    smallest = (filed.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
                .groupBy("variant").agg(F.min("fp").alias("holder")))
    sought = distinct.select("fp", F.explode(
        F.when(even, F.expr(array([*step, *reach]))).otherwise(F.expr(array(step)))).alias("mask"))
    # dealt out by variant, but sent as fingerprint and mask, which repeat and so compress better
    variant = F.col("fp").bitwiseXOR(F.col("mask"))
    met = (sought.repartition(variant).select("fp", variant.alias("variant"))
           .join(smallest.hint("shuffle_hash"), "variant"))
    return (met.where((F.col("fp") != F.col("holder"))
                      & (F.bit_count(F.col("fp").bitwiseXOR(F.col("holder"))) <= radius))
            .select(F.col("fp").alias("a"), F.col("holder").alias("b")).distinct())


def near_groups(docs: DataFrame, words: int = 5, radius: int = 3) -> DataFrame:
    """``doc_id, __row, fp, component_id, root``: the smallest doc_id that links, over any number of steps, lead to.

    ``root`` names the group itself (its smallest fingerprint): groups that hold texts of one doc_id share its
    ``component_id`` and differ by ``root``.

    Fingerprints are taken over whole texts: lower-cased A-Z, ASCII white space, shingles of ``words`` words with
    their repeats; a shorter text is one shingle, a text without words (null too) has fingerprint zero. Copies share
    a fingerprint and are one node, so a group of copies costs one row in the search, however large. Rows without
    doc_id take part and never name a group; a group of such rows alone has a null id. One row for each input row;
    an empty table gives an empty result.
    """
    stored = materialise(fingerprints(docs, words), "fingerprints")
    firsts = stored.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(near_links(firsts, radius))
    named = firsts.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    groups = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.join(groups, "root").select("fp", "component_id", "root")
    return stored.join(by_fp, "fp").select("doc_id", "__row", "fp", "component_id", "root")


def keep_first(docs: DataFrame, words: int = 5, radius: int = 3) -> DataFrame:
    """The row of each near-duplicate group that has the smallest doc_id (then the smallest text hash), all columns.

    Fully repeated rows count as copies: one stays. Rows without doc_id stay only where no other row of the group has one.
    """
    return first_rows(docs, near_groups(docs, words, radius).groupBy("root"))


def first_rows(docs: DataFrame, groups) -> DataFrame:
    """Of each group of (doc_id, __row) its first row: smallest doc_id, rows without one last, then by text hash."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))
    return rows_of(docs, groups.agg(first.alias("k")).select(F.xxhash64("k.doc_id", "k.__row").alias("__key")))


def rows_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose hash of doc_id and text hash is a ``__key`` of the table, one of each; texts are shuffled once."""
    found = docs.withColumn("__key", F.xxhash64("doc_id", F.xxhash64("text"))).join(
        keys.hint("shuffle_hash"), "__key", "left_semi")
    alike = Window.partitionBy("__key").orderBy(F.lit(0))
    return (found.withColumn("__copy", F.row_number().over(alike)).where("__copy = 1")
            .select(*docs.columns))

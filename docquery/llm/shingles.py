"""Near-duplicates by shared shingles: fingerprints that meet in the middle of a small ball and banded minimum fingerprints
propose pairs, their exact Jaccard similarity decides."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from docquery.llm.common import map_rows
from docquery.llm.components import components
from docquery.llm.simhash import majority, near_links, rows_of, shingle_hashes
from docquery.session import materialise

# A band is the minima of ROWS independent hashes. Two sets of similarity s share a band of BANDS with probability
# 1 - (1 - s^ROWS)^BANDS: 0.99993 at 0.8.
BANDS, ROWS = 24, 5
FIRST = 4  # the first holders of a band are compared at once with each other, each later one with the one before it
RADIUS = 3  # bits in which fingerprints of a ball differ at most
BLOCK = 256  # texts of a crowded band that meet its outsiders in one task
_random = np.random.default_rng(7)
FACTORS = _random.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _random.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)
MIX = _random.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    return _distinct(shingle_hashes(text, words))


def _distinct(pieces) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *pieces]))


def name(shingles: np.ndarray) -> int:
    """Equal for equal sets; zero for the empty one."""
    from xxhash import xxh64_intdigest

    value = xxh64_intdigest(shingles.tobytes()) if len(shingles) else 0
    return value - (1 << 64) if value >> 63 else value


def bands(shingles: np.ndarray) -> np.ndarray:
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[low:low + 1024] * FACTORS[:, None] + OFFSETS[:, None]).min(axis=1))
    keys = (least.reshape(BANDS, ROWS) * MIX).sum(axis=1, dtype=np.uint64)
    return ((keys ^ keys >> np.uint64(31)) * MIX[:, 0]).view(np.int64)


def alike(a: bytes, b: bytes, tenths: int) -> bool:
    """Whether the sets' Jaccard similarity is at least so many tenths."""
    one, two = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 10 * both >= tenths * (len(one) + len(two) - both)


def ball_pairs(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``node, size, other`` (node and size) of nodes ``node, size, fp`` whose fingerprints meet in a ball.

    The smallest node of a fingerprint stands for it in its links; other nodes of the fingerprint meet that one.
    """
    heads = nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("head"))
    links = materialise(near_links(heads, radius), "balls")
    met = (links.join(heads.toDF("a", "head"), "a").join(heads.toDF("b", "other"), "b")
           .select("head.node", "head.size", "other"))
    same = nodes.join(heads.withColumnRenamed("head", "other"), "fp").select("node", "size", "other")
    return met.union(same).where("node <> other.node")


def keep_first(docs: DataFrame, words: int = 5, tenths: int = 8) -> DataFrame:
    """The row of each near-duplicate group that has the smallest doc_id (then the smallest text hash), all columns.

    Texts are linked if the Jaccard similarity of their sets of ``words``-word shingles (whole texts, A-Z lower-cased,
    ASCII white space; a shorter text is one shingle) is at least ``tenths`` tenths; groups are what links reach over
    any number of steps. No link is false (up to 64-bit hash collisions); a pair is missed only if no band holds both
    (see BANDS). Equal sets are one node, texts without words are all copies of each other. Rows without doc_id stay
    only where no other row of the group has one.

    Pairs are compared in two steps. First those whose fingerprints meet in a ball (see ``simhash``), all pairs of small
    bands, and chains through crowded ones, which join most families. Then, in bands that still hold several groups, every text outside the band's largest group meets all
    others (see ``_outsiders``); pairs of one group need no link. So a family of alike texts costs a chain, and only
    texts that are nearly but not quite alike cost a comparison each with each, spread over tasks in blocks.

    Shuffled are: the variants of each fingerprint, one narrow row for each text and band, the sets of proposed pairs, and texts twice.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.xxhash64("text").alias("__row"), F.col("text").cast("binary").alias("text"))

    def sketch():
        def row(doc_id, own, text):
            hashes = list(shingle_hashes(text or b"", words))
            found = _distinct(hashes)
            return doc_id, own, majority(hashes), name(found), len(found), bands(found).tolist()

        return row

    stored = materialise(map_rows(rows, f"doc_id {kind}, __row long, fp long, node long, size int, bands array<long>", sketch), "bands")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    firsts = stored.groupBy("node").agg(F.min(row).alias("first"))
    nodes = stored.groupBy("node").agg(F.first("size").alias("size"), F.first("bands").alias("bands"))

    holders = nodes.select("node", "size", F.explode("bands").alias("band"))
    order = Window.partitionBy("band").orderBy(F.xxhash64("band", "node"))
    holder = F.struct("node", "size")
    earlier = [F.lag(holder, 1).over(order)] + [
        F.when(F.row_number().over(order) <= FIRST, F.lag(holder, k).over(order)) for k in range(2, FIRST)]
    pairs = materialise(
        holders.select("node", "size", F.array_compact(F.array(*earlier)).alias("earlier"))
        .select("node", "size", F.explode("earlier").alias("other"))
        .union(ball_pairs(stored.select("node", "size", "fp").distinct()))
        # sets of too different sizes can't be alike
        .where(10 * F.least("size", "other.size") >= tenths * F.greatest("size", "other.size"))
        .select(F.least("node", "other.node").alias("a"), F.greatest("node", "other.node").alias("b")).distinct(), "pairs")

    def sets_of(asked: DataFrame) -> DataFrame:
        chosen = asked.select("node").distinct().join(firsts, "node")
        holding = rows_of(docs.select("doc_id", "text"), chosen.select(F.xxhash64("first.doc_id", "first.__row").alias("__key")))

        def collect():
            def row(text):
                found = shingle_set(text or b"", words)
                return name(found), found.tobytes()

            return row

        return materialise(map_rows(holding.select(F.col("text").cast("binary")), "node long, shingles binary", collect), "sets")

    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    met = (pairs.join(sets.toDF("a", "of_a"), "a").join(sets.toDF("b", "of_b"), "b").select("a", "b", "of_a", "of_b"))
    links = materialise(map_rows(met, "a long, b long, linked boolean",
                                 lambda: lambda a, b, of_a, of_b: (a, b, alike(of_a, of_b, tenths)))
                        .where("linked").select("a", "b"), "links")
    roots = components(links)
    grouped = materialise(holders.join(roots, "node", "left").select("node", "size", "band", F.coalesce("root", "node").alias("root")), "holders")
    asked = materialise(_outsiders(grouped, tenths), "outsiders")
    more = materialise(_compared(asked, sets_of(asked), tenths), "more-links")
    if not more.isEmpty():
        roots = components(links.union(more))
    named = firsts.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    kept = named.groupBy("root").agg(F.min("first").alias("k"))
    return rows_of(docs, kept.select(F.xxhash64("k.doc_id", "k.__row").alias("__key")))


def _outsiders(holders: DataFrame, tenths: int) -> DataFrame:
    """``band, block, node, size, root, home`` for bands of more than two texts that hold several groups.

    A band's texts are dealt into blocks of about BLOCK. Each has its home block; texts outside the band's largest group
    are sent to all blocks, where they meet those at home. Bands of texts whose sizes rule out any link are left out.
    """
    groups = holders.groupBy("band", "root").agg(F.count("*").alias("n"), F.min("size").alias("low"), F.max("size").alias("high"))
    crowded = groups.groupBy("band").agg(
        F.sum("n").alias("all"), F.count("*").alias("groups"), F.max(F.struct("n", "root")).alias("largest")).where(
            F.expr("groups > 1 AND all > 2"))
    blocks = F.expr(f"cast((all + {BLOCK - 1}) div {BLOCK} as int)")
    placed = (holders.join(crowded.select("band", blocks.alias("blocks"), F.col("largest.root").alias("most")), "band")
              .withColumn("own", F.pmod(F.xxhash64("node", "band"), F.col("blocks")).cast("int")))
    sent = F.when(F.col("root") == F.col("most"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    return placed.withColumn("block", F.explode(sent)).select(
        "band", "block", "node", "size", "root", (F.col("block") == F.col("own")).alias("home"), (F.col("root") != F.col("most")).alias("outside"))


def _compared(asked: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """``a, b`` of different groups that are alike, among the outsiders of each block and its texts at home."""
    import pandas as pd

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        outside, home = frame[frame.outside], frame[frame.home]
        if len(outside) and len(home):
            sets_out = [np.frombuffer(s, np.uint64) for s in outside.shingles]
            sets_home = [np.frombuffer(s, np.uint64) for s in home.shingles]
            values = np.concatenate(sets_home)
            owner = np.repeat(np.arange(len(sets_home)), [len(s) for s in sets_home])
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            sizes = home["size"].to_numpy()
            for node, root, own in zip(outside.node, outside.root, sets_out):
                low = np.searchsorted(values, own)
                count = np.searchsorted(values, own, "right") - low
                at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
                both = np.bincount(owner[at], minlength=len(sizes))
                alike_ = (10 * both >= tenths * (sizes + len(own) - both)) & (home.root.to_numpy() != root)
                out += [(min(node, other), max(node, other)) for other in home.node.to_numpy()[alike_].tolist()]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return (asked.join(sets, "node").groupBy("band", "block").applyInPandas(compare, "a long, b long").distinct())

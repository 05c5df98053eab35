"""Mixing sources to target weights: fixed-length blocks, multinomial draws for each shard, permuted indexes, one join."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from docquery.llm.common import small_batches
from docquery.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)  # of the sources in code point order, repeating
SHARE = Fraction(3, 2)  # words of the mix for each word of the input
PASSES = 2  # times that a source may be used up at most
BLOCK_WORDS = 64
SHARD_SLOTS = 8192  # blocks of an output shard
CELL_ROWS = 20_000  # rows whose places are summed in one window
COPIES = 4096  # rows that repeat one another and are placed as one
GROUP = 4096  # sources that are drawn at once
ROUNDS = 6


@dataclass
class Mixture:
    """``sources``: source, source_no, size, blocks, target, slots. ``units``: source, doc_id, row, size, chunk, copies.
    ``pieces``: the words of each row that lie in a block (source_no, block, start, doc_id, row, size, first, words).
    ``slots``: the mix itself, shard, slot, source_no, block."""

    sources: DataFrame
    units: DataFrame
    pieces: DataFrame
    slots: DataFrame


def running(df: DataFrame, key: str, cell: str, order: list[str], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows before, by (cell, order) within each key.

    Cells are summed apart and shifted by the cells before them, so a key with a third of all rows is many windows.
    """
    sums = df.groupBy(key, cell).agg(F.sum(value).alias("__sum"))
    ahead = Window.partitionBy(key).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(key, cell, F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy(key, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (df.join(shifts, [key, cell])
            .withColumn(name, F.col("__shift") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__shift"))


def sized(docs: DataFrame) -> DataFrame:
    """Distinct rows with their number of words and of copies; more than COPIES copies are several units."""
    rows = docs.select("source", "doc_id", F.xxhash64("text").alias("row"),
                       F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return (rows.groupBy("source", "doc_id", "row", "size").agg(F.count("*").alias("n"))
            .withColumn("chunk", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})")))
            .withColumn("copies", F.least(F.lit(COPIES), F.expr(f"n - chunk * {COPIES}"))).drop("n"))


def with_targets(sources: DataFrame, share: Fraction = SHARE, passes: int = PASSES) -> DataFrame:
    """``target`` for ``size, weight``: ``share`` of all sizes by weight, at most ``passes`` times the source's size.

    What lies above a limit is dealt out again by weight until no target is above: each round is one sum over the
    sources, and two numbers of it reach the driver.
    """
    limit = passes * F.col("size")
    level = None  # words for each unit of weight
    while True:
        full = F.lit(False) if level is None else limit * level.denominator <= F.col("weight") * level.numerator
        sums = sources.agg(
            F.coalesce(F.sum("size"), F.lit(0)).cast("decimal(38,0)").alias("all"),
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0)).cast("decimal(38,0)").alias("full"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open")).first()
        if not sums["open"]:
            return sources.withColumn("target", limit.cast("double"))
        now = (share * int(sums["all"]) - int(sums["full"])) / int(sums["open"])
        if now == level:
            # exact in 38 digits but for the last division
            part = F.col("weight").cast("double") * F.lit(float(level.numerator)) / F.lit(float(level.denominator))
            return sources.withColumn("target", F.when(full, limit.cast("double")).otherwise(part))
        level = now


def permuted(place: np.ndarray, count: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where ``place`` of [0, count) goes in the pseudorandom permutation that ``key`` names; elementwise.

    A Feistel network on the smallest even number of bits that holds count; what falls outside walks on (on average
    fewer than four steps), so each key gives a permutation of exactly [0, count).
    """
    count = count.astype(np.uint64)
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(count, 2).astype(np.float64) + 1)) + 1) // 2).astype(np.uint64)
    out, todo = place.astype(np.uint64), np.arange(len(place))
    while len(todo):
        half, own, x = bits[todo], key[todo], out[todo]
        mask = (np.uint64(1) << half) - np.uint64(1)
        left, right = x >> half, x & mask
        for turn in range(ROUNDS):
            left, right = right, left ^ (mixed(right ^ mixed(own + np.uint64(turn))) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= count[todo]]
    return out.astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit values (multiplications and shifts)."""
    x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def draw(sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """``shard, source_no, slot0, count``: multinomial counts of each shard's slots, in proportion to ``slots``.

    Sources are drawn in two steps, groups of GROUP first, then those of a group: the same distribution, and no task
    holds more than one number for each group. Each shard has its own generator, so a task that runs again draws alike.
    """
    import pyarrow as pa

    spark = sources.sparkSession
    grouped = sources.withColumn("group", F.expr(f"source_no div {GROUP}"))
    sums = grouped.groupBy("group").agg(F.sum("slots").alias("slots")).orderBy("group").collect()
    numbers = [r["group"] for r in sums]
    weights = np.array([r.slots for r in sums], np.float64)
    total = sum(r.slots for r in sums)

    def first(batches):
        for batch in batches:
            out = []
            for shard in batch.column(0).to_pylist():
                own = min(shard_slots, total - shard * shard_slots)
                counts = np.random.default_rng([seed, shard]).multinomial(own, weights / weights.sum())
                begins = np.cumsum(counts) - counts
                out += [(shard, g, int(b), int(c)) for g, b, c in zip(numbers, begins, counts) if c]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], names=["shard", "group", "slot0", "count"])

    def second(batches):
        for batch in batches:
            out = []
            for shard, group, slot0, count, members in zip(*(c.to_pylist() for c in batch.columns)):
                slots = np.array([m["slots"] for m in members], np.float64)
                counts = np.random.default_rng([seed, shard, group + 1]).multinomial(count, slots / slots.sum())
                begins = slot0 + np.cumsum(counts) - counts
                out += [(shard, m["source_no"], int(b), int(c)) for m, b, c in zip(members, begins, counts) if c]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], names=["shard", "source_no", "slot0", "count"])

    shards = spark.range(-(-total // shard_slots) if total else 0)
    of_groups = small_batches(shards).mapInArrow(first, "shard long, group long, slot0 long, count long")
    members = grouped.where("slots > 0").groupBy("group").agg(
        F.array_sort(F.collect_list(F.struct("source_no", "slots"))).alias("members"))
    return small_batches(of_groups.join(members, "group").select("shard", "group", "slot0", "count", "members")).mapInArrow(
        second, "shard long, source_no long, slot0 long, count long")


def settle(sources: DataFrame, drawn: DataFrame) -> DataFrame:
    """``shard, slot0, source_no, rank0, count``: the draws with each source's slots brought to ``slots`` in all.

    A source drawn too often gives slots away, evenly over its shards; those go one by one to sources drawn too
    seldom. About the square root of all slots move. ``rank0`` numbers a source's slots from zero without gaps.
    """
    got = sources.join(drawn.groupBy("source_no").agg(F.sum("count").alias("drawn")), "source_no", "left").select(
        "source_no", "slots", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    over, under = F.greatest(F.expr("drawn - slots"), F.lit(0)), F.greatest(F.expr("slots - drawn"), F.lit(0))
    ahead = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)  # one row for each source
    balance = got.select("source_no", "drawn", over.alias("over"), under.alias("under"),
                         F.coalesce(F.sum(over).over(ahead), F.lit(0)).alias("over0"),
                         F.coalesce(F.sum(under).over(ahead), F.lit(0)).alias("under0"))
    placed = running(drawn.withColumn("cell", F.expr("shard div 65536")), "source_no", "cell", ["shard"], "count", "rank0")
    wide = "cast(rank0 + {} as decimal(38,0))"
    given = lambda at: F.expr(f"cast({wide.format(at)} * over div drawn as bigint)")
    rows = placed.join(balance, "source_no").withColumn("given0", given("0")).withColumn("moved", given("count") - F.col("given0"))
    kept = rows.where("count > moved").select(
        "shard", "slot0", "source_no", F.expr("rank0 - given0").alias("rank0"), F.expr("count - moved").alias("count"))
    free = rows.where("moved > 0").select(
        "shard", F.expr("slot0 + count - moved").alias("at"), F.expr("over0 + given0").alias("x0"),
        F.explode(F.expr("sequence(0L, moved - 1)")).alias("k")).select(
            "shard", F.expr("at + k").alias("slot0"), F.expr("x0 + k").alias("x"))
    wanted = balance.where("under > 0").select(
        "source_no", "drawn", "under0", F.explode(F.expr("sequence(0L, under - 1)")).alias("k")).select(
            "source_no", F.expr("drawn + k").alias("rank0"), F.expr("under0 + k").alias("x"))
    moved = free.join(wanted, "x").select("shard", "slot0", "source_no", "rank0", F.lit(1).cast("long").alias("count"))
    return kept.union(moved)


def expand(planned: DataFrame, total: int, shard_slots: int, seed: int) -> DataFrame:
    """``shard, slot, source_no, block``: each slot's block, by the permutation of its source and pass; slots of a
    shard are shuffled by one of the shard."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            shard, slot0, source, rank0, count, blocks = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for low in range(0, len(count), 64):  # at most 64 shares of a shard at once
                some = slice(low, low + 64)
                own = np.repeat(np.arange(low, min(low + 64, len(count))), count[some])
                k = np.arange(len(own)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
                rank, n = rank0[own] + k, blocks[own]
                salt = np.uint64(seed)
                key = mixed(mixed(source[own].astype(np.uint64) + salt) + (rank // n).astype(np.uint64))
                block = permuted(rank % n, n, key)
                of_shard = np.minimum(shard_slots, total - shard[own] * shard_slots)
                slot = permuted(slot0[own] + k, of_shard, mixed(~shard[own].astype(np.uint64) + salt))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (shard[own], slot, source[own], block)],
                                                 names=["shard", "slot", "source_no", "block"])

    return planned.mapInArrow(run, "shard long, slot long, source_no long, block long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, passes: int = PASSES,
        block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 13) -> Mixture:
    """Mix ``docs`` (doc_id, source, text) to the weights of its sources.

    Sources are taken in code point order, null (a source as any other) last; see ``with_targets`` for their targets.
    A source's texts are laid end to end (in the order of a hash, so that neighbours are not alike) and cut into blocks
    of ``block_words`` words, the last one shorter. The mix has a slot for each block it takes: counts of each shard
    are drawn, totals settled at the target to half a block, and a source's slots walk through its blocks in an
    order permuted anew in each pass. So no block, and no document, is taken more than ``passes`` times.

    Null and empty texts have no words and no piece. Rows that repeat one another are texts of their own. The result
    depends on the rows alone, not on their order or partitioning. An empty table gives empty tables.

    Plan: texts are read once and only their word counts go on. Places are running sums in cells, whatever the sizes
    of the sources. Blocks meet slots by (source, block), keys that hold a few rows each.
    """
    units = materialise(sized(docs), "mix-units")
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    plain = (units.groupBy("source").agg(F.sum(F.expr("size * copies")).alias("size"), F.count("*").alias("units"))
             .withColumn("source_no", F.row_number().over(order).cast("long") - 1)
             .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)),
                                                (F.col("source_no") % len(weights) + 1).cast("int")).cast("long"))
             .withColumn("blocks", F.expr(f"(size + {block_words - 1}) div {block_words}")))
    plain = materialise(plain, "mix-plain")
    slots = F.when(F.col("size") > 0, F.round(F.col("target") / F.col("size") * F.col("blocks"))).otherwise(0).cast("long")
    sources = materialise(with_targets(plain, share, passes).withColumn("slots", slots), "mix-sources")
    sums = sources.agg(F.coalesce(F.sum("units"), F.lit(0)).alias("units"), F.coalesce(F.sum("slots"), F.lit(0)).alias("slots")).first()

    cells = sums.units // CELL_ROWS + 1
    numbered = (units.where("size > 0").join(sources.select(F.col("source").alias("__source"), "source_no"),
                                             F.col("source").eqNullSafe(F.col("__source")))
                .select("source_no", "doc_id", "row", "size", "chunk", "copies", F.expr("size * copies").alias("all"),
                        F.pmod(F.xxhash64("doc_id", "row", "chunk"), F.lit(cells)).alias("cell")))
    placed = running(numbered, "source_no", "cell", ["doc_id", "row", "chunk", "size"], "all", "start0")
    copies = placed.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)"))).select(
        "source_no", "doc_id", "row", "size", F.expr("start0 + copy * size").alias("start"))
    pieces = copies.withColumn("block", F.explode(F.expr(
        f"sequence(start div {block_words}, (start + size - 1) div {block_words})"))).select(
            "source_no", "block", "start", "doc_id", "row", "size",
            F.expr(f"greatest(block * {block_words} - start, 0)").alias("first"),
            F.expr(f"least((block + 1) * {block_words} - start, size) - greatest(block * {block_words} - start, 0)").alias("words"))

    drawn = materialise(draw(sources, shard_slots, seed), "mix-draws")
    planned = settle(sources, drawn).join(sources.select("source_no", "blocks"), "source_no").select(
        "shard", "slot0", "source_no", "rank0", "count", "blocks")
    return Mixture(sources, units, pieces, expand(planned, sums.slots, shard_slots, seed))


def words_taken(mixture: Mixture) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of each row: the words that the mix takes, repeats counted."""
    times = mixture.slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    met = mixture.pieces.join(times, ["source_no", "block"], "left")
    taken = met.groupBy("source_no", "start", "doc_id", "size").agg(
        F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    of_source = mixture.sources.select("source", "source_no", F.col("size").alias("source_size"), "target")
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    some = taken.join(of_source, "source_no").select(*columns)
    none = (mixture.units.where("size = 0").withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
            .withColumnRenamed("source", "__source").join(of_source, F.col("__source").eqNullSafe(F.col("source")))
            .withColumn("taken", F.lit(0).cast("long")).select(*columns))
    return some.union(none)


def mixed_texts(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """``shard, slot, source_no, block, text``: the mix itself, words joined by blanks.

    Texts are cut into their pieces where they lie and meet the slots by piece: a text is never copied whole.
    """
    spans = mixture.pieces.groupBy("doc_id", "row", "source_no", "block", "first", "words").agg(
        F.collect_list("start").alias("starts"))
    own = docs.select("doc_id", F.xxhash64("text").alias("row"), "text").dropDuplicates(["doc_id", "row"])
    cut = (own.withColumnRenamed("doc_id", "__doc").withColumnRenamed("row", "__row")
           .join(spans, F.col("__doc").eqNullSafe(F.col("doc_id")) & (F.col("__row") == F.col("row")))
           .withColumn("start", F.explode("starts"))
           .select("source_no", "block", "start", F.array_join(F.slice(
               F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("first") + 1).cast("int"),
               F.col("words").cast("int")), " ").alias("text")))
    blocks = cut.groupBy("source_no", "block").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("start", "text"))), lambda p: p["text"]), " ").alias("text"))
    return mixture.slots.join(blocks, ["source_no", "block"]).select("shard", "slot", "source_no", "block", "text")

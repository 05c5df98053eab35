"""Benchmark decontamination: q-gram counts in diagonal bands find regions, banded alignment verifies them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from docquery.llm.common import arrow_schema, keep_rows, map_rows, small_batches
from docquery.session import materialise, scratch_path
from docquery.sources.shared import read_columns

Q = 8  # bytes of a q-gram of normalised text
EDIT_SHARE = 10  # an item, or a window of it, may differ by one edit for each so many of its normalised bytes
WINDOW = 13  # words of an item that count as held by themselves
SHORT = 12  # items of fewer bytes must occur as they are, as whole words
SLICE_BYTES = 4 << 20  # normalised benchmark bytes held by a task at once
TABLE_BITS = 22
TOGETHER = 1 << 17  # bytes of texts that are looked up at once
# Letters and digits stay (A-Z lower-cased), all other ASCII characters separate words.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalise(data: bytes) -> bytes:
    """Lower-cased words of letters, digits and non-ASCII characters, one blank between them."""
    return b" ".join(data.translate(PLAIN).split())


def edit_budget(length: int, q: int = Q, share: int = EDIT_SHARE) -> int:
    """The most edits an item of this length may have, so that it must still share a q-gram (the lemma)."""
    return max(0, min(length // share, (length - q) // q))


def grams(data: bytes, q: int = Q) -> np.ndarray:
    """A 64-bit value for each q-gram (q from 8 to 16): equal for equal ones."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))  # eight bytes from every place
    mixed = words[:n] * np.uint64(0x9E3779B97F4A7C15) ^ words[q - 8:q - 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)


class Items:
    """One slice of the benchmark, ready to be looked up."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.ids = [item for item, _ in rows]
        self.texts = [text for _, text in rows]
        self.budgets = [edit_budget(len(t)) for t in self.texts]
        values = [grams(t) for t in self.texts]
        lengths = [len(v) for v in values]
        self.short = [k for k, t in enumerate(self.texts) if len(t) < SHORT]
        values = [v if len(t) >= SHORT else v[:0] for v, t in zip(values, self.texts)]
        lengths = [len(v) for v in values]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.budget = np.array(self.budgets, np.int64)
        self.windows = [windows(t) for t in self.texts]
        # of an item's windows: the largest budget and length, the fewest q-grams (none: an item without windows)
        self.wide = np.array([w[2].max() if len(w[0]) else 0 for w in self.windows], np.int64)
        self.span = np.array([(w[1] - w[0]).max() if len(w[0]) else 0 for w in self.windows], np.int64)
        self.least = np.array([w[3].min() if len(w[0]) else 0 for w in self.windows], np.int64)
        # q-grams that a band must hold: of the whole item, and of the least demanding of its windows as well
        self.need = self.size - Q + 1 - Q * self.budget
        self.fewest = np.where(self.least > 0, np.minimum(self.need, self.least), self.need)
        self.cell = 2 * (np.maximum(self.budget, self.wide) + 1)  # as wide as the widest band
        # all windows behind one another, those of an item together
        first = np.cumsum([0, *[len(w[0]) for w in self.windows]])
        self.first_window, self.windows_of = first[:-1], np.diff(first)
        self.begin, self.end, self.asks = (
            np.concatenate([np.zeros(0, np.int64), *[w[c] for w in self.windows]]) for c in (0, 1, 3))
        every = np.concatenate([np.zeros(0, np.uint64), *values])
        item = np.repeat(np.arange(len(rows)), lengths)
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(n) for n in lengths]])
        order = np.argsort(every, kind="stable")
        self.values, self.item, self.place = every[order], item[order], place[order]
        self.seen = np.zeros(1 << TABLE_BITS, bool)
        self.seen[(self.values >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def hits(self, data: bytes, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in the text, diagonal) of every q-gram shared with text places [low, high)."""
        found = grams(data[low:high + Q - 1])
        at = np.flatnonzero(self.seen[(found >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        first = np.searchsorted(self.values, found[at], "left")
        count = np.searchsorted(self.values, found[at], "right") - first
        at, first, count = at[count > 0], first[count > 0], count[count > 0]
        entry = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        place = np.repeat(at, count) + low
        return self.item[entry], place, place - self.place[entry]

    def regions(self, data: bytes) -> tuple[set, set]:
        """(item, first, end) of text regions that hold enough q-grams of an item in one diagonal band, and
        (item, lowest and highest diagonal, windows) of those that hold enough of some of its windows.

        A band is twice as wide as an edit budget and starts every budget: an alignment within the budget stays in
        one of them. Places are cut so that memory doesn't follow the text; an item's hits of neighbouring cuts meet
        through the longest item's length of overlap.
        """
        whole, partly = set(), set()
        longest = max(map(len, self.texts), default=0)
        step = 1 << 20
        for low in range(0, max(len(data) - Q + 1, 0), step):
            item, place, diagonal = self.hits(data, low, min(low + step + 2 * longest, len(data) - Q + 1))
            item, place, diagonal = self._crowded(item, place, diagonal)
            if not len(item):
                continue
            need = self.need
            i, d, starts, counts = self._bands(item, diagonal, diagonal, self.budget)
            ok = counts >= need[i[starts]]
            for s, n in zip(starts[ok].tolist(), counts[ok].tolist()):
                k, b = int(i[s]), self.budgets[int(i[s])]
                whole.add((k, int(d[s:s + n].min()) - b, int(d[s:s + n].max()) + len(self.texts[k]) + b))
            some = self.least[item] > 0
            if some.any():
                partly |= self._windows_held(item[some], diagonal[some], (place - diagonal)[some])
        return whole, partly

    def _crowded(self, item, place, diagonal):
        """The hits that may lie in a band with enough of them, found by counting alone.

        An item with fewer hits in all than any of its bands needs is out. A band, of a whole item or of a window,
        is no wider than a cell of diagonals, so it lies in two neighbouring ones: hits of cells that hold too few
        together with either neighbour are out as well.
        """
        total = np.bincount(item, minlength=len(self.ids))
        some = (total >= self.fewest) & (total > 0)
        ok = some[item]
        item, place, diagonal = item[ok], place[ok], diagonal[ok]
        if not len(item):
            return item, place, diagonal
        cell = diagonal // self.cell[item]
        cell -= cell.min() - 1
        span = int(cell.max()) + 2
        key = (np.cumsum(some) - 1)[item] * span + cell
        count = np.bincount(key, minlength=int(some.sum()) * span)
        near = count[key] + np.maximum(count[key - 1], count[key + 1])
        ok = near >= self.fewest[item]
        return item[ok], place[ok], diagonal[ok]

    def _windows_held(self, item, diagonal, at) -> set:
        """(item, lowest and highest diagonal, windows) of bands that hold enough of an item's places in some window."""
        i, d, starts, counts, p = self._bands(item, diagonal, at, self.wide, True)
        group = np.repeat(np.arange(len(starts)), counts)
        # enough hits within the length of the longest window
        last = np.arange(len(i)) + self.least[i] - 1
        inside = last < len(i)
        last = np.minimum(last, len(i) - 1)
        dense = np.unique(group[inside & (group[last] == group) & (p[last] - p <= self.span[i] - Q)])
        if not len(dense):
            return set()
        number = np.full(len(starts), -1)
        number[dense] = np.arange(len(dense))
        new = np.append(True, (p[1:] != p[:-1]) | (group[1:] != group[:-1])) & (number[group] >= 0)
        length = int(self.size.max()) + 1
        places = number[group[new]] * length + p[new]
        owner_item = i[starts[dense]]
        owner = np.repeat(np.arange(len(dense)), self.windows_of[owner_item])
        own = np.arange(len(owner)) - np.repeat(np.cumsum(self.windows_of[owner_item]) - self.windows_of[owner_item],
                                                self.windows_of[owner_item])
        window = self.first_window[owner_item][owner] + own
        held = (np.searchsorted(places, owner * length + self.end[window] - Q, "right")
                - np.searchsorted(places, owner * length + self.begin[window])) >= self.asks[window]
        out = set()
        for g in np.unique(owner[held]).tolist():
            s, n, k = int(starts[dense[g]]), int(counts[dense[g]]), int(owner_item[g])
            b = int(self.wide[k])
            out.add((k, int(d[s:s + n].min()) - b, int(d[s:s + n].max()) + b, tuple(own[held & (owner == g)].tolist())))
        return out

    @staticmethod
    def _bands(item, diagonal, by, budget, with_by=False):
        """Items and diagonals sorted by (item, band, ``by``), with starts and counts of the groups; each hit lies in two
        bands, that of its cell and the one that begins half a cell later."""
        width = budget[item] + 1
        band = np.concatenate([diagonal // (2 * width) * 2, (diagonal + width) // (2 * width) * 2 + 1])
        twice = np.concatenate([np.arange(len(item))] * 2)
        order = np.lexsort((by[twice], band, item[twice]))
        i, b, at = item[twice[order]], band[order], twice[order]
        starts = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (b[1:] != b[:-1])))
        return i, diagonal[at], starts, np.diff(np.append(starts, len(i))), *([by[at]] if with_by else [])

    def found(self, data: bytes) -> list[tuple[int, int, int, int]]:
        return self.found_in([data])[0]

    def found_in(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        """Per text and item its best place: (item number, edits, first, end) in normalised bytes.

        The best place of the whole item counts; where that isn't held, the best one of a window. Texts are looked up
        together, with a zero byte between them that no item holds; a region that crosses it is cut there.
        """
        data = b"\0".join(texts)
        bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        parts: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]

        def touched(first: int, end: int):
            for t in range(max(0, int(np.searchsorted(bounds, first, "right")) - 1), len(texts)):
                if bounds[t] >= end:
                    break
                yield t, int(bounds[t]), int(bounds[t + 1]) - 1

        whole, partly = self.regions(data)
        for k, first, end in whole:
            for t, low, high in touched(first, end):
                begin = max(first, low)
                got = align(self.texts[k], data[begin:min(end, high)], self.budgets[k])
                if got is not None:
                    place = got[0], begin - low + got[1], begin - low + got[2]
                    best[t][k] = min(best[t].get(k, place), place)
        for k, lowest, highest, asked in partly:
            begins, ends, budgets, _ = self.windows[k]
            for t, low, high in touched(int(begins[asked[0]]) + lowest, int(ends[asked[-1]]) + highest):
                if k in best[t]:
                    continue
                clear = -1
                for w in asked:
                    if begins[w] < clear:
                        continue
                    first = max(int(begins[w]) + lowest, low)
                    region = data[first:max(min(int(ends[w]) + highest, high), first)]
                    if len(region) < ends[w] - begins[w] - budgets[w]:
                        continue
                    edits, start, end = align(self.texts[k][begins[w]:ends[w]], region, int(budgets[w]), True)
                    if edits <= budgets[w]:
                        place = edits, first - low + start, first - low + end
                        parts[t][k] = min(parts[t].get(k, place), place)
                    else:  # a later window has at least as many edits less the bytes between the two beginnings
                        clear = begins[w] + edits - self.wide[k]
        for t, text in enumerate(texts):
            best[t] |= {k: place for k, place in parts[t].items() if k not in best[t]}
            for k in self.short:
                if self.texts[k]:
                    at = (b" " + text + b" ").find(b" " + self.texts[k] + b" ")
                    if at >= 0:
                        best[t][k] = 0, at, at + len(self.texts[k])
        return [[(k, *place) for k, place in sorted(b.items())] for b in best]

    def found_in_all(self, texts: list[bytes]):
        """``found_in`` for any number of texts, about TOGETHER bytes at a time."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self.found_in(held)
                held, size = [], 0
        if held:
            yield from self.found_in(held)


def windows(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte, edit budget and needed q-grams of each WINDOW words of an item that has more than those."""
    lengths = np.array([len(w) for w in text.split()], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    begins, ends = (ends - lengths)[:max(0, len(ends) - WINDOW + 1)], ends[WINDOW - 1:]
    if len(lengths) <= WINDOW:
        begins = ends = np.zeros(0, np.int64)
    budgets = np.array([edit_budget(n) for n in (ends - begins).tolist()], np.int64)
    return begins, ends, budgets, ends - begins - Q + 1 - Q * budgets


def distances(item: bytes, text: bytes, anchored: bool = False):
    """Edits between the item and the best part of the text (anchored: the whole of it) that ends after each byte."""
    places: dict[int, int] = {}
    for k, byte in enumerate(item):
        places[byte] = places.get(byte, 0) | 1 << k
    every, top = (1 << len(item)) - 1, 1 << len(item) - 1
    up, down, score = every, 0, len(item)  # bits: the next row costs one more, one less
    for byte in text:
        equal = places.get(byte, 0)
        across = (((equal & up) + up) ^ up) | equal
        more, less = down | (every & ~(across | up)), up & across
        score += bool(more & top) - bool(less & top)
        more, less = more << 1 & every | anchored, less << 1 & every
        equal |= down
        up, down = less | (every & ~(equal | more)), more & equal
        yield score


def align(item: bytes, region: bytes, budget: int, beyond: bool = False) -> tuple[int, int, int] | None:
    """Fewest edits that turn the item into a part of the region, with that part's place; beyond the budget None.

    With ``beyond``, a number of edits that is not too high and above the budget instead of None, without a place.
    """
    if len(item) > 4096:
        return align_banded(item, region, budget) or ((budget + 1, 0, 0) if beyond else None)
    edits, end = min(((score, k + 1) for k, score in enumerate(distances(item, region))), default=(budget + 1, 0))
    if edits > budget:
        return (edits, 0, 0) if beyond else None
    tail = region[max(0, end - len(item) - edits):end][::-1]
    _, length = min((score, k + 1) for k, score in enumerate(distances(item[::-1], tail, True)))
    return edits, end - length, end


def align_banded(item: bytes, region: bytes, budget: int) -> tuple[int, int, int] | None:
    """The same for long items. Fewest edits that turn the item into a part of the region, with that part's place; None beyond the budget.

    Rows of the dynamic programme run along the region, one for each byte of the item, and only over the diagonals
    that the region leaves open: the region is at most four budgets longer than the item.
    """
    text = np.frombuffer(region, np.uint8)
    n = len(text)
    if n + budget < len(item):
        return None
    span = n - len(item) + 2 * budget + 1  # diagonals -budget .. n - len(item) + budget
    lanes = np.arange(span)
    big = len(item) + n
    cost = np.where((lanes >= budget), 0, big)  # row 0: a start at each place of the region
    start = lanes - budget
    padded = np.concatenate([np.full(budget, -1), text.astype(np.int64), np.full(2 * budget + len(item), -1)])
    open_ = np.concatenate([np.zeros(budget, bool), np.ones(n, bool), np.zeros(2 * budget + len(item), bool)])
    for row, byte in enumerate(item):
        letters, inside = padded[row:row + span], open_[row:row + span]
        match = np.where(inside, cost + (letters != byte), big)
        skip = np.append(cost[1:], big) + 1  # an item byte without a counterpart
        take = skip < match
        now = np.where(take, skip, match)
        origin = np.where(take, np.append(start[1:], 0), start)
        # a region byte without a counterpart: the cheapest lane to the left plus the distance
        keyed = (now - lanes) * (4 * big) + lanes
        left = np.minimum.accumulate(keyed)
        source = left % (4 * big)
        cost, start = now[source] + lanes - source, origin[source]
    # lane l ends at place len(item) + l - budget
    ends = len(item) + lanes - budget
    valid = (ends >= 0) & (ends <= n) & (cost <= budget)
    if not valid.any():
        return None
    k = int(np.argmin(np.where(valid, cost, big)))
    return int(cost[k]), int(start[k]), int(ends[k])


class Slices:
    """The normalised benchmark in the shared folder, in slices of bounded size; a task holds one of them at a time."""

    def __init__(self, benchmark: DataFrame, slice_bytes: int = SLICE_BYTES):
        spark = benchmark.sparkSession
        self.kind = dict(benchmark.dtypes)["item_id"]
        rows = benchmark.select("item_id", F.col("text").cast("binary").alias("text"))
        stored = materialise(map_rows(rows, f"item_id {self.kind}, text binary", lambda: lambda item_id, text: (
            item_id, normalise(text or b""))).where("length(text) > 0"), "benchmark")
        total = stored.agg(F.sum(F.length("text"))).first()[0] or 0
        count = -(-total // slice_bytes)
        path = scratch_path(spark, "slices")
        # as many numbers and file names as slices reach the driver
        (stored.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(count, 1)))).hint("rebalance", "slice")
         .write.partitionBy("slice").parquet(path))
        self.files: dict[str, list[str]] = {}
        for file in (spark.read.parquet(path).inputFiles() if count else []):
            self.files.setdefault(file.rpartition("/slice=")[2].partition("/")[0], []).append(file)

    def opened(self):
        """In a task: a function that goes through the slices' ``Items``; the only slice of a small benchmark stays open."""
        kept: dict[str, Items] = {}

        def items(name: str) -> Items:
            if name not in kept:
                kept.clear()
                tables = [read_columns(file, ["item_id", "text"]) for file in self.files[name]]
                kept[name] = Items([row for t in tables for row in zip(t["item_id"].to_pylist(), t["text"].to_pylist())])
            return kept[name]

        return lambda: (items(name) for name in self.files)


def contaminated(docs: DataFrame, benchmark: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``doc_id, __row, item_id, edits, first_byte, end_byte``: each benchmark item that a text holds, at its best place.

    An item counts as held if a part of the normalised text (see ``normalise``) turns into it, or into any WINDOW words
    of it in a row, within ``edit_budget`` edits of what is compared; items of fewer than SHORT bytes must occur as
    whole words. The lemma: such a part shares at least length - q + 1 - q * edits q-grams with it inside one diagonal
    band, so nothing within the budget is missed. ``edits`` and places are the window's where only that is held. Places
    are bytes of the normalised text. Null and empty texts hold nothing; empty items are never held; repeated rows
    and repeated items each report. One pass and no shuffle of the documents: a task holds one slice of about
    ``slice_bytes`` of the benchmark (of a larger one, each batch goes through all slices) and one batch of texts.
    """
    import pyarrow as pa

    parts = Slices(benchmark, slice_bytes)
    rows = docs.select("doc_id", F.xxhash64("text").alias("__row"), F.col("text").cast("binary").alias("text"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, __row long, item_id {parts.kind}, edits int, first_byte long, end_byte long"
    fields = arrow_schema(docs, schema)

    def run(batches):
        slices = parts.opened()
        for batch in batches:
            texts = [normalise(t or b"") for t in batch.column(2).to_pylist()]
            for items in slices():
                held = [(at, *h) for at, own in enumerate(items.found_in_all(texts)) for h in own]
                if held:
                    at, item, edits, first, end = zip(*held)
                    at = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(1).take(at), *[pa.array(c, f.type) for c, f in zip(
                            ([items.ids[k] for k in item], edits, first, end), list(fields)[2:])]], schema=fields)

    return small_batches(rows).mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows whose text holds no benchmark item (see ``contaminated``), all columns.

    One narrow pass, no shuffle and no join. Null and empty texts stay.
    """
    parts = Slices(benchmark, slice_bytes)

    def make():
        slices = parts.opened()

        def clean(texts):
            keep = [True] * len(texts)
            normal = [normalise(t or b"") for t in texts]
            for items in slices():
                for k, held in enumerate(items.found_in_all(normal)):
                    keep[k] &= not held
            return keep

        return clean

    return keep_rows(docs, make)

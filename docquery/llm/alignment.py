"""Cross-tokenizer alignment in Arrow: token ends of two tokenizers are joined, id pairs counted over the corpus."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from docquery.llm.common import arrow_schema, per_worker, small_batches
from docquery.llm.pieces import PieceEncoder
from docquery.session import materialise

SEGMENT = 1 << 18  # characters after which a text is cut at the next border of both tokenizers
RUN_BYTES = 1 << 21  # bytes of text that are aligned at once
CHUNK_LINKS = 1 << 21  # links of the documents that share a look-up table
BORDER = re.compile(r"[^\W_](?= [^\W_])")
# Fixed value: how a byte-level tokenizer splits a text before it merges bytes.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The letters that stand for bytes: printable Latin ones for themselves, the others from U+0100 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevelEncoder:
    """Ids of a text by a byte-level tokenizer file, without special tokens: their strings are plain text.

    A file of the plain layout (merges in the order of their ids) is run by the faster library, which has the same
    ids; texts that it can't take, and other files, by the file's own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        spec = json.loads(self.library.to_str())
        letters = byte_alphabet()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        added = {t["content"] for t in spec.get("added_tokens") or []}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.bytes[number] = token.encode() if token in added else bytes([letters[c] for c in token])
        ranks = {self.bytes[n]: n for t, n in vocabulary.items() if t not in added}
        merged = [self.bytes[vocabulary[a]] + self.bytes[vocabulary[b]] for a, b in map(
            lambda m: m.split(" ") if isinstance(m, str) else m, spec["model"].get("merges") or [])]
        before = spec.get("pre_tokenizer") or {}
        self.plain = (
            spec["model"]["type"] == "BPE" and not spec.get("normalizer") and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space") and before.get("use_regex", True) and len(ranks) == 256 + len(merged)
            and not spec["model"].get("dropout") and [ranks.get(m) for m in merged] == list(range(256, 256 + len(merged))))
        self.fast = None
        if self.plain:
            import tiktoken

            self.fast = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        # the faster library's cost grows with the square of one unbroken stretch, and its splitter runs deep on blanks
        if self.fast is not None and not re.search(r"\s{1000}|\S{5000}", text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


class Aligner:
    """Both encoders of a pair of models with their tokens' bytes, and the Arrow steps over a run of text segments."""

    def __init__(self, byte_model: str, piece_model: str):
        self.a, self.b = ByteLevelEncoder(byte_model), PieceEncoder(piece_model)
        own = [d or b"" for d in self.b.decoded]
        self.width = len(own)
        self.bytes = pa.array(self.a.bytes, pa.binary()), pa.array(own, pa.binary())
        self.lengths = tuple(pc.cast(pc.binary_length(b), pa.int64()) for b in self.bytes)
        size = max(len(self.a.bytes), len(own))
        # a token's text in a listing: another token of its side follows, the other side, the next group
        self.names = pa.array([f"{k}{mark}" for k in range(size) for mark in ",|;"])
        self.cut = self.a.plain and self.b.cut

    def segments(self, text: str) -> list[str]:
        """A text with its leading blank, cut where both tokenizers cut whatever stands around."""
        whole, parts, low = " " + text, [], 0
        while self.cut and len(whole) - low > SEGMENT:
            found = BORDER.search(whole, low + SEGMENT)
            if not found:
                break
            parts.append(whole[low:found.end()])
            low = found.end()
        return [*parts, whole[low:]]

    def run(self, segments: list[str]) -> list[tuple | None]:
        """Per segment (A tokens, B tokens, listing of its groups, id pairs), None where bytes are not kept."""
        data = [s.encode() for s in segments]
        tokens = [_lists([self.a(s) for s in segments]), _lists([self.b.encode(d[1:])[0] for d in data])]
        same = pa.array(data, pa.binary())
        kept = [pc.equal(_joined(pc.take(bytes_, t.flatten()), t.offsets, pa.binary()), same)
                for bytes_, t in zip(self.bytes, tokens)]
        good = np.flatnonzero(pc.and_(*kept).to_numpy(zero_copy_only=False))
        out: list[tuple | None] = [None] * len(segments)
        if len(good):
            a, b = (pc.take(t, pa.array(good)) for t in tokens)
            for k, made in zip(good.tolist(), self._aligned(a, b)):
                out[k] = made
        return out

    def _aligned(self, a: pa.ListArray, b: pa.ListArray):
        ids, parents, keys = zip(*(self._ends(tokens, lengths) for tokens, lengths in zip((a, b), self.lengths)))
        sides = [pa.table({"end": k, f"at_{n}": np.arange(len(k))}) for n, k in enumerate(keys)]
        met = sides[0].join(sides[1], "end", join_type="inner", use_threads=False)
        at = [np.sort(met[f"at_{n}"].to_numpy()) for n in (0, 1)]  # ends grow along a side, so both orders agree
        closes = [np.zeros(len(k), np.int64) for k in keys]
        for mask, places in zip(closes, at):
            mask[places] = 1
        groups = [np.cumsum(mask) - mask for mask in closes]
        # a group lists its A tokens, then its B tokens: each moves behind what the other side has before it
        ends = [np.append(0, places + 1) for places in at]
        listed = np.empty(len(keys[0]) + len(keys[1]), np.int64)
        listed[np.arange(len(keys[0])) + ends[1][groups[0]]] = 3 * ids[0] + closes[0]
        listed[np.arange(len(keys[1])) + ends[0][groups[1] + 1]] = 3 * ids[1] + 2 * closes[1]
        offsets = [t.offsets.to_numpy() for t in (a, b)]
        texts = _joined(pc.take(self.names, pa.array(listed)), pa.array(offsets[0] + offsets[1], pa.int32()), pa.string())
        pairs = ids[0][at[0]] * self.width + ids[1][at[1]]
        bounds = np.searchsorted(parents[0][at[0]], np.arange(len(a) + 1))
        for k, text in enumerate(texts):
            yield (int(offsets[0][k + 1] - offsets[0][k]), int(offsets[1][k + 1] - offsets[1][k]),
                   text.as_py(), pairs[bounds[k]:bounds[k + 1]])

    def _ends(self, tokens: pa.ListArray, lengths: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, segments and (segment, byte end) of all tokens: sums run over all, then restart at each segment."""
        ids, parents = tokens.flatten(), pc.list_parent_indices(tokens)
        sums = pc.cumulative_sum(pc.take(lengths, ids)).to_numpy()
        before = np.append(0, sums)[tokens.offsets.to_numpy()[:-1]]
        parents = parents.to_numpy()
        return ids.to_numpy().astype(np.int64), parents, (parents << 32) + sums - before[parents]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays).astype(np.int32)))


def _joined(values: pa.Array, offsets: pa.Array, kind: pa.DataType) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(offsets, values), pa.scalar(b"" if kind == pa.binary() else "", kind))


ALIGNED = "chunk long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>, times array<int>, pairs array<long>, counts array<long>"


def align(docs: DataFrame, byte_model: str, piece_model: str) -> DataFrame:
    """Each text's alignment, in chunks: a row for each document, and one for each chunk of about CHUNK_LINKS links.

    A document's row has its counts, the hash of its groups' listing (`a1,a2|b1;a3|b2,b3`) and ``links``, the places
    of its id pairs in the chunk's ``pairs`` (A id times the size of B's vocabulary plus B id), with how often each is
    linked; the chunk's row (without a document) has those pairs and how often they are linked in all of it. Null and empty texts, and texts that
    either tokenizer does not keep byte for byte, have no tokens: zeros and an empty hash.
    """
    columns = f"doc_id {dict(docs.dtypes)['doc_id']}, {ALIGNED}"
    schema = arrow_schema(docs, columns)

    def run(batches):
        import hashlib

        from pyspark import TaskContext

        aligner = per_worker(("aligner", byte_model, piece_model), lambda: Aligner(byte_model, piece_model))
        chunk, rows, found = TaskContext.get().partitionId() << 32, [], []

        def close():
            table = pa.table({"pair": np.concatenate([np.zeros(0, np.int64), *found])})
            counted = table.group_by("pair", use_threads=False).aggregate([("pair", "count")])
            pairs = counted["pair"].combine_chunks()
            places = pc.index_in(table["pair"].combine_chunks(), pairs).to_numpy(zero_copy_only=False).astype(np.int64)
            n = len(rows)
            owner = np.repeat(np.arange(n), [len(f) for f in found])
            keys, times = np.unique(owner << 32 | places, return_counts=True)
            offsets = pa.array(np.searchsorted(keys >> 32, np.arange(n + 1)), pa.int32())
            of_docs = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (keys & 0xFFFFFFFF, times)]
            own = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
            docs_part = pa.RecordBatch.from_arrays(
                [own[0], pa.array([chunk] * n, pa.int64()), *own[2:], *of_docs,
                 pa.nulls(n, schema.field("pairs").type), pa.nulls(n, schema.field("counts").type)], schema=schema)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            chunk_part = pa.RecordBatch.from_arrays(
                [pa.nulls(1, schema.field("doc_id").type), pa.array([chunk], pa.int64()),
                 *[pa.nulls(1, f.type) for f in list(schema)[2:9]], one(pairs), one(counted["pair_count"].combine_chunks())],
                schema=schema)
            return docs_part, chunk_part

        held = 0
        for ids, made in _documents(batches, aligner):
            digest = ""
            pairs = np.zeros(0, np.int64)
            n_a = n_b = 0
            if made:
                n_a, n_b = sum(m[0] for m in made), sum(m[1] for m in made)
                pairs = np.concatenate([m[3] for m in made])
                hashed = hashlib.sha256()
                for k, m in enumerate(made):
                    hashed.update((m[2] if k + 1 < len(made) else m[2][:-1]).encode())
                digest = hashed.hexdigest()
            rows.append((ids, chunk, n_a, n_b, len(pairs), len(pairs), digest))
            found.append(pairs)
            held += len(pairs)
            if held >= CHUNK_LINKS or len(rows) >= 50_000:
                yield from close()
                chunk, rows, found, held = chunk + 1, [], [], 0
        if rows:
            yield from close()

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, columns)


def _documents(batches, aligner: Aligner):
    """(doc_id, its segments' results; none for a text without tokens) in order, RUN_BYTES of text aligned at once."""
    waiting: list[tuple] = []  # doc_id, results so far, segments to come
    queue: list[tuple] = []  # (waiting entry, segment)
    size = 0

    def work():
        for (entry, _), made in zip(queue, aligner.run([s for _, s in queue])):
            entry[1].append(made)
        queue.clear()

    def done(all_of_them: bool):
        upto = len(waiting) if all_of_them else next((k for k, w in enumerate(waiting) if len(w[1]) < w[2]), len(waiting))
        for doc_id, made, _ in waiting[:upto]:
            yield doc_id, made if all(m is not None for m in made) else []
        del waiting[:upto]

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            segments = aligner.segments(text) if text else []
            entry = (doc_id, [], len(segments))
            waiting.append(entry)
            for segment in segments:
                queue.append((entry, segment))
                size += len(segment)
                if size >= RUN_BYTES:
                    work()
                    size = 0
            if not queue:
                yield from done(False)
    if queue:
        work()
    yield from done(True)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """``pair, total, best``: how often an id pair is linked in the corpus, and whether no pair of its B id is more often."""
    parts = aligned.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select(
        F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    totals = parts.groupBy("pair").agg(F.sum("n").alias("total"))
    most = totals.groupBy((F.col("pair") % width).alias("b")).agg(F.max("total").alias("most"))
    return totals.join(most, F.col("pair") % width == F.col("b")).select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def link_counts(docs: DataFrame, byte_model: str, piece_model: str) -> DataFrame:
    """Per row ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` over the whole corpus.

    ``count_sum`` adds, over a document's links, how often the corpus links their id pair; ``n_best`` counts the links
    whose pair is its B id's most frequent one (ties included). Rows that repeat one another count each. Very long
    texts are cut at borders of both tokenizers (a letter or digit, a blank, a letter or digit), so only an unbroken
    text is aligned in one go; what is held of a long one are its id pairs. An empty table gives an empty result.

    Plan: texts are tokenised once, in place. Each chunk counts its pairs in Arrow; Spark adds the partial counts
    and sends every chunk the totals of its own pairs, so nothing is broadcast, and a pair that all texts hold is one
    row of each chunk.
    """
    width = len(PieceEncoder(piece_model, 1).widths)
    kind = dict(docs.dtypes)["doc_id"]
    aligned = materialise(align(docs, byte_model, piece_model), "aligned")
    counts = materialise(pair_counts(aligned, width), "pair-counts")
    asked = aligned.where("pairs IS NOT NULL").select(F.col("chunk").alias("of_chunk"), F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(counts, "pair").select("of_chunk", "place", "total", "best")
    rows = aligned.where("pairs IS NULL").drop("pairs", "counts")

    def total(key, own: pa.Table, table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table["place"])
        totals = pc.take(table["total"], order).combine_chunks()
        best = pc.cast(pc.take(table["best"], order).combine_chunks(), pa.int64())
        links, times = (own[c].combine_chunks() for c in ("links", "times"))
        at, parent, times = links.flatten(), pc.list_parent_indices(links).to_numpy(), times.flatten().to_numpy()
        made = {}
        for name, values in (("n_best", best), ("count_sum", totals)):
            sums = np.zeros(len(links), np.int64)
            np.add.at(sums, parent, times * pc.take(values, at).to_numpy(zero_copy_only=False))
            made[name] = pa.array(sums)
        return pa.table({"doc_id": own["doc_id"], "n_a": own["n_a"], "n_b": own["n_b"], "n_groups": own["n_groups"],
                         "n_links": own["n_links"], **made, "groups_sha256": own["groups_sha256"]})

    return rows.groupBy("chunk").cogroup(answers.groupBy("of_chunk")).applyInArrow(
        total, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

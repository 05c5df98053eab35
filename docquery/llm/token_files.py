"""Token files: ids in the fewest bits a vocabulary needs, block offsets for random access, shards in doc_id order.

A shard: ``header | blocks | document table | block table | footer``. A block packs up to BLOCK_IDS ids, least
significant bit first, and starts at a byte border, so one block can be read and unpacked with numpy alone. The
document table holds a document's first id and its number of ids, the block table each block's byte offset.
"""

from __future__ import annotations

import re
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from docquery.llm.common import per_worker, small_batches
from docquery.session import scratch_path

MAGIC = b"TOKBITS1"
HEADER = "<8sII"  # magic, bits of an id, ids of a block
FOOTER = "<QQQ8s"  # document table at, block table at, ids in all, magic
BLOCK_IDS = 1 << 16
SHARD_IDS = 1 << 23  # a shard closes at the first document end beyond this many ids
NO_ID = -(1 << 63)  # stands for a missing doc_id in a document table
ASCII_PARTS = re.compile(r"[a-z]+|[0-9]|[^a-z0-9\s]+")
MANIFEST = "shard int, first_id long, part string, path string, docs long, ids long"


def id_bits(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids to a run of ``bits``-wide fields."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 32:
        return ids.astype("<u4").tobytes()
    fields = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(fields.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", count).astype(np.uint32)
    if bits == 32:
        return np.frombuffer(data, "<u4", count).astype(np.uint32)
    fields = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (fields.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def _open(path: str):
    """The file system of a URI as Arrow sees it; executors reach the shared folder by it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


class ShardWriter:
    def __init__(self, path: str, bits: int):
        files, inner = _open(path)
        files.create_dir(inner.rpartition("/")[0], recursive=True)
        self.path, self.bits = path, bits
        self.out = files.open_output_stream(inner)
        self.out.write(struct.pack(HEADER, MAGIC, bits, BLOCK_IDS))
        self.at, self.count = struct.calcsize(HEADER), 0
        self.blocks: list[int] = []
        self.table: list[tuple[int, int, int]] = []
        self.held: list[np.ndarray] = []
        self.held_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.table.append((NO_ID if doc_id is None else doc_id, self.count, len(ids)))
        self.count += len(ids)
        self.held.append(ids)
        self.held_ids += len(ids)
        if self.held_ids >= 16 * BLOCK_IDS:
            self._write(whole=False)

    def _write(self, whole: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        upto = len(ids) if whole else len(ids) - len(ids) % BLOCK_IDS
        for start in range(0, upto, BLOCK_IDS):
            data = pack(ids[start:min(start + BLOCK_IDS, upto)], self.bits)
            self.blocks.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.held, self.held_ids = [ids[upto:]], len(ids) - upto

    def close(self) -> tuple[int, int]:
        self._write(whole=True)
        table = np.array(self.table, "<i8").reshape(-1, 3).tobytes()
        offsets = np.array([*self.blocks, self.at], "<u8").tobytes()
        self.out.write(table)
        self.out.write(offsets)
        self.out.write(struct.pack(FOOTER, self.at, self.at + len(table), self.count, MAGIC))
        self.out.close()
        return len(self.table), self.count


class ShardReader:
    """Random access to a shard; keeps the block it read last."""

    def __init__(self, path: str):
        files, inner = _open(path)
        self.file = files.open_input_file(inner)
        size = self.file.size()
        magic, self.bits, self.block_ids = struct.unpack(HEADER, self._at(0, struct.calcsize(HEADER)))
        table_at, blocks_at, self.count, end = struct.unpack(FOOTER, self._at(size - struct.calcsize(FOOTER), struct.calcsize(FOOTER)))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"not a token shard: {path}")
        self.table = np.frombuffer(self._at(table_at, blocks_at - table_at), "<i8").reshape(-1, 3)
        self.blocks = np.frombuffer(self._at(blocks_at, size - struct.calcsize(FOOTER) - blocks_at), "<u8").astype(np.int64)
        self.kept = (-1, np.zeros(0, np.uint32))

    def _at(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length, offset)

    def block(self, number: int) -> np.ndarray:
        if self.kept[0] != number:
            start, end = int(self.blocks[number]), int(self.blocks[number + 1])
            count = min(self.block_ids, self.count - number * self.block_ids)
            self.kept = (number, unpack(self._at(start, end - start), count, self.bits))
        return self.kept[1]

    def parts(self, first: int, length: int) -> Iterator[np.ndarray]:
        """Ids [first, first + length) of the shard, a block at most at a time."""
        while length > 0:
            number, inside = divmod(first, self.block_ids)
            part = self.block(number)[inside:inside + length]
            yield part
            first, length = first + len(part), length - len(part)

    def document(self, row: int) -> np.ndarray:
        _, first, length = self.table[row]
        return np.concatenate([np.zeros(0, np.uint32), *self.parts(int(first), int(length))])


def word_encoder(path: str, bits: int, cached: int = 2_000_000):
    """Text to ids, exactly as the tokenizer file has them.

    For a tokenizer whose normaliser and splitter look at nothing beyond white space, a text is the sequence of its
    pieces between spaces and line feeds: each distinct piece is encoded once by the library and kept, up to
    ``cached`` pieces, then the store starts anew. Other tokenizers get whole texts.
    """
    import json

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    kind, code = ("<u2", "H") if bits <= 16 else ("<u4", "I")
    if not _splits_at_blanks(json.loads(tokenizer.to_str())):
        return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
    special = any(not set(t["content"]) <= set("<|>_abcdefghijklmnopqrstuvwxyz")
                  for t in json.loads(tokenizer.to_str()).get("added_tokens") or [])
    store: dict[str, bytes] = {"": b""}

    def learn(pieces: list[str]) -> None:
        # plain ASCII pieces fall into words, digits and marks, as the splitter has it, whatever their case
        parts = {}
        for piece in pieces:
            if special or not piece.isascii() or "'" in piece or "<" in piece:
                parts[piece] = [piece]
            else:
                parts[piece] = ASCII_PARTS.findall(piece.lower())
        new = list({q for own in parts.values() for q in own if q not in store})
        for start in range(0, len(new), 4096):
            some = new[start:start + 4096]
            for part, found in zip(some, tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                store[part] = array(code, found.ids).tobytes()
        for piece, own in parts.items():
            store[piece] = b"".join([store[q] for q in own])

    def encode(text: str) -> np.ndarray:
        pieces = text.replace("\n", " ").split(" ")
        try:
            return np.frombuffer(b"".join([store[p] for p in pieces]), kind)
        except KeyError:
            if len(store) > cached:
                store.clear()
                store[""] = b""
            learn([p for p in set(pieces) if p not in store])
            return np.frombuffer(b"".join([store[p] for p in pieces]), kind)

    return encode


def _splits_at_blanks(spec: dict) -> bool:
    """Whether white space is dropped and never part of a token: the one layout of normaliser and splitter known so."""
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    pattern = (split.get("pattern") or {}).get("Regex", "")
    return ({s["type"] for s in steps} <= {"NFC", "Replace", "Lowercase"}
            and all(s["pattern"] == {"Regex": "\\s+"} and s["content"] == " " for s in steps if s["type"] == "Replace")
            and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True
            and pattern.endswith("|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+") and spec["model"].get("dropout") is None
            and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec.get("added_tokens") or []))


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int | None = 1, folder: str | None = None) -> DataFrame:
    """Encode every text and write shards in ascending doc_id order; returns the manifest, one row a shard.

    Null texts are empty; ``end_id`` is appended to each document. Rows without doc_id come first, rows that repeat
    a doc_id follow one another (by text). An empty table gives an empty manifest.

    Texts are dealt out in doc_id ranges and sorted in each; a task encodes its range and streams it into shards, so
    memory is a few blocks of ids. A task that runs again writes files of other names, and only the files named by
    the manifest count. The manifest is written once and read back, so that no later job encodes again.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)
    bits = id_bits(max(vocabulary, (end_id or 0) + 1))

    def write(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = per_worker(("words", tokenizer, bits), lambda: word_encoder(tokenizer, bits))
        end = np.array([] if end_id is None else [end_id], np.uint32)
        writer, first, shard, rows = None, None, 0, []
        part = uuid.uuid4().hex

        def close():
            n, ids = writer.close()
            rows.append((shard, first, part, writer.path, n, ids))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if writer is None:
                    writer, first = ShardWriter(f"{folder}/{part}-{shard:06d}.bin", bits), doc_id
                writer.add(doc_id, np.concatenate([encode(text or ""), end]).astype(np.uint32))
                if writer.count >= SHARD_IDS:
                    close()
                    writer, shard = None, shard + 1
        if writer is not None:
            close()
        if rows:
            names = ("shard", "first_id", "part", "path", "docs", "ids")
            types = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    dealt = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = small_batches(ordered).mapInArrow(write, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """From the files: ``doc_id, start, n_tokens, ids_crc32`` (crc32 of the ids as little-endian 32-bit integers).

    Shards follow one another by first doc_id, then by task and number; a doc_id's rows are all in one task. Only the
    manifest (a row for each shard of some million ids) is put in order; each shard is read by one task, a block at
    a time.
    """
    order = Window.orderBy(F.col("first_id").asc_nulls_first(), "part", "shard").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("ids").over(order), F.lit(0)))

    def read(batches):
        import zlib

        import pyarrow as pa

        for batch in batches:
            for path, before in zip(*(c.to_pylist() for c in batch.columns)):
                shard = ShardReader(path)
                for start in range(0, len(shard.table), 4096):
                    part = shard.table[start:start + 4096]
                    sums = []
                    for _, first, length in part:
                        crc = 0
                        for ids in shard.parts(int(first), int(length)):
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    ids = pa.array([None if d == NO_ID else int(d) for d in part[:, 0]], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(part[:, 1] + before), pa.array(part[:, 2].copy()), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = placed.select("path", F.col("before").cast("long")).repartition(max(1, manifest.count()), "path")
    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

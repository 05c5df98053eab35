"""SentencePiece encoding that keeps offsets: every piece points at the bytes of the text it came from."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from docquery.llm.common import map_rows, per_worker

BLANK = "▁".encode()  # what a space becomes in normalised text
# Fixed values of the model format: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
# A worker keeps its chunk store between stages, so the store is bounded in bytes, whatever the chunks' number and length.
STORE_BYTES = 16 << 20
CHUNK_BYTES = 130  # of a stored chunk besides its own bytes and those of its ids


class CharacterMap:
    """The compiled character map: a double-array trie of source strings over a pool of replacements.

    Layout: trie size in bytes, trie of 32-bit units, replacements that end in a zero byte. A unit holds a label in
    bits 0-7, "a value follows" in bit 8, its offset from bit 10 (shifted by 8 more if bit 9 is set); a value has bit 31.
    """

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.pool = blob[4 + size:] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest source string that starts at ``at``."""
        if not self.units:
            return None
        found, node = None, 0
        node ^= _offset(self.units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & (0x80000000 | 0xFF) != data[k]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = k + 1 - at, self.pool[start:self.pool.index(b"\0", start)]
        return found


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 0x200) >> 6)


class Normaliser:
    """Text bytes to normalised bytes plus, for each of them and for the end, the byte of the text it stems from."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = (
            spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int64)
        pieces, source = self._mapped(data)
        if self.squeeze:
            pieces, source = _squeezed(pieces, source)
            if not pieces:
                return b"", np.zeros(1, np.int64)
        if self.prefix:
            pieces, source = b" " + pieces, np.concatenate([source[:1], source])
        if not self.escape:
            return pieces, source
        widths = np.where(np.frombuffer(pieces, np.uint8) == 0x20, len(BLANK), 1)
        return pieces.replace(b" ", BLANK), np.append(np.repeat(source[:-1], widths), source[-1])

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not self.map.units:  # identity
            return data, np.arange(len(data) + 1)
        out, source, at = [], [], 0
        while at < len(data):
            found = self.map.longest(data, at)
            if found is None:
                length = _character(data, at)
                found = length, data[at:at + length]
            out.append(found[1])
            source.append(np.full(len(found[1]), at))
            at += found[0]
        return b"".join(out), np.concatenate([*source, [len(data)]]).astype(np.int64)


def _character(data: bytes, at: int) -> int:
    lead = data[at]
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


def _squeezed(data: bytes, source: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Without leading, trailing and doubled spaces."""
    blank = np.frombuffer(data, np.uint8) == 0x20
    keep = ~blank | np.append([False], ~blank[:-1])
    last = len(blank) - np.argmax(~blank[::-1]) if (~blank).any() else 0
    keep[last:] = False
    return np.frombuffer(data, np.uint8)[keep].tobytes(), np.append(source[:-1][keep], source[last])


class PieceEncoder:
    """Ids of a text with the span of text bytes of each, as one model has them; decoding is the model's own.

    No piece of a model that splits by white space spans the border between another character and a blank, so the
    normalised text is cut there and each distinct chunk is encoded once (they are kept up to about ``store_bytes``, then
    the store starts anew). For other models a text is one chunk. Chunks that start with the blank the prefix would add are
    handed to the library as they are read; the ids are those of the whole text.
    """

    def __init__(self, model: str, store_bytes: int = STORE_BYTES):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as file:
            proto.ParseFromString(file.read())
        self.normaliser = Normaliser(proto.normalizer_spec)
        surfaces = [BLANK.decode() if not p.piece else p.piece for p in proto.pieces]
        self.widths = np.array([1 if p.type == BYTE else len(s.encode()) for p, s in zip(proto.pieces, surfaces)])
        mark = BLANK.decode()
        identity = not proto.normalizer_spec.precompiled_charsmap and not proto.normalizer_spec.remove_extra_whitespaces
        self.cut = (identity and proto.normalizer_spec.add_dummy_prefix and proto.normalizer_spec.escape_whitespaces
                    and not any(mark in s.lstrip(mark) or p.type in (USER_DEFINED, UNKNOWN) and mark in s
                                for p, s in zip(proto.pieces, surfaces)))
        self.numbers = [str(i).encode() for i in range(len(surfaces))]
        self.decoded = [bytes([int(s[1:-1], 16)]) if p.type == BYTE else None if p.type in (UNKNOWN, CONTROL)
                        else s.replace(mark, " ").encode() for p, s in zip(proto.pieces, surfaces)]
        self.plain = self.cut  # decoding drops the one blank that the prefix added, and nothing else
        self.unknown = any(p.type == BYTE for p in proto.pieces)
        self.blank = np.array([self.model.piece_to_id(mark)], "<i4").tobytes()  # alone: the library drops it
        self.cut &= self.model.piece_to_id(mark) != self.model.unk_id()
        self.store: dict[bytes, bytes] = {b"": self.blank}
        self.held, self.store_bytes = 0, store_bytes

    def encode(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first byte and the byte after the last of each piece's span."""
        normal, source = self.normaliser(data)
        ids = self._cut(normal) if self.cut else np.array(
            self.model.encode(data.decode("utf-8", "replace")), np.int32)
        ends = np.cumsum(self.widths[ids])
        if not self.unknown or len(ends) and ends[-1] != len(normal):
            ends = self._searched(ids, normal)
        begins = np.concatenate([[0], ends[:-1]]) if len(ids) else ends
        return ids, source[begins], source[ends]

    def _cut(self, normal: bytes) -> np.ndarray:
        # a chunk: blanks, then what follows up to the next blank
        words = normal.split(BLANK)
        chunks, run = [], 1
        if len(words) == 1:
            chunks = words if normal else []
        else:
            for word in words[1:]:
                if word:
                    chunks.append(word if run == 1 else BLANK * (run - 1) + word)
                    run = 1
                else:
                    run += 1
            if run > 1:
                chunks.append(BLANK * (run - 2))
        store = self.store
        try:
            return np.frombuffer(b"".join([store[c] for c in chunks]), "<i4")
        except KeyError:
            new = [c for c in set(chunks) if c not in store]
            # the library adds the first blank itself
            found = self.model.encode([c.decode().replace(BLANK.decode(), " ") for c in new], num_threads=1)
            fresh = {c: np.array(ids, "<i4").tobytes() for c, ids in zip(new, found)}
            store.update(fresh)
            out = np.frombuffer(b"".join([store[c] for c in chunks]), "<i4")
            self.held += sum(CHUNK_BYTES + len(c) + len(ids) for c, ids in fresh.items())
            if self.held > self.store_bytes:
                store.clear()
                store[b""] = self.blank
                self.held = 0
            return out

    def _searched(self, ids: np.ndarray, normal: bytes) -> np.ndarray:
        """Ends of pieces where an unknown piece has no fixed width: what lies up to the next known piece."""
        pieces = [self.model.id_to_piece(int(i)).encode() for i in ids]
        ends, at = [], 0
        for k, piece in enumerate(pieces):
            if int(ids[k]) == self.model.unk_id():
                after = next((p for i, p in zip(ids[k + 1:], pieces[k + 1:]) if int(i) != self.model.unk_id()), None)
                at = normal.index(after, at + 1) if after else len(normal)
            else:
                at += 1 if self.model.is_byte(int(ids[k])) else len(piece)
            ends.append(at)
        return np.array(ends, np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The model's decoding, in UTF-8; ids without control pieces or broken byte runs are looked up here."""
        if self.plain:
            try:
                found = b"".join([self.decoded[i] for i in ids.tolist()])[1:]
                found.decode()
                return found
            except (TypeError, UnicodeDecodeError):
                pass
        return self.model.decode(ids.tolist()).encode()


SPANS = "ids array<int>, begins array<int>, ends array<int>"


def encode_pieces(docs: DataFrame, model: str, columns: str = SPANS,
                  row: Callable | None = None) -> DataFrame:
    """``doc_id`` plus, for each text, its piece ids and their byte spans, or what ``row`` makes of them in the task.

    ``row`` takes the encoder, the text's bytes, ids, first bytes and end bytes, and returns values for ``columns``
    (so that digests or decoded texts leave the task without the arrays). A piece that only stands for the added
    blank has an empty span; pieces of one character that falls back to bytes get the bytes of that character.
    Null and empty texts have no piece. One output row for each row, repeated rows included; an empty table gives an
    empty result. Narrow: no shuffle. Memory: one batch of texts, the model and the chunk store.
    """
    row = row or (lambda encoder, data, ids, begins, ends: (ids, begins, ends))

    def make():
        encoder = per_worker(("pieces", model), lambda: PieceEncoder(model))

        def one(doc_id, data):
            data = data or b""
            return doc_id, *row(encoder, data, *encoder.encode(data))

        return one

    texts = docs.selectExpr("doc_id", "CAST(text AS BINARY) AS text")
    return map_rows(texts, f"doc_id {dict(docs.dtypes)['doc_id']}, {columns}", make)


def decode_pieces(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``doc_id, text``: the model's decoding of each row's ids (null: null)."""

    def make():
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        return lambda doc_id, own: (doc_id, None if own is None else processor.decode(own))

    return map_rows(encoded.select("doc_id", ids), f"doc_id {dict(encoded.dtypes)['doc_id']}, text string", make)


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(encoder: PieceEncoder, data: bytes, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple:
    """Counts and hashes of a text's ids and of its decoded text; checks that the spans tile the text."""
    import hashlib

    if len(ids) and (begins[0] != 0 or ends[-1] != len(data)):
        raise ValueError("spans do not tile the text")
    listed = b",".join([encoder.numbers[i] for i in ids.tolist()])
    return (len(ids), hashlib.sha256(listed).hexdigest(),
            hashlib.sha256(encoder.decode(ids)).hexdigest())

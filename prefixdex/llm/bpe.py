"""Byte-level BPE by a sentencepiece model written from the rank file.

Each byte is mapped to one visible character, a piece is the mapped bytes of a
vocabulary entry and its score the negative rank, so sentencepiece's merges
(best score first, leftmost of equals) are those of the ranks. The model is
serialised here, field by field, with identity normalisation: no dummy prefix,
no space folding, no escaping. Texts are cut by the tokenizer's pattern and each
match is encoded on its own; a match that is itself an entry is that entry.
Decoding maps each id to its piece and the piece back to its bytes.

Defined cases: null is the empty text and has no ids; rows are independent, so
repeated rows and ids, null ids and further columns pass through; an empty
table gives an empty result; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixdex.llm import words

#: Matches remembered by each worker, and their bytes with their ids; when full, the
#: memory starts anew.
REMEMBER = 200_000
REMEMBER_BYTES = 64 << 20


def byte_characters() -> list[str]:
    """The visible character of every byte: printable ones stand for themselves,
    the others follow from code point 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def read_ranks(raw: bytes) -> list[bytes]:
    """Entries of a rank file, by rank."""
    pairs = (line.split() for line in raw.splitlines() if line.strip())
    ranked = {int(rank): base64.b64decode(entry) for entry, rank in pairs}
    return [ranked[k] for k in range(len(ranked))]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(entries: list[bytes]) -> bytes:
    """The sentencepiece model of the entries; id of an entry: its rank + 1."""
    shown = byte_characters()
    unknown = _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)
    pieces = [unknown] + [
        _field(1, "".join(shown[b] for b in e).encode()) + _field(2, float(-rank)) + _field(3, 1)
        for rank, e in enumerate(entries)
    ]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    def __init__(self, model: bytes, pattern: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        shown = byte_characters()
        back = {c: b for b, c in enumerate(shown)}
        self.table = shown
        count = self.processor.get_piece_size()
        self.pieces = [bytes(back[c] for c in self.processor.id_to_piece(i)) for i in range(1, count)]
        self.ids = {p: k for k, p in enumerate(self.pieces)}
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, matches: set[str]) -> None:
        if len(self.known) + len(matches) > REMEMBER or self.held > REMEMBER_BYTES:
            self.known, self.held = {}, 0
        rest = []
        for m in matches:
            whole = self.ids.get(m.encode())
            if whole is None:
                rest.append(m)
            else:
                self.known[m] = struct.pack("<I", whole)
        mapped = ["".join([self.table[b] for b in m.encode()]) for m in rest]
        for m, ids in zip(rest, self.processor.encode(mapped, num_threads=1), strict=True):
            self.known[m] = (np.asarray(ids, "<u4") - 1).astype("<u4").tobytes()
            self.held += len(m) + len(self.known[m])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        matches = self.find(text)
        try:
            return b"".join([self.known[m] for m in matches])
        except KeyError:
            distinct = set(matches)
            if len(distinct) > REMEMBER // 2:  # in bounded steps
                return b"".join(self._each(matches))
            self._learn({m for m in distinct if m not in self.known})
            if any(m not in self.known for m in distinct):  # the memory was emptied
                self._learn(distinct)
            return b"".join([self.known[m] for m in matches])

    def _each(self, matches: list[str]):
        step = REMEMBER // 4
        for lo in range(0, len(matches), step):
            some = set(matches[lo : lo + step])
            self._learn({m for m in some if m not in self.known})
            if any(m not in self.known for m in some):
                self._learn(some)
            yield b"".join([self.known[m] for m in matches[lo : lo + step]])

    def decode(self, ids: bytes) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


def _model(spark, path: str, pattern: str):
    """The vocabulary file is read once, where the job is set up, and its model
    (a few hundred kilobytes, whatever the data) goes to the tasks."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((serialise(read_ranks(f.read())), pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id_column and ``ids``: the token ids as packed 32-bit integers."""
    shared = _model(docs.sparkSession, path, pattern)

    def run(batches):
        codec = Codec(*shared.value)
        for rows, data, offsets in words.parts(batches, "body"):
            raw = data.tobytes()
            ids = [codec.encode(raw[offsets[i] : offsets[i + 1]].decode()) for i in range(rows.num_rows)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.binary())], [id_column, "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text).alias("body")).mapInArrow(run, f"`{id_column}` {kind}, ids binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (packed), n_tokens, ids_sha256, decoded_sha256 and n_bytes of
    the decoded text, all from one pass."""
    shared = _model(docs.sparkSession, path, pattern)

    def run(batches):
        codec = Codec(*shared.value)
        for rows, data, offsets in words.parts(batches):
            raw = data.tobytes()
            ids = [codec.encode(raw[offsets[i] : offsets[i + 1]].decode()) for i in range(rows.num_rows)]
            back = [codec.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(ids, pa.binary()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                    pa.array([len(x) for x in back], pa.int64()),
                ],
                ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"],
            )

    schema = "doc_id long, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)

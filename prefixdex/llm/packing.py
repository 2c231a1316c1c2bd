"""Best-fit packing of documents into token sequences of a fixed size.

A document's tokens are those of a tokenizer file, then an end token. A text is
cut at white space, which the tokenizer drops and does not look across, and chunks
of plain characters are cut further, as the tokenizer's own pattern would; each
distinct unit of a batch is encoded once. Documents longer than a sequence are cut
into pieces of its size.

Pieces are packed by best-fit decreasing: longest first, each into the open
sequence with the least room that still holds it. A segment tree over the
remaining capacities finds that sequence: its leaves are the capacities, each
with the sequences that have so much left, its inner nodes count them, so the
tightest fit takes a number of steps that is the logarithm of the sequence size,
however many sequences are open. Pieces as long as a sequence are one each. The
others are dealt over shards by a hash of the row, ``SHARD`` pieces each, and a
shard is packed in one task, with bounded memory. The sequences that a shard leaves a
quarter empty or more are taken apart and packed together with those of the other
shards, so that a shard costs no sequence of its own.

Defined cases: a null or empty text is the end token alone; rows that repeat a
doc_id, and rows with a null doc_id, are documents of their own; very long texts
and words are encoded whole; an empty table gives an empty result; further
columns are not looked at (``pieces`` reads doc_id and text only); equal lengths
are packed in the order of the rows.
"""

from __future__ import annotations

import functools
import operator
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixdex.llm import tables, words
from prefixdex.llm.bpe import byte_characters

SIZE = 4096
END = 1
SHARD = 32_000  # pieces packed in one task, on average
LOOSE = 4  # a sequence with 1/4 left is packed again
REMEMBER = 300_000  # units that a worker remembers; when full, it starts anew
LONGEST = 64  # bytes of a unit that is remembered
PART = 4 << 20  # bytes of text worked on together


@functools.lru_cache(maxsize=2)
def _tokenizer(definition: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition), {}


def _classes() -> np.ndarray:
    """What the tokenizer's cutting tells apart in a chunk of plain characters: 1 letters,
    2 digits (cut one by one), 3 other printable ASCII; 0 is for all that is not plain
    (the apostrophe, which contractions begin with, is not)."""
    out = np.zeros(256, np.int8)
    out[33:127] = 3
    out[ord("'")] = 0
    for lo, hi, kind in (("a", "z", 1), ("A", "Z", 1), ("0", "9", 2)):
        out[ord(lo) : ord(hi) + 1] = kind
    return out


_CLASS = _classes()
_ID = operator.attrgetter("id")
_LATIN = 0xC3  # first byte of the letters from U+00C0 to U+00FF ...
_SIGNS = (0x97, 0xB7)  # ... but for two signs


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and plainness of the units that are encoded on their own, and the bytes
    they are read from. A chunk of plain characters (ASCII and Latin-1 letters) is
    lower-cased and cut into letters, digits and others, as the tokenizer would; any
    other chunk is one unit, which the tokenizer normalises and cuts itself."""
    starts, ends = words.spans(data, offsets)
    kind, body = _CLASS[data], words.LOWER[data]
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == _LATIN
    latin = second & (data != _SIGNS[0]) & (data != _SIGNS[1])
    capital = latin & (data >= 0x80) & (data <= 0x9E)
    body[capital] += 0x20
    lead = np.flatnonzero(latin) - 1
    kind[lead] = kind[lead + 1] = 1
    special = np.zeros(len(data), bool)  # "<|" may begin a special token
    special[1:] = (data[1:] == ord("|")) & (data[:-1] == ord("<"))
    odd = np.flatnonzero((kind == 0) & ~words.WS[data] | special)
    whole = np.zeros(len(starts), bool)
    whole[np.searchsorted(starts, odd, "right") - 1] = True
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[whole]] = 1
    edge[ends[whole]] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    kind[inside] = 4
    body[inside] = data[inside]
    first = np.zeros(len(data) + 1, bool)
    first[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    first[:-1] &= ~words.WS[data]
    first[starts] = True
    last = np.zeros(len(data) + 1, bool)  # a unit ends where the next begins, or its chunk ends
    last[:-1] = first[:-1] & ~words.WS[data]
    last[starts] = False
    last[ends] = True
    first = np.flatnonzero(first[:-1])
    return first, np.flatnonzero(last), ~inside[first], body


class Encoder:
    """Token ids of texts given as one byte array, by distinct units."""

    def __init__(self, definition: str):
        self.tokenizer, self.known = _tokenizer(definition)
        self.model, self.shown = self.tokenizer.model, byte_characters()

    def _encode(self, unit: bytes, plain: bool) -> bytes:
        if plain:
            shown = unit.decode("ascii") if unit.isascii() else "".join([self.shown[b] for b in unit])
            return array("I", map(_ID, self.model.tokenize(shown))).tobytes()
        return array("I", self.tokenizer.encode(unit.decode(errors="replace"), add_special_tokens=False).ids).tobytes()

    def _ids(self, keys: list[bytes], plain: list[bool]) -> list[bytes]:
        known, out = self.known, []
        for k, p in zip(keys, plain, strict=True):
            ids = known.get(k)
            if ids is None:
                ids = self._encode(k, p)
                if len(k) <= LONGEST:
                    if len(known) >= REMEMBER:
                        known.clear()
                    known[k] = ids
            out.append(ids)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (and the last's end)."""
        starts, ends, plain, body = units(data, offsets)
        first, kind = words.distinct(body, starts, ends)
        raw = body.tobytes()
        each = self._ids([raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], plain[first].tolist())
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), "<u4")
        begin = np.cumsum(size) - size
        n = size[kind] if len(kind) else np.zeros(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(upto[-1]) + np.repeat(begin[kind] - upto[:-1], n)] if upto[-1] else flat[:0]
        return ids, upto[np.searchsorted(starts, offsets)]


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END, ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row and, if
    asked for, the packed ``ids``."""
    with open(path, encoding="utf-8") as f:  # a fixed file, whatever the data
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        encoder = Encoder(shared.value)
        last = np.array([end], "<u4").tobytes()
        for rows, data, offsets in words.parts(batches, size=PART):
            flat, at = encoder.encode(data, offsets)
            row, piece, start, length, crc, body = [], [], [], [], [], []
            for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                whole = flat[lo:hi].tobytes() + last
                for k, a in enumerate(range(0, hi - lo + 1, size)):
                    part = whole[4 * a : 4 * (a + size)]
                    row.append(i), piece.append(k), start.append(a), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if ids:
                        body.append(part)
            columns = [rows.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if ids:
                columns.append(pa.array(body, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


class Capacities:
    """Segment tree over the remaining capacities 0..size of open sequences."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, left: int, sequence: int) -> None:
        self.open[left].append(sequence)
        count, at = self.count, left + self.leaves
        while at:
            count[at] += 1
            at >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """The least capacity that holds ``length``, and one of its sequences, which is
        taken out of the tree."""
        count, at = self.count, length + self.leaves
        if not count[at]:
            while at & 1 or not count[at + 1]:  # up to the next subtree to the right that has any
                at >>= 1
                if at <= 1:
                    return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        left = at - self.leaves
        while at:
            count[at] -= 1
            at >>= 1
        return left, self.open[left].pop()


def best_fit(length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of every length (given in the order of ties), and what is
    left of every sequence."""
    tree, room = Capacities(size), []
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for i in np.argsort(-length, kind="stable").tolist():
        n = int(length[i])
        left, s = tree.take(n) or (size, len(room))
        if s == len(room):
            room.append(size)
        sequence[i], offset[i] = s, size - left
        room[s] = left - n
        if room[s]:
            tree.add(room[s], s)
    return sequence, offset, np.array(room, np.int64)


def _packed(rows: DataFrame, size: int, turn: int) -> DataFrame:
    """``rows`` with sequence_id, offset and ``__loose``, shard by shard."""
    shards = 1 + rows.count() // SHARD
    schema = tables.extended(rows.schema, sequence_id="long", offset="long", __loose="boolean")
    names = schema.names

    def run(shard, rows):
        rows = rows.drop_columns(["__shard"])
        rows = rows.take(pa.array(np.argsort(rows["__row"].to_numpy(), kind="stable")))
        sequence, offset, left = best_fit(rows["length"].to_numpy(), size)
        # Shards of a turn have runs of 2^32 numbers; turns have halves of the numbers.
        ids = sequence + (shard[0].as_py() << 32) + (turn << 62)
        loose = LOOSE * left >= size
        return pa.table([*rows.columns, pa.array(ids), pa.array(offset), pa.array(loose[sequence] if len(sequence) else np.zeros(0, bool))], names=names)

    # The turn is part of the hash: what one shard left goes to several.
    shard = F.pmod(F.xxhash64("__row", F.lit(turn)), F.lit(shards))
    return rows.withColumn("__shard", shard).groupBy("__shard").applyInArrow(run, schema)


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """``cut`` (with a column ``length``, at most ``size``) with sequence_id and offset."""
    # A row's number only has to be the same each time the saved rows are read.
    rows = tables.save(cut.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    whole = rows.where(F.col("length") == size).withColumn("sequence_id", -1 - F.col("__row")).withColumn("offset", F.lit(0).cast("long"))
    first = tables.save(_packed(rows.where(F.col("length") < size), size, 0), "packed")
    tight = first.where(~F.col("__loose")).drop("__loose")
    again = _packed(first.where("__loose").drop("sequence_id", "offset", "__loose"), size, 1).drop("__loose")
    return whole.unionByName(tight).unionByName(again).drop("__row")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, doc_ids, ids): the sequences themselves, from pieces
    packed with their ids; a sequence is at most ``size`` tokens, so groups are small."""
    part = F.struct("offset", "length", "doc_id", "ids")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select(
        "sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"),
        F.col("p.doc_id").alias("doc_ids"), joined.alias("ids"),
    )

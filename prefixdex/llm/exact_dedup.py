"""Exact dedup by composable polynomial fingerprints.

A text is normalised by deleting ``[\\x20\\x09-\\x0D]``. Its fingerprint is the
value of the polynomial whose coefficients are its bytes, modulo two primes,
together with its length. Chunks are hashed on their own and combined by
length-shifted arithmetic, ``h(xy) = h(x) * B^len(y) + h(y)``, so the chunks of
a huge text can be hashed in any grouping and no text is walked byte by byte.

Equal fingerprints are only candidates: the texts of a group are cut into
chunks and each chunk is compared with the same chunk of the row that stays.
Rows that differ form candidates anew, until all groups hold equal texts.

Defined cases: null counts as the empty text and all empty texts are equal;
rows that repeat a doc_id are rows of their own (one of equal rows stays, the
other is dropped); a null doc_id ranks after every other id; an empty table
gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixdex.llm import tables, words

CHUNK = 1 << 16
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_000_003, 998_244_353)


def combine(left: tuple[int, int], right: tuple[int, int], prime: int, base: int) -> tuple[int, int]:
    """(hash, length) of two texts one after the other, from theirs."""
    return (left[0] * pow(base, right[1], prime) + right[0]) % prime, left[1] + right[1]


def _powers(prime: int, base: int, n: int) -> np.ndarray:
    """base^(n-1) ... base^0 modulo prime, by repeated doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime), out])
    return out[-n:]


class Fingerprint:
    """Hashes chunks of bytes; products of a byte and a power are below 2^39,
    so a chunk's sum needs no reduction before its end."""

    def __init__(self, primes=PRIMES, bases=BASES, chunk: int = CHUNK):
        self.primes, self.bases, self.chunk = primes, bases, chunk
        self.powers = [_powers(p, b, chunk) for p, b in zip(primes, bases, strict=True)]

    def of_chunk(self, data: np.ndarray, k: int) -> tuple[int, int]:
        n = len(data)
        return int(np.dot(data.astype(np.uint64), self.powers[k][self.chunk - n :])) % self.primes[k], n

    def of(self, data: np.ndarray) -> list[int]:
        out = []
        for k, (p, b) in enumerate(zip(self.primes, self.bases, strict=True)):
            whole = (0, 0)
            for lo in range(0, len(data), self.chunk):
                whole = combine(whole, self.of_chunk(data[lo : lo + self.chunk], k), p, b)
            out.append(whole[0])
        return out


_FP = "fp_a long, fp_b long, n_bytes long"


def _normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = ~words.WS[data]
    before = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], before[offsets]


def fingerprints(docs: DataFrame, primes=PRIMES, bases=BASES) -> DataFrame:
    """doc_id, fp_a, fp_b, n_bytes, n_points (code points of the whole text) and
    text_sha256 (of the normalised text) of every row."""

    def run(batches):
        fp = Fingerprint(primes, bases)
        for rows, data, offsets in words.parts(batches):
            norm, at = _normalised(data, offsets)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
            each = [norm[at[i] : at[i + 1]] for i in range(rows.num_rows)]
            prints = np.array([fp.of(x) for x in each], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(prints[:, 0]),
                    pa.array(prints[:, 1]),
                    pa.array(np.diff(at)),
                    pa.array(np.diff(points)),
                    pa.array([hashlib.sha256(x).hexdigest() for x in each]),
                ],
                ["doc_id", "fp_a", "fp_b", "n_bytes", "n_points", "text_sha256"],
            )

    schema = f"doc_id long, {_FP}, n_points long, text_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _chunks(docs: DataFrame, groups: DataFrame, primes, bases) -> DataFrame:
    """The chunks of every row whose fingerprint occurs in ``groups``."""

    def prints(batches):
        fp = Fingerprint(primes, bases)
        for rows, data, offsets in words.parts(batches):
            norm, at = _normalised(data, offsets)
            each = [norm[at[i] : at[i + 1]] for i in range(rows.num_rows)]
            found = np.array([fp.of(x) for x in each], np.int64).reshape(-1, 2)
            binary = pa.array([x.tobytes() for x in each], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(np.diff(at)), binary,
                 pa.array([hashlib.sha256(x).hexdigest() for x in each])],
                ["fp_a", "fp_b", "n_bytes", "norm", "text_sha256"],
            )

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                body = batch.column(3)[i].as_buffer()
                n = max(1, -(-body.size // CHUNK))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.repeat(batch.column(k)[i], n) for k in (0, 1, 2)),
                        pa.repeat(batch.column(4)[i], n),
                        pa.array(np.arange(n, dtype=np.int32)),
                        pa.array([body.slice(k * CHUNK, min(CHUNK, body.size - k * CHUNK)).to_pybytes() for k in range(n)], pa.binary()),
                    ],
                    ["fp_a", "fp_b", "n_bytes", "text_sha256", "chunk_no", "chunk"],
                )

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(prints, f"{_FP}, norm binary, text_sha256 string")
    found = found.join(groups.select("fp_a", "fp_b", "n_bytes").hint("merge"), ["fp_a", "fp_b", "n_bytes"], "left_semi")
    return found.select("fp_a", "fp_b", "n_bytes", "norm", "text_sha256").mapInArrow(
        cut, f"{_FP}, text_sha256 string, chunk_no int, chunk binary"
    )


_KEY = ["fp_a", "fp_b", "n_bytes", "sub"]


def _ranked():
    """The largest is the row that stays: most code points, then smallest id."""
    return F.struct("n_points", F.coalesce(-F.col("doc_id"), F.lit(-(1 << 63))).alias("neg"), "row", "text_sha256", "doc_id")


def classes(docs: DataFrame, primes=PRIMES, bases=BASES) -> DataFrame:
    """One row per document row: doc_id, keep_id, group_size, kept, text_sha256
    and the fingerprint."""
    rows = tables.save(fingerprints(docs, primes, bases).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    rows = rows.withColumn("sub", F.lit(0))

    def grouped(r):
        best = r.groupBy(*_KEY).agg(F.max(_ranked()).alias("best"), F.count(F.lit(1)).alias("group_size"))
        return best.select(*_KEY, "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("best.text_sha256").alias("keep_sha"))

    groups = tables.save(grouped(rows), "groups")
    # One differing chunk is enough. Copies of a text count as one: they share
    # every chunk, so the comparison runs over distinct (text, chunk) rows.
    repeated = groups.where("group_size > 1")
    chunks = _chunks(docs, repeated, primes, bases)
    versions = chunks.groupBy("fp_a", "fp_b", "n_bytes", "chunk_no").agg(
        F.min("chunk").alias("low"), F.max("chunk").alias("high")
    )
    mixed = tables.save(versions.where("low <> high").select("fp_a", "fp_b", "n_bytes").distinct(), "collisions")
    step = 0
    while not mixed.isEmpty():
        # A fingerprint with different texts: those that differ from the row
        # that stays, in any chunk, become candidates of their own.
        step += 1
        cut = _chunks(docs, mixed, primes, bases).distinct()
        lead = groups.where(F.col("sub") == step - 1).select("fp_a", "fp_b", "n_bytes", F.col("keep_sha"))
        heads = cut.join(lead, ["fp_a", "fp_b", "n_bytes"]).where("text_sha256 = keep_sha")
        heads = heads.select("fp_a", "fp_b", "n_bytes", "chunk_no", F.col("chunk").alias("head"))
        differ = cut.join(heads, ["fp_a", "fp_b", "n_bytes", "chunk_no"]).where("chunk <> head")
        differ = differ.select("fp_a", "fp_b", "n_bytes", "text_sha256", F.lit(True).alias("differs")).distinct()
        rows = rows.join(differ, ["fp_a", "fp_b", "n_bytes", "text_sha256"], "left")
        rows = rows.withColumn("sub", F.when(F.col("differs") & (F.col("sub") == step - 1), step).otherwise(F.col("sub")))
        rows = tables.save(rows.drop("differs"), "rows")
        groups = tables.save(grouped(rows), "groups")
        again = groups.where((F.col("sub") == step) & (F.col("group_size") > 1)).select("fp_a", "fp_b", "n_bytes")
        several = rows.where(F.col("sub") == step).join(again, ["fp_a", "fp_b", "n_bytes"], "left_semi")
        several = several.groupBy("fp_a", "fp_b", "n_bytes").agg(F.min("text_sha256").alias("a"), F.max("text_sha256").alias("b"))
        mixed = tables.save(several.where("a <> b").select("fp_a", "fp_b", "n_bytes"), "collisions")
    return rows.join(groups, _KEY).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "n_points", "fp_a", "fp_b", "n_bytes"
    )


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    key = ["__id", "__sha", "__points"]
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    kept = classes(docs).where("kept").select(ident.alias("__id"), F.col("text_sha256").alias("__sha"), F.col("n_points").alias("__points"))
    text = F.coalesce("text", F.lit(""))
    norm = F.sha2(F.translate(text, " \t\n\x0b\x0c\r", "").cast("binary"), 256)
    keyed = docs.withColumn("__id", ident).withColumn("__sha", norm).withColumn("__points", F.length(text).cast("long"))
    return keyed.join(kept.hint("merge"), key, "left_semi").dropDuplicates(key).drop(*key)

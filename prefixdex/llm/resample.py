"""Target-distribution importance resampling.

A text's features are its runs of 1 to ``ngrams`` consecutive words (words: digits,
ASCII letters in lower case, everything beyond ASCII), joined by one space, and a
feature's bucket is its crc32 modulo ``buckets``. Two arrays count the buckets over
all documents and over all texts of the target; a bucket's gain is the log ratio of
its smoothed shares in thousandths, floored, and a document's weight the floored
mean of the gains of its features, looked up in one array of fixed size.

The draw is without replacement: Gumbel noise from a hash of the id is added to each
weight, and the highest scores among the documents with enough words are drawn. Their
exact ranks come from ``regular_sort``.

Defined cases: a null or empty text has no features, weight 0 and no rank; rows that
repeat a doc_id are documents of their own with the same noise, equal ones in any order;
a null doc_id counts as the empty text in the hash and comes last among equal scores; an
empty table or target gives gains of the smoothing alone; texts of any length are read
whole; further columns are carried along by ``drawn`` and not looked at otherwise.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixdex.llm import tables, words
from prefixdex.llm.regular_sort import ranked

BUCKETS = 10_000
NGRAMS = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
_SHORT = 128  # bytes of a feature that is hashed with the others of its part


def _crc_table() -> np.ndarray:
    """Remainder of every byte by the reflected polynomial of crc32."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1).astype(np.uint32)
    return value


_TABLE = _crc_table()


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of every span; all spans of a part advance together, byte by byte."""
    size = ends - starts
    order = np.argsort(np.minimum(size, _SHORT + 1).astype(np.uint8), kind="stable")[::-1]
    long = int((size > _SHORT).sum())
    out = np.empty(len(starts), np.uint32)
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    order = order[long:]
    at, crc = starts[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    longer = np.cumsum(np.bincount(size[order], minlength=_SHORT + 1)[::-1])[::-1]  # spans of k bytes or more
    for k in range(_SHORT):
        live = int(longer[k + 1])
        if not live:
            break
        now = crc[:live]
        crc[:live] = _TABLE[(now ^ data[at[:live] + k]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    out[order] = ~crc
    return out


def features(data: np.ndarray, offsets: np.ndarray, ngrams: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every feature, and the words of every text."""
    starts, ends = words.spans(data, offsets, words.NO_TERM)
    doc, body = words.owners(offsets, starts), words.LOWER[data]
    n_words = np.bincount(doc, minlength=len(offsets) - 1)
    if ngrams > 1:  # the words next to each other, with one space between
        size = ends - starts
        begin = np.cumsum(size + 1) - size - 1
        joined = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = body[~words.NO_TERM[data]]
        body, starts, ends = joined, begin, begin + size
    found, of = [], []
    for n in range(1, ngrams + 1):
        first = np.arange(max(0, len(doc) - n + 1))
        first = first[doc[first] == doc[first + n - 1]]
        found.append(crc32(body, starts[first], ends[first + n - 1]) % np.uint32(buckets))
        of.append(doc[first])
    return np.concatenate(of), np.concatenate(found).astype(np.int64), n_words


def bucket_counts(texts: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows. A task adds up its own array; the driver
    gets ``buckets`` sums."""

    def run(batches):
        count = np.zeros(buckets, np.int64)
        for _, data, offsets in words.parts(batches):
            count += np.bincount(features(data, offsets, ngrams, buckets)[1], minlength=buckets)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(count[held])], ["bucket", "n"])

    summed = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in summed.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the target's to the corpus's smoothed share of every bucket."""
    buckets, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = lambda s, t: (t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, ngrams: int = NGRAMS, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` of every row with __words, n_features and weight."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    names = ["__words", "n_features", "weight"]

    def run(batches):
        gain = shared.value
        for rows, data, offsets in words.parts(batches, "__text"):
            doc, bucket, n_words = features(data, offsets, ngrams, len(gain))
            n = np.bincount(doc, minlength=rows.num_rows)
            # Sums of whole numbers far below 2^53, so exact.
            weight = np.bincount(doc, weights=gain[bucket], minlength=rows.num_rows).astype(np.int64) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *(pa.array(x.astype(np.int64)) for x in (n_words, n, weight))], [*carry, *names])

    schema = tables.extended(docs.select(*[F.col(f"`{c}`") for c in carry]).schema, **dict.fromkeys(names, "long"))
    return docs.select(*[F.col(f"`{c}`") for c in carry], F.col("text").alias("__text")).mapInArrow(run, schema)


def noise(seed: int = SEED):
    """Gumbel noise of the id, in thousandths, floored."""
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), ident).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS, min_words: int = MIN_WORDS,
             percent: int = PERCENT, seed: int = SEED, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` (doc_id among it), n_features, weight, score and rank of every row; rank is
    null where a row is not drawn."""
    gain = gains(bucket_counts(docs, ngrams, buckets), bucket_counts(target, ngrams, buckets))
    scored = weigh(docs, gain, ngrams, carry).withColumn("score", F.col("weight") + noise(seed))
    scored = scored.withColumn("__enough", F.col("__words") >= min_words).drop("__words")
    return ranked(scored, "score", "doc_id", "__enough", lambda n: percent * n // 100).drop("__enough")


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents, with all their columns, whatever their names."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row_of")
    kept = resample(docs.select("doc_id", "text", whole), target, carry=("doc_id", "__row_of"), **options)
    return kept.where("rank is not null").select("__row_of.*")

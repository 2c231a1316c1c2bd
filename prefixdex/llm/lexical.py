"""Ranked lexical search, reversed: the items wait in an inverted index, the
documents stream past.

An index over the distinct terms of the items (term -> items that hold it) goes
to every task. A first pass over all documents gathers the statistics that the
weights need: the documents with a term, their terms in all, and for each term
of the index the documents that hold it. The second pass counts each document's
index terms, sends each count through the postings of its term to the items'
scores, and updates a heap of the ``k`` best documents for each item; a task gives
out its heaps, which are merged, those of some tasks first.

A term is a run of ASCII letters and digits and of all characters beyond ASCII,
with A-Z in lower case. Its weight is ``floor(1000 ln((2N+2)/(2df+1)))``; a document of
``n`` terms scores, for each of the item's terms once, ``weight * (10^9 tf div (1000 tf + 8 m))``
with ``m = 100 - b + (b n N div L)``, in whole numbers.

The index is bounded: items are dealt into slices of ``SLICE_BYTES`` of distinct terms,
measured, and each slice is a search of its own; one item's own terms are the
least there can be.

Defined cases: a null or empty text has no term and scores nothing; documents
that repeat a doc_id are ranked each, a null doc_id comes after all others of
its score; every item row is an item of its own, also with a repeated or null
item_id; an item without terms, or whose terms no document holds, has no rows;
an empty table gives an empty result; texts of any length are read whole;
further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefixdex.llm import tables, words

TOP = 10
LENGTH_PART = 90  # percent of m that follows a document's length
SLICE_BYTES = 16 << 20
CELLS = 1 << 21  # scores (documents times items) held at a time
MERGE = 256  # tasks whose heaps are merged first
_LAST = np.iinfo(np.int64).max


def item_terms(items: DataFrame) -> DataFrame:
    """item (a number), item_id, terms (distinct, sorted, a line each) and their bytes."""

    def run(batches):
        for rows, data, offsets in words.parts(batches):
            raw, out = words.LOWER[data].tobytes(), []
            starts, ends = words.spans(data, offsets, words.NO_TERM)
            cut = np.searchsorted(starts, offsets)
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                out.append(b"\n".join(sorted({raw[s:e] for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)})))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, pa.binary()), pa.array([len(x) for x in out], pa.int64())], ["item_id", "terms", "bytes"])

    found = items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, terms binary, bytes long")
    return tables.save(found.where("bytes > 0").withColumn("item", F.monotonically_increasing_id()), "items")


def slices(items: DataFrame, most: int = SLICE_BYTES) -> list[DataFrame]:
    """The items in parts whose terms have at most ``most`` bytes, or are one item's."""
    size = items.agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).first()
    parts = 1
    while size["n"]:
        dealt = items.withColumn("slice", F.pmod(F.xxhash64("item"), F.lit(parts)))
        r = dealt.groupBy("slice").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        if r.where((F.col("b") > most) & (F.col("n") > 1)).isEmpty():
            return [dealt.where(F.col("slice") == x["slice"]).drop("slice") for x in r.select("slice").collect()]
        parts = max(2 * parts, -(-size["b"] // most))
    return []


@dataclass
class Index:
    """Terms in the order of their hashes, and the items (by place) that hold each."""

    item: np.ndarray  # item and its id (null: no id), by place
    item_id: list
    seed: int
    hashed: np.ndarray
    data: np.ndarray  # the terms' bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # postings of term t: held[first[t] : first[t + 1]]
    held: np.ndarray

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term) of every occurrence of an index term, and each text's terms in all."""
        starts, ends = words.spans(data, offsets, words.NO_TERM)
        doc, lowered = words.owners(offsets, starts), words.LOWER[data]
        n = np.bincount(doc, minlength=len(offsets) - 1)
        if not len(starts):
            return doc, doc, n
        hashed = words.hashes(lowered, starts, ends, self.seed)
        term = np.minimum(np.searchsorted(self.hashed, hashed), len(self.hashed) - 1)
        there = np.flatnonzero((self.hashed[term] == hashed) & (ends - starts == (self.ends - self.starts)[term]))
        term = term[there]
        equal = words.same(lowered, starts[there], ends[there], self.data, self.starts[term])
        return doc[there][equal], term[equal], n


def build(items: DataFrame) -> Index:
    """The inverted index of one slice of ``item_terms``."""
    rows = items.orderBy("item").collect()
    each = [bytes(r["terms"]).split(b"\n") for r in rows]
    place: dict[bytes, int] = {}
    for terms in each:
        for t in terms:
            place.setdefault(t, len(place))
    term = np.array([place[t] for terms in each for t in terms])
    item = np.repeat(np.arange(len(each)), [len(t) for t in each])
    data = np.frombuffer(b"".join(place), np.uint8)
    ends = np.cumsum([len(t) for t in place])
    starts, seed = np.concatenate([[0], ends[:-1]]), 1
    while len(np.unique(hashed := words.hashes(data, starts, ends, seed))) < len(place):
        seed += 1
    order = np.argsort(hashed)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    term = rank[term]
    by = np.argsort(term, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(place)))])
    return Index(np.array([r["item"] for r in rows]), [r["item_id"] for r in rows], seed, hashed[order], data, starts[order], ends[order], first, item[by])


def statistics(docs: DataFrame, shared) -> tuple[int, int, np.ndarray]:
    """N, L and, for each term of the broadcast index, its df over all documents."""

    def run(batches):
        index: Index = shared.value
        df, n, length = np.zeros(len(index.hashed), np.int64), 0, 0
        for _, data, offsets in words.parts(batches):
            doc, term, count = index.hits(data, offsets)
            once = np.unique(doc * len(df) + term) % len(df)
            df += np.bincount(once, minlength=len(df))
            n, length = n + int((count > 0).sum()), length + int(count.sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], held])), pa.array(np.concatenate([[n, length], df[held]]))], ["term", "n"])

    found = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df, whole = np.zeros(len(shared.value.hashed), np.int64), {-2: 0, -1: 0}
    for r in found.collect():  # as many rows as the bounded index has terms
        if r["term"] < 0:
            whole[r["term"]] = r["n"]
        else:
            df[r["term"]] = r["n"]
    return whole[-2], whole[-1], df


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Heaps:
    """The k best (score, then smallest id) documents of every item, as bounded
    tables in which places not taken yet have score 0."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = np.zeros((items, k), np.int64)
        self.ident = np.full((items, k), _LAST)
        self.null = np.ones((items, k), bool)

    def update(self, score: np.ndarray, ident: np.ndarray, null: np.ndarray) -> None:
        """Put the documents' ``score`` (documents by items) to the heaps."""
        worst = self.score[:, -1]
        doc, item = np.nonzero((score > 0) & (score >= worst[None, :]))
        if not len(doc):
            return
        touched = np.unique(item)
        back = np.searchsorted(touched, item)
        new = len(doc)
        value = np.concatenate([score[doc, item], self.score[touched].ravel()])
        names = np.concatenate([ident[doc], self.ident[touched].ravel()])
        empty = np.concatenate([null[doc], self.null[touched].ravel()])
        of = np.concatenate([back, np.repeat(np.arange(len(touched)), self.k)])
        order = np.lexsort((names, empty, -value, of))
        place = np.arange(len(order)) - np.searchsorted(of[order], np.arange(len(touched)))[of[order]]
        best = order[place < self.k]
        assert len(best) == len(touched) * self.k and new
        shape = (len(touched), self.k)
        self.score[touched], self.ident[touched], self.null[touched] = value[best].reshape(shape), names[best].reshape(shape), empty[best].reshape(shape)


def _scores(index: Index, weight: np.ndarray, n_docs: int, total: int, data: np.ndarray, offsets: np.ndarray, part: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, scores of some texts for all items), a bounded number at a time."""
    doc, term, count = index.hits(data, offsets)
    m = np.array([100 - part + part * c * n_docs // total for c in count.tolist()], np.int64)
    key, tf = np.unique(doc * len(weight) + term, return_counts=True)
    doc, term = key // len(weight), key % len(weight)
    gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    held, width = np.diff(index.first), len(index.item)
    step = max(1, CELLS // width)
    for lo in range(0, len(count), step):
        a, b = np.searchsorted(doc, [lo, lo + step])
        score = np.zeros(min(step, len(count) - lo) * width, np.int64)
        while a < b:  # as many postings at a time as there are cells
            upto = np.cumsum(held[term[a:b]])
            c = a + max(1, int(np.searchsorted(upto, CELLS, "right")))
            t, size = term[a:c], held[term[a:c]]
            at = np.arange(int(size.sum())) + np.repeat(index.first[t] - (np.cumsum(size) - size), size)
            np.add.at(score, np.repeat((doc[a:c] - lo) * width, size) + index.held[at], np.repeat(gain[a:c], size))
            a = c
        yield lo, score.reshape(-1, width)


def _search(docs: DataFrame, items: DataFrame, k: int, part: int) -> DataFrame:
    """(item, item_id, doc_id, score): every task's heaps for one slice of the items."""
    index = build(items)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    n_docs, total, df = statistics(docs, shared)
    weight = weights(n_docs, df)

    def run(batches):
        index: Index = shared.value
        heaps = Heaps(len(index.item), k)
        for rows, data, offsets in words.parts(batches):
            ids = rows.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ident = ids.fill_null(_LAST).to_numpy()
            for lo, score in _scores(index, weight, n_docs, max(total, 1), data, offsets, part):
                hi = lo + len(score)
                heaps.update(score, ident[lo:hi], null[lo:hi])
        item, place = np.nonzero(heaps.score)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(index.item[item]), pa.array([index.item_id[i] for i in item.tolist()], pa.int64()),
                pa.array(heaps.ident[item, place], mask=heaps.null[item, place]), pa.array(heaps.score[item, place]),
            ],
            ["item", "item_id", "doc_id", "score"],
        )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "item long, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, length_part: int = LENGTH_PART, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item."""
    out = None
    for one in slices(item_terms(items), slice_bytes):
        found = tables.save(_search(docs, one, k, length_part).withColumn("part", F.expr(f"spark_partition_id() div {MERGE}")), "heaps")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for by in (["item", "part"], ["item"]):
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("rank") <= k)
    return out.select("item_id", "rank", "doc_id", "score")

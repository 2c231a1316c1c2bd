"""Language ID by multilingual mixture inference.

Training counts byte trigrams (A-Z in lower case, white space as one space) of
all labelled texts per language, in a fixed number of hashed bins. A word's
likelihood under a language is the product of its trigrams' probabilities. A
document is a mixture: expectation-maximisation over its words (longer ones in pieces of
``PIECE`` bytes; in a very long text runs of words, so that ``CELLS`` holds all) estimates the
proportion of each language, and languages are taken out, smallest proportion
first, as long as the likelihood falls by less than the penalty, half of
``log(words)`` times ``weight`` for each language. The largest proportion of the set
that is left names the document's language and is its score.

Defined cases: a null text or one without a letter is ``und`` with score 0, and
so is every text when nothing is labelled; ties go to the first language in
alphabetical order; rows are independent of each other, so repeated rows get
equal results; rows with a null language are not learned from; texts and words of any
length are read whole; an empty table gives an empty result. ``predict`` does not look at
further columns, ``keep_known`` keeps them. The model is 128 KB for each language and is
sent to every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixdex.llm import words

BINS_LOG2 = 15
SMOOTH = 0.5
PIECE = 48  # bytes of a word looked at as one observation
CELLS = 4 << 20  # observations times languages of one text
STEPS = 10
WEIGHT = 4.0


def _codes(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of the trigram around each byte of [lo, hi), and which bytes are in words."""
    a, b = max(0, lo - 1), min(len(data), hi + 1)
    x = words.LOWER[data[a:b]]
    space = words.WS[data[a:b]]
    x[space] = 32
    before = np.concatenate([[32], x[:-1]]).astype(np.uint32)
    after = np.concatenate([x[1:], [32]]).astype(np.uint32)
    edge = offsets[(offsets > a) & (offsets < b)] - a
    before[edge] = 32
    after[edge - 1] = 32
    code = (before << np.uint32(16)) | (x.astype(np.uint32) << np.uint32(8)) | after
    bins = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BINS_LOG2)
    return bins[lo - a : hi - a], ~space[lo - a : hi - a]


def count(labelled: DataFrame) -> DataFrame:
    """(lang, bin, n) of rows with text and lang; tables of counts add up."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for rows, data, offsets in words.parts(batches, size=1 << 20):
            langs = rows.column(rows.schema.get_field_index("lang")).to_pylist()
            for lang in set(langs):
                own = np.array([x == lang for x in langs])
                total = sums.setdefault(lang, np.zeros(1 << BINS_LOG2, np.int64))
                for lo in range(0, len(data), 1 << 20):
                    hi = min(len(data), lo + (1 << 20))
                    bins, inside = _codes(data, offsets, lo, hi)
                    inside &= np.repeat(own, np.diff(offsets))[lo:hi]
                    total += np.bincount(bins[inside], minlength=1 << BINS_LOG2)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bin", "n"])

    rows = labelled.where("lang is not null and text is not null").select("lang", "text")
    return rows.mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


class Model:
    """Languages in alphabetical order and log probabilities, bins x languages."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table


def fit(counts: DataFrame) -> Model:
    """The model of counted trigrams: at most 2^15 rows for each language."""
    languages = [r[0] for r in counts.select("lang").distinct().orderBy("lang").collect()]
    found = counts.toArrow()
    table = np.zeros((1 << BINS_LOG2, len(languages)))
    column = {lang: k for k, lang in enumerate(languages)}
    table[found["bin"].to_numpy(), [column[x] for x in found["lang"].to_pylist()]] = found["n"].to_numpy()
    table += SMOOTH
    return Model(languages, np.log(table / table.sum(0)).astype(np.float32))


def observations(offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of what is looked at as one: the words, long ones in pieces; runs of
    these where a text has more than ``CELLS`` for so many languages."""
    n = -(-(ends - starts) // PIECE)
    if (n > 1).any():
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        starts, last = np.repeat(starts, n) + within * PIECE, np.repeat(ends, n)
        ends = np.minimum(starts + PIECE, last)
    doc = words.owners(offsets, starts)
    size, most = np.bincount(doc, minlength=len(offsets) - 1), max(1, CELLS // languages)
    if (size > most).any():
        place = np.arange(len(doc)) - (np.cumsum(size) - size)[doc]
        first = np.flatnonzero(place % (-(-size // most))[doc] == 0)
        starts, ends = starts[first], ends[np.append(first[1:], len(ends)) - 1]
    return starts, ends


def _word_likelihoods(data, offsets, starts, ends, table) -> np.ndarray:
    """Log-likelihood of every word under every language."""
    out = np.empty((len(starts), table.shape[1]), np.float32)
    cut, i = max(1 << 12, (4 << 20) // max(1, table.shape[1])), 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + cut, "right")))
        bins, inside = _codes(data, offsets, lo, int(ends[j - 1]))
        each = table[bins]
        each[~inside] = 0
        out[i:j] = np.add.reduceat(each, starts[i:j] - lo, axis=0)
        i = j
    return out


def _em(like: np.ndarray, first: np.ndarray, n: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of documents whose words' likelihoods follow
    each other; languages with share 0 stay out."""
    for _ in range(steps):
        each = like * np.repeat(share, n, axis=0)
        each /= each.sum(1, keepdims=True)
        share = np.add.reduceat(each, first, axis=0) / n[:, None]
    total = np.log((like * np.repeat(share, n, axis=0)).sum(1))
    return share, np.add.reduceat(total, first)


def infer(logs: np.ndarray, doc: np.ndarray, n_docs: int, weight: float = WEIGHT) -> np.ndarray:
    """Proportions (documents x languages) of the chosen language sets; zero rows
    for documents without words."""
    out = np.zeros((n_docs, logs.shape[1]))
    if not len(doc):
        return out
    ids, first, n = np.unique(doc, return_index=True, return_counts=True)
    single = np.add.reduceat(logs.astype(np.float64), first, axis=0)
    top = logs.max(1, keepdims=True)
    like = np.maximum(np.exp(logs - top), 1e-30)
    base = np.add.reduceat(top[:, 0].astype(np.float64), first)
    count = logs.shape[1]
    out[ids, single.argmax(1)] = 1
    if count == 1:
        return out
    cost = weight * 0.5 * np.log(n + 1)
    share, fitted = _em(like, first, n, np.full((len(ids), count), 1 / count), STEPS)
    # No set does better than all languages together: where one language is
    # within a single penalty of that, it is the best set.
    open_ = np.flatnonzero(single.max(1) < fitted + base - cost)
    while len(open_):
        take = np.repeat(np.isin(np.arange(len(ids)), open_), n)
        like_o, n_o = like[take], n[open_]
        first_o = np.concatenate([[0], np.cumsum(n_o)[:-1]])
        now = share[open_]
        out[ids[open_]] = now
        held = now > 0
        several = held.sum(1) > 1
        smallest = np.where(held, now, 2).argmin(1)
        less = now.copy()
        less[np.arange(len(open_)), smallest] = 0
        less /= np.maximum(less.sum(1, keepdims=True), 1e-12)
        less[~several] = now[~several]
        refit, value = _em(like_o, first_o, n_o, less, STEPS)
        better = several & (fitted[open_] - value < cost[open_])
        share[open_[better]] = refit[better]
        fitted[open_[better]] = value[better]
        open_ = open_[better]
    return out


def _letter():
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letter")


def _predictions(batches, languages: list[str], table: np.ndarray, weight: float):
    """(rows, languages by name, scores, proportions) of parts with a text and a
    ``__letter`` column."""
    size = max(1 << 16, (words.PART_BYTES * 2) // max(1, len(languages)))
    for rows, data, offsets in words.parts(batches, size=size):
        letter = np.array(rows.column(rows.schema.get_field_index("__letter")).to_pylist(), bool)
        starts, ends = words.spans(data, offsets)
        starts, ends = observations(offsets, starts, ends, max(1, len(languages)))
        if languages:
            logs = _word_likelihoods(data, offsets, starts, ends, table)
            share = infer(logs, words.owners(offsets, starts), rows.num_rows, weight)
        else:
            share = np.zeros((rows.num_rows, 1))
        share[~letter] = 0
        best, score = share.argmax(1), np.clip(share.max(1), 0, 1)
        yield rows, [languages[k] if s > 0 else "und" for k, s in zip(best, score, strict=True)], score, share


def predict(docs: DataFrame, model: Model, weight: float = WEIGHT) -> DataFrame:
    """doc_id, lang_pred, score, and the chosen languages with their proportions."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table))
    schema = "doc_id long, lang_pred string, score double, languages array<string>, proportions array<double>"

    def run(batches):
        languages, table = shared.value
        for rows, names, score, share in _predictions(batches, languages, table, weight):
            held = [np.flatnonzero(x) for x in share]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()),
                    pa.array([[languages[k] for k in x] for x in held], pa.list_(pa.string())),
                    pa.array([s[x].tolist() for s, x in zip(share, held, strict=True)], pa.list_(pa.float64())),
                ],
                ["doc_id", "lang_pred", "score", "languages", "proportions"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text", _letter()).mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: Model, weight: float = WEIGHT) -> DataFrame:
    """The rows of ``docs`` that have a language, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table))
    width = len(docs.columns)

    def run(batches):
        languages, table = shared.value
        for rows, names, _, _ in _predictions(batches, languages, table, weight):
            kept = rows.filter(pa.array([x != "und" for x in names], pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:width], kept.schema.names[:width])

    return docs.select("*", _letter()).mapInArrow(run, docs.schema)

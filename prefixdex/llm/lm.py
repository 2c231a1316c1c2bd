"""LM scoring by a log-bilinear model trained with noise-contrastive estimation.

Tokens are the words, A-Z in lower case, and one end for each text. Training
counts every token of the training documents: each task counts its texts,
counts are dealt by hash into buckets and added up there. The vocabulary is every
word that occurs at least ``max(LEAST, sqrt(N) / SCALE)`` times among the N training
tokens: it grows with the corpus and has at most ``SCALE * sqrt(N)`` words, which the
driver and every task hold.

The model has two levels. A symbol is one of the ``HEAD`` most frequent words, a run
of the vocabulary's other words (about as many runs as words in a run), one of
``CLASSES`` classes of the words outside the vocabulary (by their last two letters) or
the end. The symbol is predicted from the two tokens before it, then the word within
its run from the same: the context's vector is ``q = C1 r(w1) + C2 r(w2)``, the score of
a symbol or word with it ``q . r(w) + b(w)``. Every word of the vocabulary has a vector
of its own, as a context and as a target.

Every task trains a copy on all its training texts by noise-contrastive
estimation (noise symbols shared by a minibatch, noise words drawn for each token in
its run, both by frequency). A copy passes on what it has changed; the changes of a
vector are averaged over the copies that met it, by how often they did, in a tree of
groups of ``_FAN`` copies.

Scoring normalises exactly, over all symbols and over the words of a run. A word
outside the vocabulary has the probability of its class times its share of the class's
counts, smoothed as in the unigram base, with one unknown word for each class;
all words together have the probability 1. Counts of such words are not
brought to the documents; the documents' (word, text) pairs are sent to the
counts, which return a sum for each text.

Defined cases: null is the empty text, which is only the end; a null doc_id is
written as the empty text for the split; rows are documents of their own, so
repeated rows all count and score alike; words equally frequent come in order of
their hash; texts of any length are scored whole, in slices of tokens; only ``doc_id``
and ``text`` are read, so further columns of any name make no difference; an empty
table, or one without training documents, gives counts of zero (N = V = 0) and equal
probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixdex.llm import tables, words

LEAST = 5
SCALE = 64
HEAD = 254
CLASSES = 64
DIM = 24
NOISE = 64
NOISE_WITHIN = 2
BATCH = 4096
RATE = 0.15
SQUARES = 1e-4  # what AdaGrad starts from
PART_BYTES = 8 << 20  # texts scored together: the more, the fewer distinct contexts
BUCKET_BYTES = 16 << 20  # text for each bucket of words
_FLUSH = 2_000_000  # distinct words a task holds before it passes counts on
_SLICE = 1 << 20  # tokens whose contexts are held at a time
_BLOCK = 1 << 13  # vectors worked on at a time
_ROWS = 4096  # vectors in a chunk of changes
_FAN = 64
_CLASS_OF = (words.mix(np.arange(1 << 16)) % np.uint64(CLASSES)) << np.uint64(58)  # of the last two bytes


def _train(column: str = "doc_id"):
    return tables.doc_hash(column) % 10 != 0


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text", _train().alias("train"))


def _bucket(hashed: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def _scan(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key and row of every word. A key is the word's class and 58 bits of its hash;
    the class comes from its last two bytes, without a sign after them."""
    starts, ends = words.spans(data, offsets)
    lowered = words.LOWER[data]
    hashed = words.hashes(lowered, starts, ends)
    last = ends - 1
    last = last - ((last > starts) & (lowered[last] < 0x30))
    tail = lowered[last].astype(np.uint16) << np.uint16(8) | lowered[np.maximum(last - 1, starts)]
    hashed >>= np.uint64(6)
    hashed |= _CLASS_OF[tail]
    return hashed, words.owners(offsets, starts)


def _class(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(58)).astype(np.int64)


def _split(hashed: np.ndarray, buckets: int):
    """(bucket, places) of the hashes."""
    of = _bucket(hashed, buckets)
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), order[cuts[b] : cuts[b + 1]]


def _added(hashed: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    if not hashed:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, back = np.unique(np.concatenate(hashed), return_inverse=True)
    return keys, np.bincount(back, np.concatenate(counts), len(keys)).astype(np.int64)


def count_words(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, words (sorted keys), counts, tokens and distinct words of each class:
    exact counts over all training documents."""

    def run(batches):
        held: tuple[list, list] = ([], [])

        def flush():
            keys, n = _added(*held)
            held[0].clear(), held[1].clear()
            for b, at in _split(keys, buckets):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), pa.array([keys[at].tobytes()], pa.binary()), pa.array([n[at].tobytes()], pa.binary())],
                    ["bucket", "words", "counts"],
                )

        for _, data, offsets in words.parts(batches, size=PART_BYTES):
            keys, n = np.unique(_scan(data, offsets)[0], return_counts=True)
            held[0].append(keys), held[1].append(n)
            if sum(map(len, held[0])) > _FLUSH:
                yield from flush()
        yield from flush()

    def total(key, rows):
        keys, n = _added([np.frombuffer(x, np.uint64) for x in rows["words"].to_pylist()], [np.frombuffer(x, np.int64) for x in rows["counts"].to_pylist()])
        return pa.table(
            {
                "bucket": pa.array([key[0].as_py()], pa.int32()),
                "words": pa.array([keys.tobytes()], pa.binary()),
                "counts": pa.array([n.tobytes()], pa.binary()),
                "n_tokens": pa.array([np.bincount(_class(keys), n, CLASSES).astype(np.int64).tolist()], pa.list_(pa.int64())),
                "n_words": pa.array([np.bincount(_class(keys), minlength=CLASSES).tolist()], pa.list_(pa.int64())),
            }
        )

    rows = _rows(docs).where("train").mapInArrow(run, "bucket int, words binary, counts binary")
    schema = "bucket int, words binary, counts binary, n_tokens array<long>, n_words array<long>"
    return rows.groupBy("bucket").applyInArrow(total, schema)


def frequent_words(counts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the words that occur ``least`` times or more: at most as many
    as the training tokens divided by ``least``."""

    def run(batches):
        for rows in batches:
            for a, b in zip(rows.column(0), rows.column(1), strict=True):
                keys, n = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.int64)
                at = n >= least
                yield pa.RecordBatch.from_arrays([pa.array([keys[at].tobytes()], pa.binary()), pa.array([n[at].tobytes()], pa.binary())], ["words", "counts"])

    rows = counts.select("words", "counts").mapInArrow(run, "words binary, counts binary").collect()
    keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["words"], np.uint64) for r in rows)])
    return keys, np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["counts"], np.int64) for r in rows)])


class Symbols:
    """The model's units, one vector each: the ``head`` most frequent words, the classes of
    words outside the vocabulary, the runs of its other words, the end (these are the
    symbols), the beginning, the words in runs. ``n_tokens`` and ``n_words`` are the
    training tokens and distinct words of each class, with the vocabulary's."""

    def __init__(self, vocabulary: np.ndarray, counts: np.ndarray, n_ends: int, n_tokens: np.ndarray, n_words: np.ndarray, head: int = HEAD):
        self.n_ends = n_ends
        self.n_tokens, self.n_distinct = int(n_tokens.sum()) + n_ends, int(n_words.sum()) + (n_ends > 0)
        own = _class(vocabulary)
        self.n_other = n_tokens - np.bincount(own, counts, CLASSES).astype(np.int64)
        self.v_other = n_words - np.bincount(own, minlength=CLASSES)
        first = np.lexsort((vocabulary, -counts))
        top, rest = first[:head], first[head:]
        rest = rest[np.argsort(own[rest], kind="stable")]  # words of a run end alike
        runs = int(np.ceil(np.sqrt(len(rest))))
        self.starts = np.linspace(0, len(rest), runs + 1).astype(np.int64)
        self.other = len(top)
        self.run = self.other + CLASSES
        self.end = self.run + runs
        self.begin = self.size = self.end + 1
        unit = np.empty(len(vocabulary), np.int32)
        unit[top] = np.arange(len(top))
        unit[rest] = self.size + 1 + np.arange(len(rest))
        self.head_counts, self.within = counts[top], counts[rest]
        # Words by the low bits of their keys: those of slot s are slots[s] to slots[s + 1].
        self.mask = np.uint64((1 << (2 * len(vocabulary)).bit_length()) - 1)
        slot = vocabulary & self.mask
        order = np.argsort(slot, kind="stable")
        self.words, self.units = vocabulary[order], unit[order]
        self.slots = np.searchsorted(slot[order], np.arange(int(self.mask) + 2, dtype=np.uint64)).astype(np.int32)

    def frequencies(self) -> np.ndarray:
        each = np.add.reduceat(self.within, self.starts[:-1]) if len(self.within) else self.within
        n = np.concatenate([self.head_counts, self.n_other, each, [self.n_ends]]).astype(np.float64) + 0.1
        return n / n.sum()

    def known_counts(self) -> np.ndarray:
        """Training count of every unit that is a token (0 for the others)."""
        n = np.zeros(self.size + 1 + len(self.within))
        n[: self.other], n[self.end], n[self.size + 1 :] = self.head_counts, self.n_ends, self.within
        return n

    def known(self, hashed: np.ndarray, default: np.ndarray) -> np.ndarray:
        """The unit of every word of the vocabulary, ``default`` for the other words."""
        slot, out = (hashed & self.mask).astype(np.int64), default.astype(np.int32)
        at, end = self.slots.take(slot), self.slots.take(slot + 1)
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            here = self.words.take(at) == hashed[left]
            out[left[here]] = self.units.take(at[here])
            at += 1
            more = ~here & (at < end)
            left, at, end = left[more], at[more], end[more]
        return out

    def sequence(self, hashed: np.ndarray, doc: np.ndarray, n_docs: int):
        """Unit, its two predecessors and its row, for all texts with their ends;
        and the unit of every word."""
        own = self.known(hashed, self.other + _class(hashed))
        length = np.bincount(doc, minlength=n_docs) + 1
        last = np.cumsum(length) - 1
        unit = np.full(len(hashed) + n_docs, self.end, np.int32)
        unit[np.arange(len(hashed)) + doc] = own
        one = np.concatenate([[self.begin], unit[:-1]]).astype(np.int32)
        first = last - length + 1
        one[first] = self.begin
        two = np.concatenate([[self.begin], one[:-1]]).astype(np.int32)
        two[first] = self.begin
        return unit, one, two, np.repeat(np.arange(n_docs), length), own


class LogBilinear:
    """Parameters as one flat float32 array: r with the biases as its last column (symbols,
    the beginning, the words in runs), the context matrices C1 and C2. ``starts`` are
    the bounds of the runs; the runs are the symbols before the last one."""

    def __init__(self, flat: np.ndarray, size: int, dim: int = DIM, starts: np.ndarray | None = None):
        self.starts = np.zeros(1, np.int64) if starts is None else starts
        self.flat, self.size, self.dim = flat, size, dim
        self.first_run = size - len(self.starts)
        a, b = (size + 1 + int(self.starts[-1])) * (dim + 1), dim * dim
        self.rows = flat[:a].reshape(-1, dim + 1)
        self.r, self.bias = self.rows[:, :dim], self.rows[:, dim]
        self.c1 = flat[a : a + b].reshape(dim, dim)
        self.c2 = flat[a + b : a + 2 * b].reshape(dim, dim)
        self.of = np.arange(len(self.rows), dtype=np.int32)  # the symbol of every unit
        self.of[size + 1 :] = np.repeat(np.arange(self.first_run, size - 1), np.diff(self.starts))

    @classmethod
    def start(cls, frequencies: np.ndarray, dim: int = DIM, seed: int = 5, starts: np.ndarray | None = None, within: np.ndarray | None = None) -> LogBilinear:
        size, tails = len(frequencies), 0 if starts is None else int(starts[-1])
        made = cls(np.zeros((size + 1 + tails) * (dim + 1) + 2 * dim * dim, np.float32), size, dim, starts)
        made.r[: size + 1] = np.random.default_rng(seed).normal(0, 0.1, (size + 1, dim))
        made.c1[:] = np.eye(dim)
        made.c2[:] = np.eye(dim) * 0.5
        made.bias[:size] = np.log(frequencies)
        if tails:
            made.bias[size + 1 :] = log_shares(starts, within)
        return made

    def symbols(self, unit: np.ndarray) -> np.ndarray:
        """The symbol of every unit: a word in a run has its run."""
        return self.of[unit]

    def vectors(self, unit: np.ndarray) -> np.ndarray:
        """Vectors of the units as contexts: a word in a run has its run's and its own."""
        inside = np.flatnonzero(unit > self.size)
        out = self.rows.take(unit, 0)[:, : self.dim]
        out[inside] += self.rows.take(self.symbols(unit[inside]), 0)[:, : self.dim]
        return out

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """What every unit gives to a context, as the word before and as the one before that."""
        r = self.vectors(np.arange(len(self.rows)))
        return r @ self.c1, r @ self.c2

    def log_normalisers(self, context: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Over the units lo to hi (all symbols)."""
        hi = self.size if hi is None else hi
        out = np.empty(len(context))
        if not len(context):
            return out
        targets, one = np.ascontiguousarray(self.rows[lo:hi].T), np.ones(hi - lo, np.float32)
        longest = np.sqrt(np.einsum("ij,ij->i", context, context).max() * np.square(self.r[lo:hi]).sum(1).max())
        shifted = not longest + np.abs(self.bias[lo:hi]).max() < 60  # else no score overflows or vanishes
        rows = min(len(context), 512)
        q, scores = np.ones((rows, self.dim + 1), np.float32), np.empty((rows, hi - lo), np.float32)
        for a in range(0, len(context), rows):
            n = min(rows, len(context) - a)
            q[:n, :-1] = context[a : a + n]
            score = np.matmul(q[:n], targets, out=scores[:n])
            if shifted:
                top = score.max(1, keepdims=True)
                score -= top
            np.exp(score, out=score)
            out[a : a + n] = np.log(score @ one) + (top[:, 0] if shifted else 0)
        return out

    def _slice(self, unit: np.ndarray, one: np.ndarray, two: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        wide = len(self.rows)
        pairs, back = np.unique(one.astype(np.int64) * wide + two, return_inverse=True)
        before, pairs = np.divmod(pairs, wide)
        context = first.take(before, 0)
        for a in range(0, len(pairs), _BLOCK):
            context[a : a + _BLOCK] += second.take(pairs[a : a + _BLOCK], 0)
        symbol = self.symbols(unit)
        out = -self.log_normalisers(context)[back]
        for a in range(0, len(unit), _BLOCK):
            at = slice(a, a + _BLOCK)
            out[at] += self._scores(context.take(back[at], 0), symbol[at])
        inside = np.flatnonzero(unit > self.size)
        run = symbol[inside] - self.first_run
        order = np.argsort(run.astype(np.uint16) if len(self.starts) < 1 << 16 else run, kind="stable")
        inside, cuts = inside[order], np.searchsorted(run[order], np.arange(len(self.starts)))
        for k in np.flatnonzero(np.diff(cuts)):
            at = inside[cuts[k] : cuts[k + 1]]
            q = context.take(back[at], 0)
            lo, hi = self.size + 1 + self.starts[k], self.size + 1 + self.starts[k + 1]
            out[at] += self._scores(q, unit[at]) - self.log_normalisers(q, lo, hi)
        return out

    def _scores(self, context: np.ndarray, unit: np.ndarray) -> np.ndarray:
        to = self.rows.take(unit, 0)
        return np.einsum("ij,ij->i", context, to[:, :-1]) + to[:, -1]

    def log_probabilities(self, unit: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural logarithms of the normalised probabilities."""
        if not len(unit):
            return np.zeros(0)
        cuts, parts = [slice(a, a + _SLICE) for a in range(0, len(unit), _SLICE)], self.parts()
        return np.concatenate([self._slice(unit[at], one[at], two[at], *parts) for at in cuts])


def log_shares(starts: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Logarithm of every word's share of its run."""
    whole = np.add.reduceat(within, starts[:-1])
    return np.log(within / np.repeat(whole, np.diff(starts)))


class _Steps:
    """Where values fall among ascending numbers that start at 0, as ``searchsorted`` to the
    right of equal ones; the steps of a table lead to the place, or near it."""

    def __init__(self, bounds: np.ndarray):
        self.bounds, steps = bounds, 2 * len(bounds)
        self.rate = steps / bounds[-1]
        self.first = np.searchsorted((bounds * self.rate).astype(np.int64), np.arange(steps + 2))

    def places(self, values: np.ndarray) -> np.ndarray:
        at = self.first.take((values * self.rate).astype(np.int64))
        left = np.flatnonzero(self.bounds.take(at) <= values)
        while len(left):
            at[left] += 1
            left = left[at[left] < len(self.bounds)]
            left = left[self.bounds.take(at[left]) <= values[left]]
        return at


class _Places:
    """Tells the ids below ``size`` apart without sorting them."""

    def __init__(self, size: int):
        self.met, self.place = np.zeros(size, bool), np.empty(size, np.int64)

    def distinct(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ids, ascending, and the place of each id among them."""
        self.met[ids] = True
        found = np.flatnonzero(self.met)
        self.met[found] = False
        self.place[found] = np.arange(len(found))
        return found, self.place.take(ids)


def _sums(back: np.ndarray, pieces: list, size: int) -> np.ndarray:
    """Of each row of the pieces, side by side, the sums of the values with one place: added
    up as doubles, a row at a time."""
    out = np.empty((len(pieces[0]), size), np.float32)
    values, sums = np.empty(len(back)), np.empty(size)
    for k, row in enumerate(out):
        np.concatenate([x[k] for x in pieces], out=values)
        sums[:] = 0
        np.add.at(sums, back, values)
        row[:] = sums
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Trainer:
    """Noise-contrastive estimation with AdaGrad over minibatches. ``within`` are the counts
    of the words in runs, of which each run's noise is drawn. ``met``: minibatches that
    have changed a vector."""

    def __init__(self, model: LogBilinear, frequencies: np.ndarray, seed: int, within: np.ndarray | None = None):
        self.model, self.log_noise = model, np.log(frequencies * NOISE).astype(np.float32)
        self.rising = np.cumsum(frequencies)
        self.rng = np.random.default_rng(seed)
        self.squares = LogBilinear(np.full(len(model.flat), SQUARES, np.float32), model.size, model.dim, model.starts)
        self.met = np.zeros(len(model.rows), np.float32)
        self.places = _Places(len(model.rows))
        self.tokens = 0
        if model.starts[-1]:
            self.risen = np.concatenate([[0], np.cumsum(within)]).astype(np.float64)
            self.steps = _Steps(self.risen)
            self.log_within = (log_shares(model.starts, within) + np.log(NOISE_WITHIN)).astype(np.float32)

    def _within(self, q: np.ndarray, columns: np.ndarray, unit: np.ndarray, symbol: np.ndarray):
        """Gradients of the words in runs: the tokens and what their contexts get, ids and columns."""
        m, base = self.model, self.model.size + 1
        at = np.flatnonzero(unit > m.size)
        run, word = symbol[at] - m.first_run, unit[at]
        lo, hi = m.starts[run], m.starts[run + 1]
        floor, ceiling = self.risen[lo], self.risen[hi]
        qw, own, to = q.take(at, 0), columns.take(at, 1), m.rows.take(word, 0)
        up = _sigmoid(self.log_within[word - base] - to[:, -1] - np.einsum("ij,ij->i", qw, to[:, :-1]))
        dq, ids, rows = up[:, None] * to[:, :-1], [word], [up * own]
        for _ in range(NOISE_WITHIN):
            drawn = floor + self.rng.random(len(at)) * (ceiling - floor)
            noise = np.clip(self.steps.places(drawn) - 1, lo, hi - 1)
            to = m.rows.take(base + noise, 0)
            down = _sigmoid(np.einsum("ij,ij->i", qw, to[:, :-1]) + to[:, -1] - self.log_within[noise])
            dq -= down[:, None] * to[:, :-1]
            ids.append(base + noise), rows.append(-down * own)
        return at, dq, ids, rows

    def step(self, unit: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m, n = self.model, len(unit)
        symbol = m.symbols(unit)
        noise = np.minimum(np.searchsorted(self.rising, self.rng.random(NOISE)), m.size - 1)
        to, false = m.rows.take(symbol, 0), m.rows.take(noise, 0)
        held, back = self.places.distinct(np.concatenate([one, two]))
        own = int(np.searchsorted(held, m.size, "right"))  # from here on words in runs
        runs, near, far = m.symbols(held[own:]), back[:n], back[n:]
        context = m.rows.take(held, 0)[:, :-1]
        context[own:] += m.rows.take(runs, 0)[:, :-1]
        q = (context @ m.c1).take(near, 0)
        q += (context @ m.c2).take(far, 0)
        columns = np.ones((m.dim + 1, n), np.float32)  # of the contexts, and of what the bias is multiplied by
        columns[:-1] = q.T
        up = _sigmoid(self.log_noise[symbol] - to[:, -1] - np.einsum("ij,ij->i", q, to[:, :-1]))
        false[:, -1] -= self.log_noise[noise]
        down = _sigmoid(false @ columns)
        dq = up[:, None] * to[:, :-1]
        dq -= down.T @ false[:, :-1]
        ids, rows = [symbol, noise], [up * columns, -(columns @ down.T)]
        if m.starts[-1]:
            at, more, more_ids, more_rows = self._within(q, columns, unit, symbol)
            dq[at] += more
            ids, rows = ids + more_ids, rows + more_rows
        # A context in a run changes its own vector and its run's; contexts have no bias.
        dq = np.ascontiguousarray(dq.T)
        g1, g2 = _sums(near, [dq], len(held)), _sums(far, [dq], len(held))
        grad = np.concatenate([m.c1 @ g1 + m.c2 @ g2, np.zeros((1, len(held)), np.float32)])
        ids += [held, runs]
        rows += [grad, grad[:, own:]]
        keys, back = self.places.distinct(np.concatenate(ids))
        grad = _sums(back, rows, len(keys))
        for old, seen, g in ((m.c1, self.squares.c1, context.T @ g1.T / n), (m.c2, self.squares.c2, context.T @ g2.T / n)):
            seen += g**2
            old += RATE * g / np.sqrt(seen)
        grad = np.ascontiguousarray(grad.T)
        grad /= n
        seen = self.squares.rows.take(keys, 0)
        seen += np.square(grad)
        self.squares.rows[keys] = seen
        grad *= RATE
        grad /= np.sqrt(seen, out=seen)
        grad += m.rows.take(keys, 0)
        m.rows[keys] = grad
        self.met[keys] += 1
        self.tokens += n


def _changes(task: int, start: LogBilinear, trainer: Trainer) -> pa.RecordBatch:
    """What a copy has changed: the matrices (chunk -1), and in chunks the ids, changes and
    weights of the vectors that it has met; changes times their weights."""
    m, ids = trainer.model, np.flatnonzero(trainer.met)
    at = len(m.rows) * (m.dim + 1)
    matrices = (m.flat[at:] - start.flat[at:]) * np.float32(trainer.tokens)
    out = [(-1, task, b"", matrices.tobytes(), np.float32(trainer.tokens).tobytes())]
    cuts = np.flatnonzero(np.diff(ids // _ROWS, prepend=-1, append=-1)) if len(ids) else np.zeros(1, int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = ids[a:b]
        body = (m.rows[own] - start.rows[own]) * trainer.met[own, None]
        out.append((int(own[0] // _ROWS), task, own.tobytes(), body.tobytes(), trainer.met[own].tobytes()))
    cols = list(zip(*out, strict=True))
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["chunk", "part", "ids", "body", "weight"])


def _added_changes(key, rows):
    """The changes of a group of copies, added up: at most ``_FAN`` times a chunk."""
    columns = [rows[c].to_pylist() for c in ("ids", "body", "weight")]
    ids, body, weight = np.zeros(0, np.int64), None, np.zeros(0, np.float32)
    for x, y, z in zip(*columns, strict=True):
        x, y, z = np.frombuffer(x, np.int64), np.frombuffer(y, np.float32), np.frombuffer(z, np.float32)
        if len(x):
            y = y.reshape(len(x), -1)
        if body is None:
            ids, body, weight = x, y, z
        elif not len(x):  # the matrices
            body, weight = body + y, weight + z
        else:
            merged, back = np.unique(np.concatenate([ids, x]), return_inverse=True)
            total, heavy = np.zeros((len(merged), y.shape[1]), np.float32), np.zeros(len(merged), np.float32)
            for at, b, w in ((back[: len(ids)], body, weight), (back[len(ids) :], y, z)):
                total[at] += b
                heavy[at] += w
            ids, body, weight = merged, total, heavy
    cols = [pa.array([k.as_py()], pa.int32()) for k in key]
    return pa.table([*cols, *(pa.array([v.tobytes()], pa.binary()) for v in (ids, body, weight))], ["chunk", "part", "ids", "body", "weight"])


def train(docs: DataFrame, symbols: Symbols, dim: int = DIM) -> LogBilinear:
    """One pass over all training documents, a copy of the model in each task; the changes
    of the copies are averaged."""
    shared = docs.sparkSession.sparkContext.broadcast(symbols)
    schema = "chunk int, part int, ids binary, body binary, weight binary"

    def run(batches):
        known = shared.value
        start = LogBilinear.start(known.frequencies(), dim, starts=known.starts, within=known.within)
        task = TaskContext.get().partitionId()
        copy = LogBilinear(start.flat.copy(), known.size, dim, known.starts)
        trainer = Trainer(copy, known.frequencies(), task, known.within)
        for rows, data, offsets in words.parts(batches, size=PART_BYTES):
            unit, one, two, _, _ = known.sequence(*_scan(data, offsets), rows.num_rows)
            order = trainer.rng.permutation(len(unit))
            for lo in range(0, len(unit), BATCH):
                at = order[lo : lo + BATCH]
                trainer.step(unit[at], one[at], two[at])
        if trainer.tokens:
            yield _changes(task, start, trainer)

    rows = _rows(docs).where("train")
    parts = rows.rdd.getNumPartitions()
    summed = rows.mapInArrow(run, schema)
    while parts > 1:
        parts = -(-parts // _FAN)
        grouped = summed.withColumn("part", F.floor(F.col("part") / _FAN).cast("int")).groupBy("chunk", "part")
        summed = grouped.applyInArrow(_added_changes, schema)
    model = LogBilinear.start(symbols.frequencies(), dim, starts=symbols.starts, within=symbols.within)
    at = len(model.rows) * (dim + 1)
    for r in tables.save(summed, "model").toLocalIterator():  # one model
        weight, body = np.frombuffer(r["weight"], np.float32), np.frombuffer(r["body"], np.float32)
        if r["chunk"] < 0:
            model.flat[at:] += body / weight
        else:
            model.rows[np.frombuffer(r["ids"], np.int64)] += body.reshape(len(weight), -1) / weight[:, None]
    return model


def _requests(docs: DataFrame, symbols: Symbols, model: LogBilinear, buckets: int) -> DataFrame:
    """For each part of the documents: one row (bucket -1) with the model's scores
    over its symbols, and for each bucket the other words with their texts."""
    shared = docs.sparkSession.sparkContext.broadcast((symbols, model.flat, model.dim))
    schema = "part string, bucket int, a binary, b binary, c binary, d binary"

    def run(batches):
        known, flat, dim = shared.value
        net = LogBilinear(flat, known.size, dim, known.starts)
        task, k = TaskContext.get().partitionId(), 0
        base = np.log10(known.known_counts() + 0.1)
        # What the model's score subtracts for a word within its class.
        share = np.zeros(len(base))
        share[known.other : known.run] = np.log10(known.n_other + 0.1 * (known.v_other + 1))

        def asked(part: str, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
            hashed, doc = _scan(data, offsets)
            n = rows.num_rows
            unit, one, two, of, own = known.sequence(hashed, doc, n)
            logs = net.log_probabilities(unit, one, two) / np.log(10)
            del one, two
            usual = (unit < known.other) | (unit >= known.end)
            sums = np.stack([
                np.bincount(of, minlength=n), np.bincount(of, logs - share[unit], n),
                np.bincount(of, np.where(usual, base[unit], 0), n),
                np.bincount(of, usual & ((unit != known.end) | (known.n_ends > 0)), n),
            ]).astype(np.float64)
            del unit, of, logs, usual
            ids = rows.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            absent = rows.column(0).is_null().to_numpy(zero_copy_only=False)
            train = np.array(rows.column(2).to_pylist(), bool)
            out = [(part, -1, ids.tobytes(), sums.tobytes(), absent.tobytes(), train.tobytes())]
            rare = (own >= known.other) & (own < known.run)
            keys, back = np.unique(hashed[rare], return_inverse=True)
            both, times = np.unique(back.astype(np.int64) * n + doc[rare], return_counts=True)
            word, text = both // n, both % n
            begin = np.searchsorted(word, np.arange(len(keys) + 1))
            for b, at in _split(keys, buckets):
                size = begin[at + 1] - begin[at]
                take = np.repeat(begin[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                out.append((part, b, keys[at].tobytes(), size.astype(np.uint32).tobytes(), text[take].astype(np.uint32).tobytes(), np.minimum(times[take], 65535).astype(np.uint16).tobytes()))
                many = take[times[take] > 65535]
                for x in many:  # what a 16-bit count can't hold goes in further entries
                    left = int(times[x]) - 65535
                    while left > 0:
                        now = min(left, 65535)
                        out.append((part, b, keys[word[x] : word[x] + 1].tobytes(), np.array([1], np.uint32).tobytes(), np.array([text[x]], np.uint32).tobytes(), np.array([now], np.uint16).tobytes()))
                        left -= now
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])],
                ["part", "bucket", "a", "b", "c", "d"],
            )

        for rows, data, offsets in words.parts(batches, size=PART_BYTES):
            yield asked(f"{task}-{k}", rows, data, offsets)
            k += 1

    return _rows(docs).mapInArrow(run, schema)


def score(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.when(_train(), 1)).alias("ends")).first()
    buckets = 1 + (size["bytes"] or 0) // bucket_bytes
    counts = tables.save(count_words(docs, buckets), "word_counts")
    by_class = counts.select(F.posexplode(F.arrays_zip("n_tokens", "n_words")).alias("class", "x")).groupBy("class")
    by_class = by_class.agg(F.sum("x.n_tokens").alias("n"), F.sum("x.n_words").alias("v")).collect()  # one row a class
    n_class, v_class = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in by_class:
        n_class[r["class"]], v_class[r["class"]] = r["n"], r["v"]
    n_tokens = int(n_class.sum()) + int(size["ends"])
    least = max(LEAST, int(np.ceil(np.sqrt(n_tokens) / SCALE)))
    symbols = Symbols(*frequent_words(counts, least), int(size["ends"]), n_class, v_class)
    model = train(docs, symbols)
    requests = tables.save(_requests(docs, symbols, model, buckets), "requests")

    def answer(rows, count):
        """A part's texts: sums of log10(c + 0.1) and the known, over this bucket's words."""
        if count.num_rows:
            keys = np.frombuffer(count["words"][0].as_py(), np.uint64)
            n = np.frombuffer(count["counts"][0].as_py(), np.int64)
        else:
            keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        parts, bodies = [], []
        for k in range(rows.num_rows):
            word = np.frombuffer(rows["a"][k].as_py(), np.uint64)
            each = np.frombuffer(rows["b"][k].as_py(), np.uint32)
            text = np.frombuffer(rows["c"][k].as_py(), np.uint32).astype(np.int64)
            times = np.frombuffer(rows["d"][k].as_py(), np.uint16)
            c = np.zeros(len(word), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, word), len(keys) - 1)
                c = np.where(keys[at] == word, n[at], 0)
            ids, place = np.unique(text, return_inverse=True)
            logs = np.bincount(place, np.repeat(np.log10(c + 0.1), each) * times, len(ids))
            known = np.bincount(place, np.repeat(c > 0, each) * times, len(ids))
            parts.append(rows["part"][k].as_py())
            bodies.append(ids.astype(np.int32).tobytes() + logs.tobytes() + known.astype(np.int32).tobytes())
        return pa.table({"part": pa.array(parts, pa.string()), "body": pa.array(bodies, pa.binary())})

    n_all, v_all = symbols.n_tokens, symbols.n_distinct
    whole = np.log10(n_all + 0.1 * (v_all + 1))

    def finish(first, rows):
        if not first.num_rows:
            return empty
        ids, train = np.frombuffer(first["a"][0].as_py(), np.int64), np.frombuffer(first["d"][0].as_py(), bool)
        absent = np.frombuffer(first["c"][0].as_py(), bool)
        tokens, logs, base, known = np.frombuffer(first["b"][0].as_py(), np.float64).reshape(4, -1).copy()
        more = np.zeros(len(ids))
        for body in rows["body"].to_pylist():
            n = len(body) // 16
            at = np.frombuffer(body, np.int32, n)
            more[at] += np.frombuffer(body, np.float64, n, 4 * n)
            known[at] += np.frombuffer(body, np.int32, n, 12 * n)
        return pa.table(
            {
                "doc_id": pa.array(ids, mask=absent),
                "held_out": pa.array(~train),
                "n_tokens": pa.array(tokens.astype(np.int64)),
                "n_known": pa.array(known.astype(np.int64)),
                "train_tokens": pa.array(np.full(len(ids), n_all, np.int64)),
                "base_score": pa.array(base + more - tokens * whole),
                "score": pa.array(logs + more),
            }
        )

    kinds = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    empty = pa.schema(kinds).empty_table()
    asked = requests.where("bucket >= 0").groupBy("bucket").cogroup(counts.select("bucket", "words", "counts").groupBy("bucket"))
    answers = tables.save(asked.applyInArrow(answer, "part string, body binary"), "answers")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return requests.where("bucket < 0").groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(finish, schema)

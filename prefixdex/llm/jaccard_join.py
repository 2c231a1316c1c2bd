"""N-gram Jaccard join by chosen paths.

A document's set are the hashes of its runs of five words (a text of one to four
words is one run). Documents with equal sets become one node; nothing below
looks at copies again. A node has a sketch of minimum hashes, whose places are
shared with another node with the probability of their Jaccard similarity.

One run of the join walks the chosen-path tree: at each inner bucket a few places
are sampled (1 / similarity on average, one at least), and a node goes to the
child bucket named by the path so far, the place and its value there. Buckets of
more than ``LIMIT`` nodes are split further, up to ``DEPTH`` times; which ones is found
by counting, and goes to every task as a list of at most ``SPLITS`` paths, the largest
first (a bucket that is not on it is only compared as it is). In a bucket, nodes
whose sketches agree, with a margin of four standard errors, are linked, and only
one star for each group of linked nodes is passed on. Runs are repeated, a round at
a time, until the estimated recall is reached: from the nodes linked in one run only
and in two runs, Chao's estimate tells how many no run has linked yet. It is of nodes, not
of pairs, and only of those with a partner whose sketch agrees in ``STRONG`` places: the
many that agree less are mostly below the similarity and are met by chance, one by one.

A bucket that stays large is dealt into blocks of nodes. In each, nodes that nearly
agree with a leader are folded into it, and leaders are compared with each other, also
across blocks, by a threshold that their distance to the folded nodes is taken off
from: as differing places obey the triangle inequality, whatever a comparison of all
with all would have linked is linked.

The sketch only proposes groups. Within each connected group all pairs are then
compared exactly, as products of 0/1 matrices of the sets, tile by tile; a group of
more than ``SET_BYTES`` is dealt into blocks of that size, and each pair of blocks is
compared in one task. That gives each node's links of the wanted similarity (so a
group of n different texts costs n^2 / 2 comparisons of sets), and the classes.

Rows are told apart by their id and the md5 of their text; rows that agree in both
are interchangeable.

Defined cases: null and empty texts have no set: no links and a class of their
own; rows that repeat a doc_id are documents of their own with the same id; a
null doc_id is in a class like others, whose id is the smallest that is not
null; an empty table gives an empty result; texts of any length are read whole;
further columns are not looked at by ``join`` and kept by ``dedup``, whatever their
names. Of each class ``dedup`` keeps one row: the smallest id (null last), then the
smallest md5; of rows that agree in both, any one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixdex.llm import tables, words
from prefixdex.llm.components import components, local
from prefixdex.plans.session import measure

SHINGLE = 5
SIMILARITY = (4, 5)
HASHES = 64
LOOSE = 38  # of 64 places, four standard errors below 0.8
STRONG = 45  # two standard errors below 0.8: links that the recall is estimated of
TIGHT = 58  # places shared with a leader by the nodes folded into it
LIMIT = 256
DEPTH = 7
SPLITS = 1_000_000  # paths that are split, or dealt into blocks: 16 MB for each task
BLOCK = 4096  # nodes of a block, where a bucket stays large
TILE = 512  # sets compared by one matrix product
SET_BYTES = 8 << 20  # sets of a block, likewise of a group compared at once
FOLD = 1 << 19  # alike pairs a task holds before it folds them into stars
RUNS = 2  # of each round
ROUNDS = 32  # at most: a pair of the similarity meets in one of 64 runs but for 1e-14
RECALL = 0.999
CELL_ROWS = 20_000
CELL_BYTES = 8 << 20
FEW_ROWS, FEW_BYTES = 500_000, 32 << 20  # members that go to the texts by broadcast

_SEEDS = words.mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFT = words.mix(np.arange(1001, HASHES + 1001, dtype=np.uint64))


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct run hashes of every text, in order of text and hash, and their texts."""
    starts, ends = words.spans(data, offsets)
    hashed, doc = words.hashes(data, starts, ends), words.owners(offsets, starts)
    run, whole = words.runs(hashed, doc, SHINGLE)
    found, of = [run[whole]], [doc[: len(run)][whole]]
    length = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.cumsum(length) - length
    for n in range(1, SHINGLE):
        short = np.flatnonzero(length == n)
        value = np.full(len(short), n, np.uint64)
        for k in range(n):
            value = words.mix(value) + hashed[first[short] + k]
        found.append(words.mix(value)), of.append(short)
    value, text = np.concatenate(found), np.concatenate(of)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], text[new]


def _keys(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set, whatever its order."""
    return words.mix(np.add.reduceat(words.mix(value ^ np.uint64(0x5DEECE66D)), first)).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, digest, node (a hash of the set, null without one), n (size of the set)
    and sketch of every row."""

    def run(batches):
        for rows, data, offsets in words.parts(batches):
            value, text = _sets(data, offsets)
            n = np.bincount(text, minlength=rows.num_rows)
            there = np.flatnonzero(n)
            first = (np.cumsum(n) - n)[there]
            node = np.zeros(rows.num_rows, np.int64)
            sketch = np.zeros((len(there), HASHES), np.uint32)
            if len(there):
                node[there] = _keys(value, first)
                for k in range(HASHES):
                    sketch[:, k] = np.minimum.reduceat(value * _SEEDS[k] + _SHIFT[k], first) >> np.uint64(32)
            each = [None] * rows.num_rows
            for k, i in enumerate(there):
                each[i] = sketch[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(node, mask=n == 0), pa.array(n.astype(np.int32)), pa.array(each, pa.binary())],
                ["doc_id", "digest", "node", "n", "sketch"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), tables.digest().alias("digest"), "text")
    return rows.mapInArrow(run, "doc_id long, digest binary, node long, n int, sketch binary")


def _children(path: np.ndarray, at: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``path``, child path): each bucket's node ``at`` goes on by one sampled
    place, or two."""
    places = np.uint64(HASHES)
    one, two = words.mix(path) % places, words.mix(path + np.uint64(1)) % places
    often = words.mix(path + np.uint64(2)) < np.uint64((SIMILARITY[1] / SIMILARITY[0] - 1) * 2**64)
    of, child = [], []
    for turn, (place, goes) in enumerate(((one, slice(None)), (two, often & (one != two)))):
        i = np.arange(len(path))[goes]
        value = sketch[at[i], place[i]].astype(np.uint64)
        child.append(words.mix(words.mix(path[i] + np.uint64(turn)) ^ words.mix(value + (place[i] << np.uint64(32)))))
        of.append(i)
    return np.concatenate(of), np.concatenate(child)


def _find(sorted_paths: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Place of each path in the list, or -1."""
    if not len(sorted_paths):
        return np.full(len(path), -1)
    k = np.minimum(np.searchsorted(sorted_paths, path), len(sorted_paths) - 1)
    return np.where(sorted_paths[k] == path, k, -1)


def walk(sketch: np.ndarray, runs: range, split: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, run, path, depth) of the buckets that the nodes (rows of ``sketch``) end in,
    where the buckets of ``split`` (sorted paths) are gone through."""
    n = len(sketch)
    at, run = np.tile(np.arange(n), len(runs)), np.repeat(np.array(runs), n)
    path = words.mix(run.astype(np.uint64) + np.uint64(77)) >> np.uint64(2)
    out = []
    for depth in range(DEPTH + 1):
        of, path = _children(path, at, sketch)
        at, run = at[of], run[of]
        on = _find(split, path) >= 0 if depth < DEPTH else np.zeros(len(path), bool)
        out.append((at[~on], run[~on], path[~on], np.full(int((~on).sum()), depth)))
        at, run, path = at[on], run[on], path[on]
        if not len(path):
            break
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _crowded(nodes: DataFrame, runs: range, split: np.ndarray, level: int) -> DataFrame:
    """(path, members) of the buckets of more than ``LIMIT`` nodes that end at one level."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                _, _, path, depth = walk(_sketches(batch.column(0)), runs, split)
                yield pa.RecordBatch.from_arrays([pa.array(path[depth == level].view(np.int64))], ["path"])

    found = nodes.select("sketch").mapInArrow(run, "path long").groupBy("path")
    return found.agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > LIMIT)


def _listed(crowded: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The paths of the ``most`` largest buckets, sorted, and their members."""
    t = crowded.orderBy(F.col("members").desc(), "path").limit(most).select("path", "members").toArrow()
    path, members = t["path"].to_numpy().view(np.uint64), t["members"].to_numpy()
    order = np.argsort(path)
    return path[order], members[order]


def _tree(nodes: DataFrame, runs: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The paths to split, and those that stay crowded all the same with their members:
    level by level, each counting what the splits of the one before lead to."""
    split, stay, members = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for level in range(DEPTH + 1):
        path, n = _listed(_crowded(nodes, runs, split, level), SPLITS)
        order = np.argsort(-n, kind="stable")
        room = SPLITS - len(split) if level < DEPTH else 0
        split = np.sort(np.concatenate([split, path[order[:room]]]))
        stay, members = np.concatenate([stay, path[order[room:]]]), np.concatenate([members, n[order[room:]]])
        if not len(order[:room]):
            break
    order = np.argsort(stay)
    return split, stay[order], members[order]


def _buckets(nodes: DataFrame, runs: range) -> DataFrame:
    """(run, path, block, blocks, node, sketch) of every node in the bucket it ends in.
    ``blocks`` is 0 for a bucket compared whole; of the sketch only the low bytes go along."""
    split, crowded, members = _tree(nodes, runs)
    size = BLOCK
    shared = nodes.sparkSession.sparkContext.broadcast((split, crowded, 1 + members // size))

    def run(batches):
        split, crowded, parts = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            node, sketch = batch.column(0).to_numpy(), _sketches(batch.column(1))
            at, turn, path, _ = walk(sketch, runs, split)
            k = _find(crowded, path)
            blocks = np.where(k >= 0, parts[k] if len(parts) else 0, 0)
            block = words.mix(node[at].view(np.uint64) ^ path) % np.maximum(blocks, 1).astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(turn.astype(np.int32)), pa.array(path.view(np.int64)), pa.array(block.astype(np.int32)), pa.array(blocks.astype(np.int32)),
                 pa.array(node[at]), _fixed(sketch.astype(np.uint8)[at])],
                ["run", "path", "block", "blocks", "node", "sketch"],
            )

    return nodes.select("node", "sketch").mapInArrow(run, "run int, path long, block int, blocks int, node long, sketch binary")


class _Stars:
    """Links of some nodes, folded into one star for each group as they become many."""

    def __init__(self, n: int, most: int):
        self.n, self.most, self.held, self.a, self.b = n, most, 0, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a), self.b.append(b)
        self.held += len(a)
        if self.held > self.most:
            root = self.roots()
            other = np.flatnonzero(root != np.arange(self.n))
            self.a, self.b, self.held = [other], [root[other]], len(other)

    def roots(self) -> np.ndarray:
        return local(self.n, np.concatenate(self.a), np.concatenate(self.b))


def _alike(path: np.ndarray, sketch: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest member of the group of each node (in the order of ``path``), and whether it has
    a strong link; all pairs of a bucket are compared."""
    stars, strong, d = _Stars(len(path), most), np.zeros(len(path), bool), 1
    at = np.arange(len(path) - 1)
    while len(at):
        at = at[at + d < len(path)]
        at = at[path[at] == path[at + d]]
        for lo in range(0, len(at), 1 << 14):
            x = at[lo : lo + (1 << 14)]
            same = (sketch[x] == sketch[x + d]).sum(1)
            y = x[same >= STRONG]
            strong[y] = strong[y + d] = True
            x = x[same >= LOOSE]
            stars.add(x, x + d)
        d += 1
    return stars.roots(), strong


def _between(stars: _Stars, a: np.ndarray, b: np.ndarray, sketch: np.ndarray, radius: np.ndarray, later: bool) -> None:
    """Link the leaders ``a`` with the leaders ``b`` (``later``: those after each in the same
    list) whose nodes may be alike: two nodes of theirs differ by less than the leaders do, by
    the two radii at most."""
    for k, x in enumerate(a.tolist()):
        rest = b[k + 1 :] if later else b
        near = rest[(sketch[rest] == sketch[x]).sum(1) >= LOOSE - radius[x] - radius[rest]]
        stars.add(np.full(len(near), x), near)


def _folded(sketch: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leaders of a block, the differing places of their furthest node, the root of every
    node of the block, and whether it has a strong link to a leader, or is one's."""
    stars, left = _Stars(len(sketch), most), np.arange(len(sketch))
    leaders, radius, strong = [], np.zeros(len(sketch), np.int64), np.zeros(len(sketch), bool)
    while len(left):
        same = (sketch[left] == sketch[left[0]]).sum(1)
        near = same >= TIGHT
        if (linked := left[same >= STRONG]).size > 1:
            strong[linked] = True
        leaders.append(left[0])
        radius[left[0]] = HASHES - int(same[near].min())
        stars.add(left[near], np.full(int(near.sum()), left[0]))
        left = left[~near]
    leaders = np.array(leaders)
    _between(stars, leaders, leaders, sketch, radius, True)
    return leaders, radius, stars.roots(), strong


_FOUND = "run int, a long, b long, strong_a boolean, strong_b boolean, path long, block int, blocks int, sketch binary, radius int"
_STARS = ["run", "a", "b", "strong_a", "strong_b"]


def _round(nodes: DataFrame, runs: range) -> DataFrame:
    """(run, a, b, strong_a, strong_b): stars found by some runs of the chosen-path tree."""
    rows, cells, most = _buckets(nodes, runs), 1 + 5 * len(runs) * nodes.count() // (4 * CELL_ROWS), FOLD

    def stars(turn, node, root, strong):
        other = np.flatnonzero(root != np.arange(len(root)))
        none, hub = pa.nulls(len(other)), root[other]
        kinds = {"path": pa.int64(), "block": pa.int32(), "blocks": pa.int32(), "sketch": pa.binary(), "radius": pa.int32()}
        ends = {"run": turn[other], "a": node[other], "b": node[hub], "strong_a": strong[other], "strong_b": strong[hub]}
        return pa.table({**ends, **{c: none.cast(k) for c, k in kinds.items()}})

    def link(rows):
        path, node, turn, block, blocks = (rows[c].to_numpy() for c in ("path", "node", "run", "block", "blocks"))
        order = np.lexsort((node, block, path))
        path, node, turn, block, blocks = path[order], node[order], turn[order], block[order], blocks[order]
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(-1, HASHES)[order]
        whole = np.flatnonzero(blocks == 0)
        out = [stars(turn[whole], node[whole], *_alike(path[whole], sketch[whole], most))]
        rest = np.flatnonzero(blocks > 0)
        for at in np.split(rest, np.flatnonzero((np.diff(path[rest]) != 0) | (np.diff(block[rest]) != 0)) + 1):
            if not len(at):
                continue
            leaders, radius, root, strong = _folded(sketch[at], most)
            out.append(stars(turn[at], node[at], root, strong))
            if blocks[at[0]] > 1:
                of = at[leaders]
                out.append(pa.table({
                    "run": turn[of], "a": node[of], "b": node[of], "strong_a": strong[leaders], "strong_b": strong[leaders], "path": path[of], "block": block[of], "blocks": blocks[of],
                    "sketch": _fixed(sketch[of]), "radius": radius[leaders].astype(np.int32),
                }))
        return pa.concat_tables(out)

    def across(rows):
        block, turn, node, radius = (rows[c].to_numpy() for c in ("block", "run", "a", "radius"))
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(-1, HASHES)
        found = _Stars(len(node), most)
        first = block == block.min()
        if not first.all():
            _between(found, np.flatnonzero(first), np.flatnonzero(~first), sketch, radius, False)
        return stars(turn, node, found.roots(), np.zeros(len(node), bool)).select(_STARS)

    crowded = F.col("blocks") > 0
    cell = F.when(crowded, -1 - F.pmod(F.xxhash64("path", "block"), F.lit(1 << 62))).otherwise(F.pmod(F.xxhash64("path"), F.lit(cells)))
    found = tables.save(rows.withColumn("cell", cell).groupBy("cell").applyInArrow(link, _FOUND), "linked")
    out = found.where("sketch is null").select(*_STARS)
    leaders = found.where("sketch is not null")
    if leaders.isEmpty():
        return out
    pairs = leaders.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block")
    pairs = pairs.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return out.unionByName(pairs.groupBy("path", "low", "high").applyInArrow(across, "run int, a long, b long, strong_a boolean, strong_b boolean"))


def runs_of_nodes(stars: DataFrame) -> DataFrame:
    """(node, runs): in how many runs each node has a strong link."""
    ends = stars.where("strong_a").select("run", F.col("a").alias("node")).unionByName(stars.where("strong_b").select("run", F.col("b").alias("node")))
    return ends.distinct().groupBy("node").agg(F.count(F.lit(1)).alias("runs"))


def estimated_recall(tally: DataFrame) -> float:
    """Share of the nodes with a strong link that some run has linked, by Chao's estimate
    of those that none has: ``f1^2 / (2 f2)``, ``f1`` and ``f2`` linked in one and two."""
    r = tally.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("runs") == 1).alias("f1"), F.count_if(F.col("runs") == 2).alias("f2")).first()
    unseen = r["f1"] ** 2 / (2 * r["f2"]) if r["f2"] else r["f1"] * (r["f1"] - 1) / 2
    return r["n"] / (r["n"] + unseen) if r["n"] else 1.0


def groups(nodes: DataFrame, recall: float = RECALL) -> DataFrame:
    """(node, label): groups that contain every linked pair, by rounds of runs until
    the estimated recall is reached."""
    done, stars, tally = 0, None, None
    while done < RUNS * ROUNDS and (tally is None or estimated_recall(tally) < recall):
        found = tables.save(_round(nodes, range(done, done + RUNS)), "stars")
        stars, done = found if stars is None else stars.unionByName(found), done + RUNS
        new = runs_of_nodes(found)
        if tally is not None:
            new = tally.unionByName(new).groupBy("node").agg(F.sum("runs").alias("runs"))
        tally = tables.save(new, "runs")
    return tables.save(components(stars.select("a", "b")), "labels")


def _shared(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of the sets ``a`` with the sets ``b`` (none: with each
    other), by products of 0/1 matrices over some thousand hashes at a time."""
    sets = a + (b or [])
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, times = np.unique(value, return_inverse=True, return_counts=True)
    kept = times[place] > 1
    place, owner = place[kept], owner[kept]
    kinds, place = np.unique(place, return_inverse=True)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((len(a), len(b or a)), np.float32)
    for lo in range(0, len(kinds), 4096):
        i, j = np.searchsorted(place, [lo, lo + 4096])
        m = np.zeros((len(sets), min(4096, len(kinds) - lo)), np.float32)
        m[owner[i:j], place[i:j] - lo] = 1
        out += m[: len(a)] @ (m[len(a) :] if b else m).T
    return out.astype(np.int64)


def _compared(sets: list[np.ndarray], copies: np.ndarray, first: int, tile: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of every set, and the root of its group. With ``first`` sets of one block before
    those of another, only pairs between the two are compared, else all."""
    n, size = len(sets), np.array([len(s) for s in sets])
    links, stars = np.zeros(n, np.int64), _Stars(n, most)
    cuts = lambda lo, hi: [(i, min(i + tile, hi)) for i in range(lo, hi, tile)]
    pairs = [(x, y) for x in cuts(0, first) for y in cuts(first, n)] if first else [(x, y) for x in cuts(0, n) for y in cuts(0, n) if x <= y]
    for (i, j), (k, m) in pairs:
        alone = i == k
        same = _shared(sets[i:j]) if alone else _shared(sets[i:j], sets[k:m])
        like = SIMILARITY[1] * same >= SIMILARITY[0] * (size[i:j, None] + size[None, k:m] - same)
        if alone:
            np.fill_diagonal(like, False)
        else:
            links[k:m] += copies[i:j] @ like
        links[i:j] += like @ copies[k:m]
        a, b = np.nonzero(like)
        stars.add(a + i, b + k)
    return links, stars.roots()


def links(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(node, n_links, root, blocks) for the nodes of each group (node, label, copies, id,
    digest, blocks): rows with a set alike, and the star, around the smallest, of
    the linked nodes. Where ``blocks`` is 1 the group is compared at once, and its stars are
    its classes; a node of a larger group has a row for each pair of blocks."""
    tile, most = TILE, FOLD

    def sets(batches):
        for rows, data, offsets in words.parts(batches):
            value, text = _sets(data, offsets)
            n = np.bincount(text, minlength=rows.num_rows)
            first = np.cumsum(n) - n
            body = [value[f : f + k].tobytes() for f, k in zip(first.tolist(), n.tolist(), strict=True)]
            names = ["node", "label", "copies", "blocks"]
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in names), pa.array(body, pa.binary())], [*names, "body"])

    def compare(rows):
        label, node, copies, blocks, block, low, high = (rows[c].to_numpy() for c in ("label", "node", "copies", "blocks", "block", "low", "high"))
        body = rows["body"].to_pylist()
        order = np.lexsort((node, block, high, low, label))
        cuts = np.flatnonzero((np.diff(label[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)) + 1
        out = {"node": [], "n_links": [], "root": [], "blocks": []}
        for at in np.split(order, cuts):
            across = low[at[0]] != high[at[0]]
            first = int((block[at] == low[at[0]]).sum()) if across else 0
            if across and first in (0, len(at)):  # one of the two blocks has no node
                found, root = np.zeros(len(at), np.int64), np.arange(len(at))
            else:
                found, root = _compared([np.frombuffer(body[i], np.uint64) for i in at], copies[at], first, tile, most)
            for c, v in zip(out, (node[at], found, node[at][root], blocks[at]), strict=True):
                out[c].append(v)
        return pa.table({k: np.concatenate(v).astype(np.int64) for k, v in out.items()})

    # One row of each node: the texts of few members are found without moving the others.
    few, n_bytes = measure(members, FEW_ROWS)
    held = F.broadcast(members) if few <= FEW_ROWS and n_bytes <= FEW_BYTES else members.hint("merge")
    texts = docs.select(tables.known_id().alias("id"), tables.digest().alias("digest"), "text").join(held, ["id", "digest"])
    full = texts.select("text", "node", "label", "copies", "blocks").mapInArrow(sets, "node long, label long, copies long, blocks long, body binary")
    full = tables.save(full.dropDuplicates(["node"]), "sets")
    whole, zero = F.col("blocks") == 1, F.lit(0).cast("long")
    cells = 1 + (full.where(whole).agg(F.sum(F.octet_length("body"))).first()[0] or 0) // CELL_BYTES
    small = full.where(whole).select("*", zero.alias("block"), zero.alias("low"), zero.alias("high"), F.pmod(F.xxhash64("label"), F.lit(cells)).alias("cell"))
    dealt = full.where(~whole).withColumn("block", F.pmod(F.xxhash64("node", "label"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")
    both = small.unionByName(dealt.withColumn("cell", F.xxhash64("label", "low", "high")))
    return both.groupBy("cell").applyInArrow(compare, "node long, n_links long, root long, blocks long")


def _classes(docs: DataFrame, recall: float) -> DataFrame:
    """doc_id, digest, node, label (of its class), class_id, n_links, class_size of every row."""
    rows = tables.save(signatures(docs), "signatures")
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.min(F.struct(tables.known_id().alias("id"), "digest")).alias("row"), F.min("doc_id").alias("least_id"),
        F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.min("sketch").alias("sketch"),
    )
    nodes = tables.save(nodes.select("node", "row.id", "row.digest", "least_id", "copies", "n", "sketch"), "nodes")
    labels = groups(nodes, recall).join(nodes.select("node", "id", "digest", "copies", "n"), "node")
    labels = tables.save(labels, "grouped")
    sizes = labels.groupBy("label").agg(F.sum(8 * F.col("n").cast("long")).alias("bytes"))
    members = labels.join(sizes, "label").withColumn("blocks", 1 + F.expr(f"bytes div {SET_BYTES}"))
    members = tables.save(members.select("node", "label", "copies", "id", "digest", "blocks"), "members")
    found = tables.save(links(docs, members), "links")
    counted = found.groupBy("node").agg(F.sum("n_links").alias("linked"))
    classes = found.where("blocks = 1").select("node", F.col("root").alias("label"))
    parts = found.where("blocks > 1 and node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    if not parts.isEmpty():
        classes = classes.unionByName(components(parts))
    named = nodes.select("node", "least_id", "copies").join(counted, "node", "left").join(classes, "node", "left")
    named = named.withColumn("label", F.coalesce("label", "node"))
    named = tables.save(named.withColumn("n_links", F.coalesce("linked", F.lit(0)) + F.col("copies") - 1), "named")
    whole = named.groupBy("label").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"))
    named = named.join(whole, "label").select("node", "label", "class_id", "class_size", "n_links")
    return rows.select("doc_id", "digest", "node").join(named.hint("merge"), "node", "left")


def join(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """One row per document row: doc_id, class_id (smallest id of its class),
    n_links (other rows of the similarity wanted) and class_size."""
    return _classes(docs, recall).select(
        "doc_id",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
    )


def dedup(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each class (rows
    without words all stay)."""
    # A null id as the largest: it comes last.
    rows = _classes(docs, recall).where("class_size > 1").select("label", tables.known_id(null=(1 << 63) - 1).alias("id"), "digest")
    rows = tables.save(rows.groupBy("label", "id", "digest").agg(F.count(F.lit(1)).alias("n")), "classes")
    kept = rows.groupBy("label").agg(F.min(F.struct("id", "digest", "n")).alias("first"))
    marked = rows.join(kept, "label").withColumn("stays", (F.col("id") == F.col("first.id")) & (F.col("digest") == F.col("first.digest")))
    marked = tables.save(marked.select("id", "digest", "n", "stays"), "marked")
    ident, digest = tables.unused(docs, "__id"), tables.unused(docs, "__digest")
    keyed = docs.withColumn(ident, tables.known_id(null=(1 << 63) - 1)).withColumn(digest, tables.digest())
    name = lambda rows: rows.select(F.col("id").alias(ident), F.col("digest").alias(digest)).hint("merge")
    several = marked.where("stays and n > 1")
    if several.isEmpty():
        return keyed.join(name(marked.where("not stays")), [ident, digest], "left_anti").drop(ident, digest)
    # Rows alike in id and text: one of them stays.
    one = keyed.join(name(several), [ident, digest], "left_semi").dropDuplicates([ident, digest])
    rest = keyed.join(name(marked.where("not stays or n > 1")), [ident, digest], "left_anti")
    return rest.unionByName(one).drop(ident, digest)

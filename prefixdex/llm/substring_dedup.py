"""Substring dedup with one FM-index for each shard of the text.

A window is 13 consecutive words. Windows are sharded by content, so that equal
windows meet in one shard: each window belongs to the smallest hash of its runs
of five words, and a maximal run of windows with the same smallest hash is a
segment. Segments whose hash occurs in one document only can't be repeated and
are left out, by an exact grouped minimum and maximum over all segments. The
others are cut out of the texts, and equal segments become one with its
smallest doc_id.

A segment can only be removed for one of a smaller id, so of each hash the segments of
its largest id are not indexed and those of its smallest id are not streamed. Each
shard builds a compressed FM-index (wavelet matrix over the BWT) of the distinct
segments on the one side and streams those of the other through it: backward search
gives, for every word, how many words up to it the index holds (matching statistics, up
to 13), and the smallest doc_id in the interval of those that reach 13. A document's
window is removed where that is smaller than its own id; one whose statistics stay
below 13 is found nowhere else, though it shares a hash.

A hash with more distinct segments than a quarter of a shard (the edges of a passage
that many documents share) is split by a second content key: its segments are taken
apart into their distinct windows, each sharded by the hash of its 13 words.

Defined cases: a null or empty text has no words; texts under 13 words have no
window and stay; windows repeated within one document only stay; rows that
repeat a doc_id are judged each, and do not count as smaller than each other (they are
told apart by 64 bits of their text's hash; equal ones lose the same); a null doc_id
ranks below every other; texts of any length are read whole; an empty table gives an
empty result, whose columns are its own five: further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixdex.llm import tables, words
from prefixdex.llm.fm_index import FMIndex
from prefixdex.plans.session import broadcast_if_small

WINDOW = 13
ANCHOR = 5
SHARD_WORDS = 500_000
_MOST = 16  # windows of a segment
_NO_ID = -(1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows by id and a hash of the text, since ids may repeat."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("row"), "text")


def _segments(data: np.ndarray, offsets: np.ndarray):
    """Hash, text, first window (counted in its text) and windows of each segment."""
    starts, ends = words.spans(data, offsets)
    n = len(starts) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    doc = words.owners(offsets, starts)
    anchor, _ = words.runs(words.hashes(data, starts, ends), doc, ANCHOR)
    low = anchor[:n].copy()
    for k in range(1, WINDOW - ANCHOR + 1):
        np.minimum(low, anchor[k : k + n], out=low)
    whole = doc[:n] == doc[WINDOW - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (low[at[1:]] != low[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
    run = np.flatnonzero(new)
    within = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    first = np.flatnonzero(within % _MOST == 0)
    size = np.diff(np.append(first, len(at)))
    begin = np.searchsorted(doc, np.arange(len(offsets) - 1))
    own = at[first]
    return low[own].view(np.int64), doc[own], own - begin[doc[own]], size


def references(docs: DataFrame) -> DataFrame:
    """(hash, id, row, place) of every segment; place holds the first window's word and,
    in its last 4 bits, the windows."""

    def run(batches):
        for rows, data, offsets in words.parts(batches):
            hashed, doc, first, size = _segments(data, offsets)
            ids, row = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(hashed), pa.array(ids[doc]), pa.array(row[doc]), pa.array(first << 4 | size - 1)], ["hash", "id", "row", "place"])

    return _keyed(docs).mapInArrow(run, "hash long, id long, row long, place long")


def repeated(docs: DataFrame) -> DataFrame:
    """The references whose hash occurs in several documents, with two more bits in their
    place: whether another has a larger id (to be indexed), and a smaller one (to be
    streamed)."""
    held = tables.save(references(docs), "references")
    several = held.groupBy("hash").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    return held.join(several.hint("merge"), "hash").select(
        "hash", "id", "row", F.expr("place * 4 + if(id < high, 2, 0) + if(id > low, 1, 0)").alias("place")
    )


def cut(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(hash, id, row, first, body, indexed, streamed): the wanted segments as words joined
    by a space."""
    lists = wanted.groupBy("id", "row").agg(F.collect_list(F.struct("hash", "place")).alias("places"))

    def run(batches):
        for rows, data, offsets in words.parts(batches):
            starts, ends = words.spans(data, offsets)
            raw = data.tobytes()
            begin = np.searchsorted(starts, offsets[:-1])
            column = rows.column(3)
            counts = pc.list_value_length(column).to_numpy()
            flat = pc.list_flatten(column)
            hashed, place = (pc.struct_field(flat, k).to_numpy() for k in (0, 1))
            doc = np.repeat(np.arange(rows.num_rows), counts)
            first, size = place >> 6, (place >> 2 & 15) + 1
            lo = starts[begin[doc] + first]
            hi = ends[begin[doc] + first + size + WINDOW - 2]
            body = [b" ".join(raw[a:b].split()) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashed), rows.column(0).take(pa.array(doc)), rows.column(1).take(pa.array(doc)), pa.array(first.astype(np.int32)),
                 pa.array(body, pa.binary()).cast(pa.string()), pa.array(place & 2 > 0), pa.array(place & 1 > 0)],
                ["hash", "id", "row", "first", "body", "indexed", "streamed"],
            )

    texts = _keyed(docs).join(lists.hint("merge"), ["id", "row"]).dropDuplicates(["id", "row"])
    return texts.select("id", "row", "text", "places").mapInArrow(run, "hash long, id long, row long, first int, body string, indexed boolean, streamed boolean")


def _distinct(segments: DataFrame) -> DataFrame:
    """(hash, body, id, streamed) of every distinct segment: the smallest id of those to be
    indexed (null: none), and whether any is streamed."""
    return segments.groupBy("hash", "body").agg(F.min("id").alias("id"), F.max("streamed").alias("streamed"))


def _windows(segments: DataFrame) -> DataFrame:
    """(hash, of, k, body, id, streamed) of every window of the distinct segments: the digest
    of its segment, its place in it and its words."""
    split = segments.select("hash", "id", "streamed", F.xxhash64("body").alias("of"), F.split("body", " ").alias("words"))
    rows = split.select("*", F.explode(F.sequence(F.lit(0), F.size("words") - WINDOW)).alias("k"))
    return rows.select("hash", "of", "k", F.array_join(F.slice("words", F.col("k") + 1, WINDOW), " ").alias("body"), "id", "streamed")


def smallest_ids(segments: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(hash, digest, low): for each window of a streamed segment the smallest indexed id
    that has it, from the FM-index of the window's shard (none: the largest number)."""
    distinct = _distinct(segments.select("hash", "body", F.when(F.col("indexed"), F.col("id")).alias("id"), "streamed"))
    distinct = tables.save(distinct, "distinct_segments")
    most = max(1, shard_words // (4 * (WINDOW + 4)))
    hot = tables.save(distinct.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("hash"), "hot_hashes")
    if hot.isEmpty():
        return _indexed(distinct, F.col("hash"), shard_words)
    # At most one hash in ``most`` segments is hot; how many there are is measured.
    low = _indexed(distinct.join(broadcast_if_small(hot), "hash", "left_anti"), F.col("hash"), shard_words)
    windows = tables.save(_windows(distinct.join(broadcast_if_small(hot), "hash", "left_semi")), "hot_windows")
    alone = _indexed(_distinct(windows), F.xxhash64("body"), shard_words)
    found = windows.where("streamed").select("hash", "of", "k", F.xxhash64("body").alias("digest")).join(alone.hint("merge"), ["hash", "digest"])
    found = found.groupBy("hash", "of").agg(F.sort_array(F.collect_list(F.struct("k", F.col("low")[0].alias("low")))).alias("low"))
    return low.unionByName(found.select("hash", F.col("of").alias("digest"), F.col("low.low").alias("low")))


def _text(symbol: np.ndarray, length: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of some rows in one sequence, a separator (0) before each; the row (of
    those) of every symbol, and its place."""
    begin = np.cumsum(length) - length
    n = length[rows]
    of = np.repeat(np.arange(len(rows)), n)
    within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    place = np.arange(len(of)) + of + 1
    text = np.zeros(len(of) + len(rows), np.int64)
    text[place] = symbol[np.repeat(begin[rows], n) + within]
    return text, of, place


def _indexed(distinct: DataFrame, key: Column, shard_words: int) -> DataFrame:
    """(hash, digest, low) of the streamed segments, from one FM-index for each shard of
    ``key``; equal windows have equal keys."""
    shards = 1 + distinct.count() * (WINDOW + 4) // shard_words
    none = np.iinfo(np.int64).max

    def run(rows):
        split = pc.split_pattern(rows["body"].combine_chunks(), " ")
        length = pc.list_value_length(split).to_numpy().astype(np.int64)
        symbol = pc.dictionary_encode(pc.list_flatten(split)).indices.to_numpy().astype(np.int64) + 1
        held = np.flatnonzero(rows["id"].is_valid().to_numpy())
        text, of, place = _text(symbol, length, held)
        index = FMIndex(text, WINDOW)
        # The ids are few among many suffixes: each suffix has the rank of its own.
        ids, rank = np.unique(rows["id"].fill_null(0).to_numpy()[held], return_inverse=True)
        owner = np.zeros(len(text), np.uint32)
        owner[place] = rank[of]
        smallest = np.append(owner[index.places], np.uint32(len(ids)))
        index.places = None
        ids = np.append(ids, none)
        asked = np.flatnonzero(rows["streamed"].to_numpy())
        stream, of, place = _text(symbol, length, asked)
        n = length[asked]
        within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        ends = place[within >= WINDOW - 1] + 1
        low = np.empty(len(ends), np.int64)
        for a in range(0, len(ends), 1 << 17):
            matched, lo, hi = index.matches(stream, ends[a : a + (1 << 17)], WINDOW)
            found = np.flatnonzero(matched >= WINDOW)
            low[a : a + (1 << 17)] = none
            if len(found):
                kinds, first, back = np.unique(lo[found], return_index=True, return_inverse=True)
                least = np.minimum.reduceat(smallest, np.stack([kinds, hi[found][first]], 1).ravel())[::2]
                low[a + found] = ids[least][back]
        cuts = np.concatenate([[0], np.cumsum(n - WINDOW + 1)]).astype(np.int32)
        of = pa.array(asked)
        return pa.table({"hash": rows["hash"].take(of), "digest": rows["digest"].take(of), "low": pa.ListArray.from_arrays(pa.array(cuts), pa.array(low))})

    rows = distinct.select(F.pmod(key, F.lit(shards)).alias("shard"), "hash", "body", "id", "streamed", F.xxhash64("body").alias("digest"))
    return rows.groupBy("shard").applyInArrow(run, "hash long, digest long, low array<long>")


def removed_windows(docs: DataFrame) -> DataFrame:
    """(id, row, windows): the first words of the windows to remove, by row of ``docs``."""
    # A table of its own: the shuffles that found it are gone before the texts move.
    wanted = tables.save(repeated(docs), "wanted")
    segments = tables.save(cut(docs, wanted), "segments")
    low = tables.save(smallest_ids(segments), "smallest_ids")
    rows = segments.where("streamed").select("hash", F.xxhash64("body").alias("digest"), "id", "row", "first").join(low.hint("merge"), ["hash", "digest"])
    marked = F.filter(F.transform("low", lambda x, k: F.when(x < F.col("id"), F.col("first") + k)), lambda x: x.isNotNull())
    found = rows.select("id", "row", marked.alias("windows")).where(F.size("windows") > 0)
    return found.groupBy("id", "row").agg(F.flatten(F.collect_list("windows")).alias("windows"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and the removed intervals of words of
    every document row."""
    found = tables.save(removed_windows(docs), "removed")
    schema = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>"

    def run(batches):
        for rows, data, offsets in words.parts(batches):
            starts, ends = words.spans(data, offsets)
            raw = data.tobytes()
            begin = np.searchsorted(starts, offsets)
            n = np.diff(begin)
            windows = rows.column(rows.schema.get_field_index("windows")).to_pylist()
            texts, gone, cuts = [], [], []
            for i in range(rows.num_rows):
                body = raw[offsets[i] : offsets[i + 1]]
                if not windows[i]:
                    texts.append(b" ".join(body.split())), gone.append(0), cuts.append([])
                    continue
                edge = np.zeros(n[i] + 1, np.int64)
                at = np.unique(windows[i])
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WINDOW, -1)
                out = np.cumsum(edge)[:-1] > 0
                each = body.split()
                texts.append(b" ".join([each[k] for k in np.flatnonzero(~out)]))
                gone.append(int(out.sum()))
                turn = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
                cuts.append([{"start": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0), pa.array(n), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()),
                    pa.array(cuts, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                ["doc_id", "n_words", "n_removed", "kept_text", "removed"],
            )

    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("row"), "text")
    return keyed.join(found.hint("merge"), ["id", "row"], "left").select("doc_id", "text", "windows").mapInArrow(run, schema)

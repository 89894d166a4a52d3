"""Remove word passages that a document shares with one of smaller identifier.

Seed and extend. Every window of ``length`` words has one anchor: the word sequence of ``seed``
words in it with the smallest hash, the rightmost of equals. The choice depends on the window's
words alone, so equal windows of different documents have equal anchors at the same place
(winnowing), and a document has an anchor about every five words. Documents are joined on
anchors: a bitmap of bounded size (``bits``) holds those that two documents have, and the others are done with;
one that it lets through by mistake meets nothing. Around the shared anchors, matches are
extended both ways by comparing the hashes of all windows that the anchor belongs to. A
window that also starts in a document of smaller identifier is repeated; overlapping
repeated windows make up the maximal repeats, which are removed.

Documents that share an anchor are never paired. An anchor's contexts come to its task in the order of
identifiers, and each window is looked up among those of smaller ones. The contexts of an anchor that more than ``HOT``
documents have are not brought together: their windows are counted by their own hash, combined before the shuffle.

Defined cases: null, empty and short texts have no window. A document without identifier neither
loses words nor makes others lose any. Rows that repeat an identifier are judged each by
its own text, and not against one another. Empty tables give empty results. Texts are read whole. Hashes
have 64 bits. Other columns than identifier and text are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.llm import bits
from blotter.llm.common import released, staged

LENGTH, SEED = 13, 5
# Contexts of one anchor that a task takes together.
HOT = 20_000
# Words that a task works on at once, and words whose hashes it remembers.
STEP, REMEMBERED = 1 << 18, 300_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_CONTEXTS = "anchor long, doc_id long, tag long, starts array<int>, windows array<long>"
_RANGES = "doc_id long, tag long, range long"
_KEPT = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"


def repeated_spans(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    seed: int = SEED,
    hot: int = HOT,
) -> DataFrame:
    """``(doc_id, tag, ranges)``: per text the places of words at which repeated windows start, as ranges of
    ``start * 2^32 + end``, end exclusive. The tag tells texts of one identifier apart."""
    if not 1 <= seed <= length:
        raise ValueError("a seed is part of a window")
    texts = _texts(docs, id_column, text).filter("doc_id IS NOT NULL")
    about = texts.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    # A word takes six characters or so with its space, and there is an anchor every five words.
    places = bits.words_for(about // 30)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bits.Gathered(places)
        for step in _steps(batches):
            _, anchor, at = step.anchors(length, seed)
            order = np.lexsort((anchor, step.owner[at]))
            owner, anchor = step.owner[at][order], anchor[order]
            fresh = np.append(True, (owner[1:] != owner[:-1]) | (anchor[1:] != anchor[:-1]))
            yield from seen.add(anchor[fresh[: len(anchor)]])
        yield from seen.rows()

    shared = bits.Bitmap(bits.merged(texts.mapInArrow(seeds, bits.ADDRESSES), places), "twice", places)

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in _steps(batches):
            yield _contexts(step, shared, length, seed)

    contexts = staged(texts.mapInArrow(extended, _CONTEXTS), "contexts")
    shared.drop()
    crowded = staged(
        contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot), "hot-anchors"
    )
    usual, late = contexts, None
    if not crowded.isEmpty():
        usual = contexts.join(crowded, "anchor", "left_anti")
        late = _by_window(contexts.join(crowded, "anchor", "left_semi"))
    ranges = (
        usual.repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_judge, _RANGES)
    )
    if late is not None:
        ranges = ranges.unionByName(late)
    found = staged(ranges.groupBy("doc_id", "tag").agg(F.collect_list("range").alias("ranges")), "repeats")
    released(contexts)
    return found


def remove_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    seed: int = SEED,
    hot: int = HOT,
) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept, kept_sha256)`` for every row."""
    spans = repeated_spans(docs, id_column, text, length, seed, hot)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                _keep(body, ranges, length)
                for body, ranges in zip(batch.column(1).cast(pa.binary()).to_pylist(), _lists(batch.column(2)))
            ]
            counts, removed, left = zip(*rows) if rows else ((),) * 3
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(left, pa.binary()).cast(pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    return (
        _texts(docs, id_column, text)
        .join(spans, ["doc_id", "tag"], "left")
        .select("doc_id", "text", F.coalesce("ranges", F.array().cast("array<long>")).alias("ranges"))
        .mapInArrow(kept, _KEPT)
    )


class _Hashes(dict):
    """Hashes of words, found when first asked for."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


class _Step:
    """Some texts one after another: the words' hashes, and which row each word belongs to."""

    def __init__(self, ids: list, tags: list, parts: list[np.ndarray]):
        self.ids, self.tags = np.array(ids, dtype=np.int64), np.array(tags, dtype=np.int64)
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.words = np.concatenate(parts)
        self.first = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(parts)), sizes)

    def anchors(self, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and hash of the anchor of each window within a text, and where the window starts."""
        place, anchor = anchors(self.words, length, seed)
        at = np.flatnonzero(self.owner[: len(place)] == self.owner[length - 1 :])
        return place[at], anchor[at], at


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[_Step]:
    known, rows, size = _Hashes(), ([], [], []), 0
    for batch in batches:
        for doc_id, tag, body in zip(*[batch.column(i) for i in (0, 1)], batch.column(2).cast(pa.binary())):
            words = body.as_py().split()  # of bytes: at the six ASCII white-space characters
            rows[0].append(doc_id.as_py())
            rows[1].append(tag.as_py())
            hashed = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
            rows[2].append(hashed.view(np.int64))
            size += len(words)
            if size >= STEP:
                yield _Step(*rows)
                rows, size = ([], [], []), 0
                if len(known) > REMEMBERED:
                    known = _Hashes()
    if rows[0]:
        yield _Step(*rows)


def anchors(words: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the place and the hash of its anchor."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    hashes = rolling(words, seed)
    place = np.arange(n)
    least = hashes[:n].copy()
    for shift in range(1, length - seed + 1):
        later = hashes[shift : shift + n]
        smaller = later <= least
        place[smaller] = np.flatnonzero(smaller) + shift
        least = np.minimum(least, later)
    return place, least.view(np.int64)


def rolling(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of every ``length`` words in a row."""
    wide = words.view(np.uint64)
    n = len(wide) - length + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(length):
        mixed = (mixed ^ wide[k : k + n]) * _MIX
        mixed ^= mixed >> np.uint64(31)
    return mixed * _MIX


def _texts(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return (
        docs.select(
            F.col(id_column).cast("long").alias("doc_id"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        )
        .withColumn("tag", F.xxhash64("text"))
        .select("doc_id", "tag", "text")
    )


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _list_array(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _gather(firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(firsts - ends + sizes, sizes)


def _contexts(step: _Step, shared: bits.Bitmap, length: int, seed: int) -> pa.RecordBatch:
    """A row for each context of a shared anchor: where it starts, and its windows' hashes.

    A line that a document repeats is one row with many starts. First and last window
    overlap or touch, so these two and their number tell a context from others.
    """
    place, anchor, at = step.anchors(length, seed)
    windows = rolling(step.words, length).view(np.int64)[at] if len(at) else at
    firsts = np.flatnonzero(np.diff(place, prepend=-1))
    sizes = np.diff(np.append(firsts, len(place)))
    wanted = shared.has(anchor[firsts])
    firsts, sizes = firsts[wanted], sizes[wanted]
    owner = step.owner[at[firsts]]
    told = np.stack([owner, windows[firsts], windows[firsts + sizes - 1], sizes])
    order = np.lexsort((firsts, *told[::-1]))
    fresh = np.append(True, (told[:, order[1:]] != told[:, order[:-1]]).any(axis=0))[: len(order)]
    places = (at[firsts] - step.first[owner])[order].astype(np.int32)
    firsts, sizes, owner = (x[order[fresh]] for x in (firsts, sizes, owner))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(anchor[firsts]),
            pa.array(step.ids[owner]),
            pa.array(step.tags[owner]),
            _list_array(np.diff(np.append(np.flatnonzero(fresh), len(order))), places),
            _list_array(sizes, windows[_gather(firsts, sizes)]),
        ],
        names=["anchor", "doc_id", "tag", "starts", "windows"],
    )


def _by_window(contexts: DataFrame) -> DataFrame:
    """Ranges of single windows that a smaller identifier has too, each window by its own hash."""
    each = contexts.select("doc_id", "tag", "starts", F.posexplode("windows").alias("offset", "hash"))
    first = each.groupBy("hash").agg(F.min("doc_id").alias("low"))
    start = F.explode("starts").alias("start")
    repeated = each.join(first, "hash").filter("low < doc_id").select("doc_id", "tag", "offset", start)
    place = (F.col("start") + F.col("offset")).cast("long")
    return repeated.select("doc_id", "tag", (F.shiftleft(place, 32) + place + 1).alias("range"))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts in the order of anchors to ranges of repeated windows; the last anchor waits for the next batch."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        anchor = batch.column(0).to_numpy()
        if not len(anchor):
            continue
        whole = int(np.searchsorted(anchor, anchor[-1]))
        rest = batch.slice(whole)
        if whole:
            yield _repeated(batch.slice(0, whole))
    if rest is not None:
        yield _repeated(rest)


def _repeated(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of whole anchors: the windows that a smaller identifier has too, as ranges in their contexts."""
    anchor, ids, tags = (batch.column(i).to_numpy() for i in range(3))
    starts, windows = batch.column(3), batch.column(4)
    offsets, starts_at = windows.offsets.to_numpy().astype(np.int64), starts.offsets.to_numpy().astype(np.int64)
    hashes, sizes = windows.values.to_numpy()[offsets[0] : offsets[-1]], np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((ids[row], hashes, anchor[row]))
    same = hashes[order]
    fresh = np.append(True, (same[1:] != same[:-1]) | (anchor[row[order[1:]]] != anchor[row[order[:-1]]]))
    fresh = np.flatnonzero(fresh[: len(order)])
    least = np.repeat(ids[row[order[fresh]]], np.diff(np.append(fresh, len(order))))
    found = np.zeros(len(hashes), dtype=bool)
    found[order] = ids[row[order]] > least
    edge = np.append(True, row[1:] != row[:-1])[: len(row)]
    begins = np.flatnonzero(found & (edge | ~np.append(False, found[:-1])))
    last = np.append(edge[1:], True)[: len(row)]
    ends = np.flatnonzero(found & (last | ~np.append(found[1:], False))) + 1
    owner = row[begins]
    begin, end = begins - (offsets[owner] - offsets[0]), ends - (offsets[owner] - offsets[0])
    times = np.diff(starts_at)[owner]
    at = starts.values.to_numpy()[_gather(starts_at[owner], times)].astype(np.int64)
    begin, end = at + np.repeat(begin, times), at + np.repeat(end, times)
    owner = np.repeat(owner, times)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[owner]), pa.array(tags[owner]), pa.array((begin << 32) | end)],
        names=["doc_id", "tag", "range"],
    )


def _keep(body: bytes, ranges: np.ndarray, length: int) -> tuple[int, int, bytes]:
    words = body.split()
    kept = words
    if len(ranges):
        change = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(change, ranges >> 32, 1)
        np.add.at(change, (ranges & 0xFFFFFFFF) + length - 1, -1)
        kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return len(words), len(words) - len(kept), b" ".join(kept)

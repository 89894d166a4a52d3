"""Find benchmark passages in documents by the q-gram lemma.

Texts are compared as lower-case letters and digits with one space between words. A passage of
``window`` characters that a document holds with at most ``edits`` insertions, deletions or
substitutions shares at least ``window - q + 1 - q * edits`` q-grams with it (each edit spoils at most
q of them), and these lie on neighbouring diagonals: document place less passage place. So shared
q-grams are counted in bands of diagonals, each overlapping the next by half and so wide that some band holds
every such match. Where a band has enough within a window, an alignment limited to the band
verifies it. Nothing within the edit budget is missed.

The benchmark's q-grams are broadcast, in blocks of at most ``BLOCK`` characters. Each block is a pass of its
own: it is read, broadcast, applied, its result written, and it is released before the next one comes. A document is read by
one task and nothing is shuffled.

Repetitive text costs no more than other text. Of equal windows of an item the first stands for all, and only its
q-grams are indexed; a document is taken in pieces of ``PIECE`` characters that overlap by two windows, and equal pieces
are looked at once.

Defined cases: null and empty texts match nothing, nor do items of fewer than q normal
characters. An item shorter than a window is compared whole with edits in proportion. Repeated
items and documents are each reported; ties have no order, as every item counts for itself. Empty tables give empty
results. Texts are read whole whatever their length. Other columns than identifiers and texts are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import staged

Q, WINDOW, EDITS = 10, 60, 4
BLOCK = 20_000_000
PIECE = 1 << 12

_FOUND = pa.list_(
    pa.struct(
        [
            ("item_id", pa.int64()),
            ("start", pa.int64()),
            ("end", pa.int64()),
            ("windows", pa.int64()),
            ("edits", pa.int64()),
        ]
    )
)
FOUND_TYPE = "array<struct<item_id:bigint,start:bigint,end:bigint,windows:bigint,edits:bigint>>"
_GAPS = re.compile(r"[\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


def normal(text: str | None) -> str:
    return _GAPS.sub(" ", (text or "").lower()).strip()


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """``(doc_id, item_id, start, end, windows, edits)``: each document and item that share a
    passage, where in the normal text, in how many different windows, and the fewest edits of one."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = None
    for find, release, more in leak_columns(benchmark, item_id, item_text, block):
        own = rows.select("doc_id", F.inline(find(F.col("text"))))
        if more or found is not None:
            own = staged(own, "leaks")
            release()
        found = own if found is None else found.unionByName(own)
    return found


def remove_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", block: int = BLOCK
) -> DataFrame:
    """Documents that share no passage with any item, all columns as they are."""
    passes = 0
    for find, release, more in leak_columns(benchmark, block=block):
        docs, passes = docs.filter(F.size(find(F.col(f"`{text}`").cast("string"))) == 0), passes + 1
        if more or passes > 1:
            docs = staged(docs, "unleaked")
            release()
    return docs


def leak_columns(
    benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", block: int = BLOCK
) -> Iterator[tuple]:
    """For each block of the benchmark a column function that finds leaks, what releases it, and whether
    another block follows. A block is collected when its turn comes."""
    items = benchmark.select(
        F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")
    ).filter("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block))
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        yield *_leak_column(benchmark, items.filter(of == b).collect()), b + 1 < blocks


def _leak_column(benchmark: DataFrame, rows) -> tuple:
    ordered = sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
    index = Index.build([r["item_id"] for r in ordered], [r["text"] for r in ordered])
    shared = benchmark.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf(FOUND_TYPE)
    def leaks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shared.value.leaks(t) for t in batch.to_pylist()], type=_FOUND)

    return leaks, shared.unpersist


@dataclass
class Index:
    """q-grams of all items: sorted hashes, and for each the items and places that have it."""

    ids: list
    codes: list[np.ndarray]
    lengths: np.ndarray
    firsts: list[np.ndarray]
    widths: np.ndarray
    budgets: np.ndarray
    needed: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray

    @staticmethod
    def build(ids: list, texts: list[str]) -> Index:
        codes = [_codes(normal(t)) for t in texts]
        keep = [i for i, c in enumerate(codes) if len(c) >= Q]
        ids, codes = [ids[i] for i in keep], [codes[i] for i in keep]
        widths = np.array([min(WINDOW, len(c)) for c in codes], dtype=np.int64)
        budgets = np.minimum(widths * EDITS // WINDOW, (widths - Q) // Q)
        needed = widths - Q + 1 - Q * budgets
        lengths = np.array([len(c) for c in codes], dtype=np.int64)
        firsts = [_first_windows(c, int(w)) for c, w in zip(codes, widths)]
        places = [_covered(f, int(w) - Q + 1) for f, w in zip(firsts, widths)]
        grams = [_grams(c)[p] for c, p in zip(codes, places)]
        empty = np.zeros(0, dtype=np.int64)
        every = np.concatenate([np.zeros(0, dtype=np.uint64), *grams])
        item = np.concatenate([empty, *[np.full(len(g), i) for i, g in enumerate(grams)]])
        place = np.concatenate([empty, *places])
        order = np.argsort(every, kind="stable")
        hashes, first = np.unique(every[order], return_index=True)
        seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
        seen[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        first = np.append(first, len(every))
        return Index(
            ids, codes, lengths, firsts, widths, budgets, needed, hashes, first, item[order], place[order], seen
        )

    def leaks(self, text: str | None) -> list[dict]:
        codes = _codes(normal(text))
        found: dict[int, list] = {}
        known: dict[bytes, list] = {}
        step = PIECE - 2 * WINDOW
        for at in range(0, max(1, len(codes) - 2 * WINDOW), step):
            piece = codes[at : at + PIECE]
            same = piece.tobytes() if len(codes) > PIECE else b""
            if same not in known:
                known[same] = list(self._piece(piece))
            for item, start, end, windows, edits in known[same]:
                old = found.setdefault(item, [at + start, at + end, set(), edits])
                old[0], old[1], old[3] = min(old[0], at + start), max(old[1], at + end), min(old[3], edits)
                old[2].update(windows)
        return [
            {"item_id": self.ids[i], "start": s, "end": e, "windows": len(w), "edits": d}
            for i, (s, e, w, d) in sorted(found.items())
        ]

    def _piece(self, codes: np.ndarray):
        """Verified windows of one piece, summed up by item."""
        item, place, at = self._hits(codes)
        if not len(item):
            return
        regions = self._regions(item, place, at - place)
        for i in np.unique([r[0] for r in regions]).astype(int).tolist():
            own = np.array([(s, low) for item, s, low in regions if item == i])
            edits = self._align(codes, i, own)
            good = edits <= self.budgets[i]
            if good.any():
                begins, width = own[good].sum(axis=1), int(self.widths[i])
                start = max(0, int(begins.min()))
                end = min(len(codes), int(begins.max()) + width + int(self.budgets[i]))
                yield i, start, end, np.unique(own[good, 0]).tolist(), int(edits[good].min())

    def _hits(self, codes: np.ndarray):
        """Item, item place and document place of every q-gram that the document shares."""
        none = (np.zeros(0, dtype=np.int64),) * 3
        if len(codes) < Q or not len(self.hashes):
            return none
        grams = _grams(codes)
        at = np.flatnonzero(self.seen[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        rank = np.searchsorted(self.hashes, grams[at])
        rank[rank == len(self.hashes)] = 0
        same = self.hashes[rank] == grams[at]
        at, rank = at[same], rank[same]
        counts = self.first[rank + 1] - self.first[rank]
        place = np.repeat(self.first[rank] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return self.item[place], self.place[place], np.repeat(at, counts)

    def _regions(self, item: np.ndarray, place: np.ndarray, diagonal: np.ndarray):
        """Windows of items with enough shared q-grams in a band: item, place, lowest diagonal.

        Bands are twice the budget wide and start every budget + 1 diagonals, so each
        set of diagonals no further apart than the budget lies within one.
        """
        stride = self.budgets[item] + 1
        band = diagonal // stride
        item = np.concatenate([item, item])
        place = np.concatenate([place, place])
        band = np.concatenate([band, band - 1])
        order = np.lexsort((place, band, item))
        item, place, band = item[order], place[order], band[order]
        fresh = np.ones(len(item), dtype=bool)
        fresh[1:] = (item[1:] != item[:-1]) | (band[1:] != band[:-1]) | (place[1:] != place[:-1])
        item, place, band = item[fresh], place[fresh], band[fresh]
        last = np.arange(len(item)) + self.needed[item] - 1
        inside = last < len(item)
        k, last = np.flatnonzero(inside), last[inside]
        enough = (
            (item[last] == item[k])
            & (band[last] == band[k])
            & (place[last] - place[k] <= self.widths[item[k]] - Q)
        )
        k, last = k[enough], last[enough]
        # These q-grams lie in every window from the first that ends with them on.
        low = np.maximum(0, place[last] + Q - self.widths[item[k]])
        high = np.minimum(place[k], (self.lengths - self.widths)[item[k]])
        regions = []
        groups = np.flatnonzero(np.append(True, (item[k][1:] != item[k][:-1]) | (band[k][1:] != band[k][:-1])))
        for start, end in zip(groups.tolist(), [*groups[1:].tolist(), len(k)]) if len(k) else ():
            i = int(item[k[start]])
            change = np.zeros(self.lengths[i] + 2, dtype=np.int64)
            np.add.at(change, low[start:end], 1)
            np.add.at(change, high[start:end] + 1, -1)
            lowest = int(band[k[start]]) * (int(self.budgets[i]) + 1)
            supported = self.firsts[i][np.cumsum(change)[self.firsts[i]] > 0]
            regions += [(i, s, lowest) for s in supported.tolist()]
        return regions

    def _align(self, codes: np.ndarray, i: int, regions: np.ndarray) -> np.ndarray:
        """Fewest edits that turn each item window into some stretch of the document.

        Row by row over the window, all windows at once. Only diagonals of the band, and as
        many to either side as the budget lets an alignment stray, are kept.
        """
        width, budget = int(self.widths[i]), int(self.budgets[i])
        reach = 2 * (budget + 1) + 2 * budget
        starts, low = regions[:, 0], regions[:, 1]
        begin = starts + low - budget
        padded = np.concatenate(
            [np.zeros(reach + 1, dtype=codes.dtype), codes, np.zeros(width + 2 * reach + 2, dtype=codes.dtype)]
        )
        window = self.codes[i][starts[:, None] + np.arange(width)]
        far = np.int64(1 << 20)
        row = np.zeros((len(starts), reach + 1), dtype=np.int64)
        columns = np.arange(reach + 1)
        for r in range(width):
            place = np.clip(begin[:, None] + r + columns + reach + 1, 0, len(padded) - 1)
            differs = padded[place] != window[:, r, None]
            above = np.concatenate([row[:, 1:], np.full((len(starts), 1), far)], axis=1) + 1
            row = np.minimum(row + differs, above)
            # Skipped document characters: running minimum of what stands to the left.
            row = np.minimum.accumulate(row - columns, axis=1) + columns
        return row.min(axis=1)


def _first_windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Where the different windows of an item start first, in order."""
    n = len(codes) - width + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        mixed = mixed * _MIX + codes[k : k + n]
    return np.sort(np.unique(mixed, return_index=True)[1])


def _covered(starts: np.ndarray, length: int) -> np.ndarray:
    """All places of stretches of a length."""
    change = np.zeros(int(starts.max()) + length + 1, dtype=np.int64)
    change[starts] += 1
    change[starts + length] -= 1
    return np.flatnonzero(np.cumsum(change) > 0)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(codes: np.ndarray) -> np.ndarray:
    """A hash of every q characters in a row."""
    wide = codes.astype(np.uint64)
    n = len(wide) - Q + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(Q):
        mixed = mixed * _MIX + wide[k : k + n]
    return (mixed ^ (mixed >> np.uint64(29))) * _MIX

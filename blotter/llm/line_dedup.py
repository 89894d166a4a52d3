"""Remove lines that many documents repeat.

A first pass hashes every line and keeps the hashes in two Bloom filters: one of hashes seen
once, one of hashes seen again (``bits``). A line whose hash is not in the second is in one document
only. A second pass tests all lines against the second filter; only the suspected ones are
shuffled, as text, counted before the shuffle, and so confirmed exactly: how many documents
have the line, and where it occurs first. A false positive costs a shuffled line and changes no result.
Lines themselves are told apart by their key: the line without white space at its ends, A-Z lower-cased.

If the confirmed keys are at most ``HELD`` bytes they are broadcast and documents are rewritten where they
are read. Beyond that the lines meet them in a join, and documents are shuffled once.

Defined cases: a null or empty text is one empty line, whose key is too short to be dropped unless
``min_chars`` is 0. Every row is a document of its own, also where rows repeat an identifier or lack
one; a line that a document repeats counts once. With ``keep_first`` the first occurrence stays: that of the
smallest identifier (null last), then text hash, then place in the text; rows equal in identifier and text are alike. Empty
tables give empty results. Texts and lines are read whole whatever their length. Other columns than identifier and text
are never read.
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
from blotter.llm.common import staged

MIN_DOCUMENTS, MIN_CHARS = 10, 1
# Bytes of confirmed keys that are broadcast at most, with so many for each key's entry.
HELD, ENTRY = 32_000_000, 150

_WHITE = b" \t\n\x0b\x0c\r"
_KEPT = "doc_id long, n_lines long, n_dropped long, kept string, kept_sha256 string"
_SUSPECT = "doc_id long, tag long, key binary, place int"


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line; ``lower`` of bytes changes A-Z alone."""
    return [line.strip(_WHITE) for line in text.lower().split(b"\n")]


def repeated_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    min_documents: int = MIN_DOCUMENTS,
    min_chars: int = MIN_CHARS,
    most_bits: int = bits.MOST_BITS,
) -> DataFrame:
    """``(key, documents, first)`` of every line that so many documents have; ``first`` is the
    identifier (with a flag for null before it), text hash and place of its first occurrence."""
    if min_documents < 2:
        raise ValueError("a repeated line is one of two documents at least")
    texts = _texts(docs, id_column, text)
    lines = texts.agg(
        F.sum(F.length("text") - F.length(F.translate("text", "\n", "")) + 1).alias("n")
    ).first()["n"]
    words = bits.words_for(lines or 0, most_bits)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bits.Gathered(words)
        for batch in batches:
            found = [
                xxhash.xxh64_intdigest(key)
                for body in _bodies(batch.column(0))
                for key in set(line_keys(body))
                if _long_enough(key, min_chars)
            ]
            yield from seen.add(np.array(found, dtype=np.uint64).view(np.int64))
        yield from seen.rows()

    again = bits.Bitmap(
        bits.merged(texts.select("text").mapInArrow(hashes, bits.ADDRESSES), words), "twice", words
    )

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, keys = [], [], []
            for row, body in enumerate(_bodies(batch.column(2))):
                first = {}
                for place, key in enumerate(line_keys(body)):
                    if key not in first and _long_enough(key, min_chars):
                        first[key] = place
                keys += first
                places += first.values()
                rows += [row] * len(first)
            found = np.array([xxhash.xxh64_intdigest(key) for key in keys], dtype=np.uint64)
            wanted = np.flatnonzero(again.has(found.view(np.int64)))
            rows = pa.array(np.array(rows, dtype=np.int64)[wanted])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array([keys[i] for i in wanted.tolist()], pa.binary()),
                    pa.array(np.array(places, dtype=np.int32)[wanted]),
                ],
                names=["doc_id", "tag", "key", "place"],
            )

    found = (
        texts.mapInArrow(suspects, _SUSPECT)
        .groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("documents"),
            F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tag", "place")).alias(
                "first"
            ),
        )
        .filter(F.col("documents") >= min_documents)
    )
    confirmed = staged(found, "lines")
    again.drop()
    return confirmed


def remove_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    min_documents: int = MIN_DOCUMENTS,
    min_chars: int = MIN_CHARS,
    keep_first: bool = False,
    held: int = HELD,
    most_bits: int = bits.MOST_BITS,
) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept, kept_sha256)`` for every row."""
    repeated = repeated_lines(docs, id_column, text, min_documents, min_chars, most_bits)
    texts = _texts(docs, id_column, text)
    size = repeated.agg(F.sum(F.length("key") + ENTRY).alias("n")).first()["n"] or 0
    if size <= held:
        known = {bytes(row["key"]): tuple(row["first"]) for row in repeated.collect()}
        shared = texts.sparkSession.sparkContext.broadcast(known)

        def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                bodies = _bodies(batch.column(2))
                gone = (
                    _places(i, t, line_keys(b), shared.value, keep_first)
                    for i, t, b in zip(ids, tags, bodies)
                )
                yield _kept(ids, bodies, gone)

        return texts.mapInArrow(rewrite, _KEPT)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [line_keys(body) for body in _bodies(batch.column(2))]
            counts = [len(k) for k in keys]
            rows = pa.array(np.repeat(np.arange(len(keys)), counts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array([key for k in keys for key in k], pa.binary()),
                    pa.array(np.concatenate([np.zeros(0, int), *map(np.arange, counts)]).astype(np.int32)),
                ],
                names=["doc_id", "tag", "key", "place"],
            )

    # Rows equal in identifier and text lose the same lines, so one of them stands for all.
    occurs = texts.dropDuplicates(["doc_id", "tag"]).mapInArrow(lines, _SUSPECT)
    here = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tag", "place")
    dropped = (
        occurs.join(repeated, "key")
        .filter(F.lit(not keep_first) | ~here.eqNullSafe(F.col("first")))
        .groupBy("doc_id", "tag")
        .agg(F.collect_list("place").alias("places"))
    )
    left, right = texts.alias("a"), dropped.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.tag") == F.col("b.tag"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = (set(places or ()) for places in batch.column(2).to_pylist())
            yield _kept(batch.column(0).to_pylist(), _bodies(batch.column(1)), gone)

    return left.join(right, same, "left").select("a.doc_id", "a.text", "b.places").mapInArrow(apply, _KEPT)


def _texts(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).select("doc_id", F.xxhash64("text").alias("tag"), "text")


def _bodies(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _long_enough(key: bytes, min_chars: int) -> bool:
    """Whether a key has so many code points; none takes more than four bytes."""
    return len(key) >= 4 * min_chars or (
        len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars
    )


def _places(doc_id, tag, keys: list[bytes], known: dict, keep_first: bool) -> set[int]:
    found = {i for i, key in enumerate(keys) if key in known}
    if keep_first:
        found = {i for i in found if known[keys[i]] != (doc_id is None, doc_id, tag, i)}
    return found


def _kept(ids: list, bodies: list[bytes], gone: Iterator[set[int]]) -> pa.RecordBatch:
    lines, dropped, kept = [], [], []
    for body, places in zip(bodies, gone):
        parts = body.split(b"\n")
        lines.append(len(parts))
        dropped.append(len(places))
        kept.append(
            b"\n".join([p for i, p in enumerate(parts) if i not in places]) if places else body
        )
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array(lines, pa.int64()),
            pa.array(dropped, pa.int64()),
            pa.array(kept, pa.binary()).cast(pa.string()),
            pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
        ],
        names=["doc_id", "n_lines", "n_dropped", "kept", "kept_sha256"],
    )

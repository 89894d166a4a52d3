"""Near duplicates by SimHash fingerprints, found through Golay-code fuzzy hashing.

A document's fingerprint has a bit set where over half of its shingles' hashes have it
set. Equal fingerprints are one class, which its smallest document stands for. Classes whose
fingerprints differ in few bits are linked, and linked classes are one component.

Candidates: a fingerprint is cut into three segments of at most 23 bits. The binary
Golay code is perfect, so every 23-bit word decodes to exactly one codeword, within three
bits. All words within one bit of a segment decode to one to six codewords; two segments
that differ in at most one bit share a codeword in the sense that the one's decoding is
among the other's. Of at most three differing bits, by the pigeonhole principle, either a
segment has none and another at most one, or each segment has exactly one. So keys are

* a segment itself with each codeword index near another segment (six ordered pairs), and
* a codeword index of each of the three: all near ones of two segments with the third's own,
  and the other two's own with all near ones of the third.

No pair within three bits is missed, and a key has 33 bits and more, so few keys meet by
chance. What meets is verified on the whole fingerprint.

A key's fingerprints are linked into a spanning forest rather than into all pairs. Keys that
hold more than ``GROUP`` fingerprints are set aside and dealt into blocks; block pairs are then
tasks of their own. So neither memory nor emitted rows grow with the square of a group.

Defined cases: documents with fewer words than a shingle are one shingle of all their words;
null and blank texts have fingerprint zero and are linked like others. Documents without
an identifier are fingerprinted, but link nothing and have no component. Repeated rows share
everything; different texts of one identifier are documents of their own. Ties have no order, since components are sets. Other columns than identifier and
text are not read and may have any names. Empty tables give empty results. Texts are read whole, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blotter.llm.common import NOT_WHITE, lower_ascii, staged
from blotter.llm.components import connected_components

SHINGLE = 3
DISTANCE = 3
SEED = 42

# The generator polynomial of the binary Golay code of length 23, and the
# three segments of a fingerprint as (lowest bit, bits).
GOLAY_GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_CHECK_BITS, _LENGTH = 11, 23

# Fingerprints of one key that a task links directly, and of one block of a larger key.
GROUP = 2048


def fingerprints(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
) -> DataFrame:
    """``(doc_id, tag, bits)`` for every row, in one pass without a shuffle. The tag tells apart texts
    that share an identifier."""
    words = F.regexp_extract_all(
        lower_ascii(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(NOT_WHITE), F.lit(0)
    )
    lowered = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text).cast("string")).alias("tag"),
        F.array_join(words, " ").alias("words"),
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [fingerprint(t.split(" ") if t else [], shingle) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(np.array(bits, dtype=np.uint64).view(np.int64))],
                names=["doc_id", "tag", "bits"],
            )

    return lowered.mapInArrow(each, "doc_id long, tag long, bits long")


def fingerprint(words: list[str], shingle: int = SHINGLE) -> int:
    """A bit is set if over half of the shingles' hashes have it set."""
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = (" ".join(words[i : i + size]) for i in range(len(words) - size + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(s, SEED) for s in joined), dtype=np.uint64, count=len(words) - size + 1
    )
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def near_duplicates(
    prints: DataFrame, distance: int = DISTANCE, group: int = GROUP
) -> DataFrame:
    """``(doc_id, tag, bits, component_id, first_tag)`` for each of the ``(doc_id, tag, bits)`` rows.

    The component is the smallest identifier that links reach, the document's own included; ``first_tag`` is the
    tag of the text that has it, the smallest if several have.
    Classes are linked by their fingerprints, so different texts of one identifier are told apart.
    """
    if not 0 <= distance <= 3:
        raise ValueError("three segments and one-bit balls cover at most three bits")
    prints = staged(prints, "fingerprints")
    classes = staged(
        prints.filter("doc_id IS NOT NULL")
        .groupBy("bits")
        .agg(F.min("doc_id").alias("first"), F.min_by("tag", F.struct("doc_id", "tag")).alias("first_tag")),
        "classes",
    )
    components = connected_components(_links(classes.select("bits"), distance, group))
    named = classes.join(components, F.col("bits") == F.col("node"), "left").select(
        "bits", F.coalesce("component", "bits").alias("group"), "first", "first_tag"
    )
    least = named.groupBy("group").agg(F.min(F.struct("first", "first_tag")).alias("least"))
    found = named.join(least, "group").select(
        "bits", F.col("least.first").alias("component_id"), F.col("least.first_tag").alias("first_tag")
    )
    known = F.col("doc_id").isNotNull()
    return prints.join(found, "bits", "left").select(
        "doc_id",
        "tag",
        "bits",
        F.when(known, F.col("component_id")).alias("component_id"),
        F.when(known, F.col("first_tag")).alias("first_tag"),
    )


def keep_first(
    docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row of each component, the one its smallest identifier names, with all columns.

    Of rows equal in identifier and text one stays; rows without an identifier are no duplicates and stay. Different
    texts of one identifier are different documents.
    """
    first = found.filter("doc_id = component_id AND tag = first_tag").select("doc_id", "tag").distinct()
    taken = {c.lower() for c in docs.columns}
    tag, place = (next(n for n in (f"{'_' * i}{name}" for i in range(1, 99)) if n not in taken) for name in ("tag", "place"))
    of_one = Window.partitionBy(id_column, tag).orderBy(F.lit(0))
    named = (
        docs.withColumn(tag, F.xxhash64(F.col(text).cast("string")))
        .join(
            first.withColumnsRenamed({"doc_id": id_column, "tag": tag}), [id_column, tag], "left_semi"
        )
        .withColumn(place, F.row_number().over(of_one))
        .filter(F.col(place) == 1)
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
    return named.unionByName(docs.filter(F.col(id_column).isNull()))


def _links(classes: DataFrame, distance: int, group: int) -> DataFrame:
    """``(a, b)`` edges between fingerprints that span every component."""

    def keyed(batches):
        for batch in batches:
            rows, keys = golay_keys(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), batch.column(0).take(pa.array(rows))], names=["key", "bits"]
            )

    keys = classes.mapInArrow(keyed, "key long, bits long")
    met = staged(
        keys.repartition("key").sortWithinPartitions("key").mapInArrow(
            lambda batches: _link_groups(batches, distance, group), "key long, a long, b long"
        ),
        "met",
    )
    # A row without b is a member of a key too large for one task.
    aside = met.filter("b IS NULL").select("key", F.col("a").alias("bits"))
    edges = met.filter("b IS NOT NULL").select("a", "b")
    return edges.unionByName(_link_blocks(aside, distance, group))


def _link_blocks(aside: DataFrame, distance: int, group: int) -> DataFrame:
    """Links of keys with many members, block pair by block pair."""
    sizes = aside.groupBy("key").agg(F.ceil(F.count("*") / group).cast("int").alias("blocks"))
    members = (
        aside.join(sizes, "key")
        .withColumn("own", F.pmod(F.xxhash64("bits"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select(
            F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "bits"
        )
    )
    return (
        members.repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(
            lambda batches: _link_groups(batches, distance, None), "key long, a long, b long"
        )
        .select("a", "b")
    )


def _link_groups(batches, distance: int, group: int | None):
    """Rows sorted by key to spanning edges; members of keys over ``group`` pass through."""
    held_key, held, over = None, [], False

    def close():
        if held_key is None or over:
            return None
        edges = spanning_edges(np.concatenate(held), distance)
        return _edge_batch(held_key, *edges) if len(edges[0]) else None

    for batch in batches:
        key, bits = (batch.column(i).to_numpy() for i in range(2))
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        if not len(key):
            continue
        # Keys that lie within the batch and hold a single row need no further look.
        busy = (ends - starts > 1) | (np.arange(len(starts)) == len(starts) - 1)
        busy[0] = True
        for at in np.flatnonzero(busy).tolist():
            s, e = starts[at], ends[at]
            if key[s] != held_key:
                done = close()
                if done is not None:
                    yield done
                held_key, held, over = key[s], [], False
            held.append(bits[s:e])
            if group is not None and (over or sum(map(len, held)) > group):
                over, passed = True, np.concatenate(held)
                held = []
                yield _edge_batch(held_key, passed, None)
    done = close()
    if done is not None:
        yield done


def _edge_batch(key, a, b) -> pa.RecordBatch:
    b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(a), key, dtype=np.int64)), pa.array(a), b], names=["key", "a", "b"]
    )


def spanning_edges(bits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph that links fingerprints within ``distance`` bits."""
    bits = np.unique(bits)
    wide, left = bits.view(np.uint64), np.arange(len(bits))
    a, b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            near = np.bitwise_count(wide[left] ^ wide[node]) <= distance
            if near.any():
                found = left[near]
                queue.extend(found.tolist())
                left = left[~near]
                a.append(np.full(len(found), bits[node]))
                b.append(bits[found])
    empty = np.empty(0, dtype=np.int64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def golay_keys(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of fingerprints; a row has about 60 keys."""
    decoded = golay_decoder()
    parts = [
        ((bits >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS
    ]
    own = [decoded[p].astype(np.int64) for p in parts]
    near = [_near_indices(p, decoded) for p in parts]
    rows, keys, kind = [], [], 0
    for exact in range(3):
        for fuzzy in range(3):
            if exact != fuzzy:
                row, index = near[fuzzy]
                rows.append(row)
                keys.append((kind << 40) | (parts[exact][row] << 12) | index)
                kind += 1
    (row0, index0), (row1, index1), (row2, index2) = near
    # All pairs of near indices of segments 0 and 1, row by row.
    count1 = np.bincount(row1, minlength=len(bits))
    start1 = np.cumsum(count1) - count1
    times = count1[row0]
    row = np.repeat(row0, times)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    pair = index1[start1[row] + inner]
    rows.append(row)
    keys.append((kind << 40) | (np.repeat(index0, times) << 24) | (pair << 12) | own[2][row])
    rows.append(row2)
    keys.append((kind << 40) | (own[0][row2] << 24) | (own[1][row2] << 12) | index2)
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    fresh = np.ones(len(rows), dtype=bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    return rows[fresh], keys[fresh]


def _near_indices(words: np.ndarray, decoded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of all words within one bit: rows, and one to six indices a row."""
    flips = np.concatenate([[0], 1 << np.arange(_LENGTH)])
    indices = np.sort(decoded[words[:, None] ^ flips[None, :]], axis=1)
    fresh = np.ones(indices.shape, dtype=bool)
    fresh[:, 1:] = indices[:, 1:] != indices[:, :-1]
    return np.nonzero(fresh)[0], indices[fresh].astype(np.int64)


@lru_cache(maxsize=1)
def golay_decoder() -> np.ndarray:
    """For each 23-bit word the index (the upper 12 bits) of the codeword nearest to it."""
    flips = [0]
    places = range(_LENGTH)
    flips += [1 << i for i in places]
    flips += [1 << i | 1 << j for i in places for j in range(i)]
    flips += [1 << i | 1 << j | 1 << k for i in places for j in range(i) for k in range(j)]
    errors = np.array(flips, dtype=np.int64)
    by_syndrome = np.zeros(1 << _CHECK_BITS, dtype=np.int64)
    by_syndrome[_syndromes(errors)] = errors
    words = np.arange(1 << _LENGTH, dtype=np.int64)
    return ((words ^ by_syndrome[_syndromes(words)]) >> _CHECK_BITS).astype(np.int16)


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders after division by the generator polynomial."""
    rest = words.copy()
    for place in range(_LENGTH - 1, _CHECK_BITS - 1, -1):
        set_ = (rest >> place) & 1
        rest ^= set_ * (GOLAY_GENERATOR << (place - _CHECK_BITS))
    return rest

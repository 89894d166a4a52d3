"""Collocations: phrases that occur often, scored by how tightly their parts hold together.

Set-oriented mining (SETM). The relation of word occurrences, in order of piece and
position, is written once: words as 64-bit identifiers, 0 after each piece, in rows of some pieces
each, so that a batch of rows is small whatever the documents' lengths. For each length from 1 on, the occurrences of phrases are counted by groups, and the groups that
reach the threshold are kept. The relation is then semi-joined with the frequent groups, each
occurrence is merge-joined with the one at the next position of its piece (two neighbouring frequent
phrases of k words that overlap make one of k + 1), and the shorter relation that is left is written
for the next length. As both sides lie in the same order, the merge is one step through each
task's arrays and moves nothing. The semi-join tests a bitmap of bounded size (``bits``): what it
lets through by mistake is counted exactly and then misses the threshold, so it changes no result.

Identifiers are hashes of language and word under a seed that is proven to tell all words
of the corpus apart; if two collide, the next seed is taken. Phrases are grouped by the
identifiers of all their words. Counts are combined before each shuffle, so the commonest word or
phrase arrives as one row a task. Scores use exact decimals.

Defined cases: null texts are empty, a null language is ``und``. Empty and blank texts and pieces have no
words. Texts, pieces and words are read whole whatever their length. Every row counts, also where rows
repeat; identifiers are never read, nor other columns than language and text. Ties rank by
count, then phrase. Empty tables, and languages without candidates, give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blotter.llm import bits
from blotter.llm.common import released, staged

LONGEST, LEAST, TOP = 4, 30, 2000
# Score scale, and the share of occurrences inside a longer phrase that drops one.
SCALE, INSIDE = 2_000_000, 80

# Parts of a language that are ranked by themselves first.
PARTS = 64
# Words in a row of the relations (Spark's readers and Arrow hold thousands of rows at once), words that a
# task works on at once, and distinct words that it holds.
ROW, STEP, HELD = 128, 1 << 18, 200_000
# Identifiers repeat, so a file's dictionary may hold up to a million of them.
_DICTIONARY = {"parquet.dictionary.page.size": str(8 << 20)}

_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\n" * 10)
_END = b"."  # no word holds one
_FIRST = "run array<long>, lang string, word string, id long, n long"
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def collocations(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    longest: int = LONGEST,
    least: int = LEAST,
    top: int = TOP,
    most_bits: int = bits.MOST_BITS,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``, the best ``top`` of every language."""
    if longest < 2 or least < 1:
        raise ValueError("a phrase has two words at least and occurs")
    relation, words = _occurrences(docs, lang, text)
    before = relation
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    frequent = {1: words.filter(F.col("a") >= least)}
    for length in range(1, longest):
        relation = _extended(relation, frequent[length], length, most_bits)
        released(before)
        before = relation
        counted = _counts(relation, length + 1).filter(F.col("a") >= least)
        frequent[length + 1] = staged(_scored(counted, frequent, length + 1), f"phrases{length + 1}")
    released(relation)
    kept = [_without_parts(frequent, m, longest) for m in range(2, longest + 1)]
    order = (F.desc("score"), F.desc("a"), "phrase")
    best = Window.partitionBy("lang").orderBy(*order)
    # First within parts of a language, so that the last step sees a bounded number of rows of each.
    some = Window.partitionBy("lang", "part").orderBy(*order)
    parted = reduce(DataFrame.unionByName, kept).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    return (
        parted.withColumn("place", F.row_number().over(some))
        .filter(F.col("place") <= top)
        .withColumn("rank", F.row_number().over(best).cast("long"))
        .filter(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )


def tokens(body: bytes) -> list[bytes]:
    """The words of a text in order, with ``_END`` after each piece; ``lower`` of bytes changes A-Z alone."""
    return body.lower().translate(_PIECES).replace(b"\n", b" . ").split()


def _occurrences(docs: DataFrame, lang: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The relation of all occurrences, and the words with their identifiers and counts."""
    texts = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    seed = 0
    while True:

        def read(batches: Iterator[pa.RecordBatch], seed=seed) -> Iterator[pa.RecordBatch]:
            known: dict[str, _Words] = {}
            runs, size = [], 0
            for batch in batches:
                for name, body in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                    name = name.as_py()
                    if name not in known:
                        known[name] = _Words(name, seed)
                    runs.append(known[name].read(body.as_py()))
                    size += len(runs[-1])
                    if size >= STEP:
                        yield _first_rows(runs=_cut(np.concatenate(runs)))
                        runs, size = [], 0
                        if sum(len(w.counts) for w in known.values()) > HELD:
                            yield from _word_rows(known)
                            known = {}
            if runs:
                yield _first_rows(runs=_cut(np.concatenate(runs)))
            yield from _word_rows(known)

        both = staged(texts.mapInArrow(read, _FIRST), "occurrences", **_DICTIONARY)
        words = staged(
            both.filter("word IS NOT NULL")
            .groupBy("id", "lang", "word")
            .agg(F.sum("n").alias("a"))
            .select(F.col("id").alias("w1"), "lang", F.col("word").alias("phrase"), "a"),
            "words",
        )
        if words.groupBy("w1").count().filter("count > 1").isEmpty():
            relation = both.filter("run IS NOT NULL").select("run")
            relation.staged_in = both.staged_in
            return relation, words
        seed += 1
        released(both)


class _Words(dict):
    """Identifiers of a language's words, found when first asked for, and how often they occur."""

    def __init__(self, lang: str, seed: int):
        name = lang.encode()
        self.lang, self.seed, self.prefix = lang, seed, b"%d:%s" % (len(name), name)
        self[_END] = 0
        self.counts = Counter()

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(self.prefix + word, self.seed) or 1
        self[word] = found
        return found

    def read(self, body: bytes) -> np.ndarray:
        found = tokens(body)
        found.append(_END)
        self.counts.update(found)
        return np.fromiter(map(self.__getitem__, found), dtype=np.uint64, count=len(found)).view(np.int64)


def _first_rows(runs=(), lang=(), word=(), id=(), n=()) -> pa.RecordBatch:
    size = max(len(runs), len(lang))
    blank = lambda kind: pa.nulls(size, kind)
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            _lists(runs) if runs else blank(pa.list_(pa.int64())),
            *[pa.array(x, kind) if len(lang) else blank(kind) for x, kind in zip((lang, word, id, n), kinds)],
        ],
        names=["run", "lang", "word", "id", "n"],
    )


def _word_rows(known: dict[str, _Words]) -> Iterator[pa.RecordBatch]:
    for name, words in known.items():
        words.counts.pop(_END, None)
        if words.counts:
            listed = list(words.counts)
            ids = np.fromiter(map(words.__getitem__, listed), dtype=np.uint64, count=len(listed))
            yield _first_rows(
                lang=[name] * len(listed),
                word=pa.array(listed, pa.binary()).cast(pa.string()),
                id=ids.view(np.int64),
                n=list(words.counts.values()),
            )


def _extended(relation: DataFrame, frequent: DataFrame, length: int, most_bits: int) -> DataFrame:
    """The relation of phrases one word longer whose two parts of ``length`` words are frequent."""
    names = [f"w{i}" for i in range(1, length + 1)]
    size = frequent.count()
    known = bits.bitmap_of(frequent.select(*names), size, phrase_hash, most_bits)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _steps(batches):
            here = windows(words, length)
            found = np.zeros(len(words), dtype=bool)
            found[here] = known.has(phrase_hash([words[here + i] for i in range(length)]))
            found[:-1] &= found[1:]  # the merge: with the occurrence at the next position
            found[-1:] = False
            runs = _runs(words, found, length + 1)
            yield pa.RecordBatch.from_arrays([_lists(_cut(runs))], names=["run"])

    longer = staged(relation.mapInArrow(extend, "run array<long>"), f"occurrences{length + 1}", **_DICTIONARY)
    known.drop()
    return longer


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The words of some rows at a time; every row ends with a piece."""
    for batch in batches:
        lists = batch.column(0)
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        if len(ends) and ends[-1] > ends[0]:
            at = np.unique(np.searchsorted(ends, np.arange(ends[0] + STEP, ends[-1], STEP)))
            for start, end in zip([ends[0], *ends[at]], [*ends[at], ends[-1]]):
                if end > start:
                    yield values[start:end]


def windows(words: np.ndarray, length: int) -> np.ndarray:
    """Places at which so many words follow one another within a piece."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    inside = words != 0
    return np.flatnonzero(reduce(and_, [inside[i : i + n] for i in range(length)]))


def phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    """One word is its own hash; more are mixed in order."""
    mixed = words[0].view(np.uint64)
    for word in words[1:]:
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX + word.view(np.uint64)
    return mixed.view(np.int64)


def _runs(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The words of the phrases that start at the marked places, 0 after each stretch of them."""
    edge = np.diff(np.concatenate([[0], starts.view(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = last - first + length  # the stretch, the rest of its last phrase, and 0
    ends = np.cumsum(sizes)
    places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)
    places[ends - 1] = 0
    out = words[places] if len(places) else np.zeros(0, dtype=np.int64)
    out[ends - 1] = 0
    return out


def _cut(runs: np.ndarray) -> list[np.ndarray]:
    """Into rows of about ``ROW`` words, each ending with a piece."""
    if not len(runs):
        return []
    ends = np.flatnonzero(runs == 0) + 1
    at = np.unique(ends[np.searchsorted(ends, np.arange(ROW, len(runs), ROW))])
    return [part for part in np.split(runs, at) if len(part)]


def _counts(relation: DataFrame, length: int) -> DataFrame:
    """``(w1, .., wk, a)``: how often each phrase of so many words occurs."""
    names = [f"w{i}" for i in range(1, length + 1)]

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _steps(batches):
            here = windows(words, length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words[here + i]) for i in range(length)], names=names
            )

    found = relation.mapInArrow(phrases, ", ".join(f"{name} long" for name in names))
    return found.groupBy(*names).agg(F.count(F.lit(1)).alias("a"))


def _scored(counted: DataFrame, frequent: dict[int, DataFrame], length: int) -> DataFrame:
    """Counts with language, text, and the cut of the lowest score. The parts of a frequent phrase are frequent."""
    names, cuts = [f"w{i}" for i in range(1, length + 1)], []
    for k in range(1, length):
        parts = (("l", names[:k], k), ("r", names[k:], length - k))
        for side, own, size in parts:
            kept = [F.col("a").alias(f"{side}{k}")]
            if k == 1:
                kept += [F.col("phrase").alias(f"{side}_text")]
                kept += [F.col("lang")] if side == "l" else []
            table = frequent[size].select(
                *[F.col(f"w{i}").alias(name) for i, name in enumerate(own, 1)], *kept
            )
            counted = counted.join(table, own)
        cuts.append(
            F.struct(
                _score(F.col("a"), F.col(f"l{k}") + F.col(f"r{k}")).alias("score"),
                F.lit(k).alias("k"),
                F.col(f"l{k}").alias("l"),
                F.col(f"r{k}").alias("r"),
            )
        )
    return counted.select(
        *names,
        "lang",
        F.concat_ws(" ", "l_text", "r_text").alias("phrase"),
        "a",
        F.array_min(F.array(*cuts)).alias("cut") if len(cuts) > 1 else cuts[0].alias("cut"),
    ).select(*names, "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _score(a: Column, parts: Column) -> Column:
    wide = F.lit(SCALE).cast("decimal(10,0)") * a.cast("decimal(20,0)")
    return F.call_function("div", wide, parts.cast("decimal(20,0)"))


def _without_parts(frequent: dict[int, DataFrame], length: int, longest: int) -> DataFrame:
    """Phrases of a length but those that occur mostly inside one longer phrase."""
    own = frequent[length]
    names = [f"w{i}" for i in range(1, length + 1)]
    inside = [
        frequent[m].select(
            F.inline(
                F.array(
                    *[
                        F.struct(*[F.col(f"w{s + i}").alias(f"w{i}") for i in range(1, length + 1)], "a")
                        for s in range(m - length + 1)
                    ]
                )
            )
        )
        for m in range(length + 1, longest + 1)
    ]
    if inside:
        most = reduce(DataFrame.unionByName, inside).groupBy(*names).agg(F.max("a").alias("longer"))
        own = own.join(most, names, "left").filter(
            F.coalesce(F.col("longer"), F.lit(0)).cast("decimal(20,0)") * 100
            < F.col("a").cast("decimal(20,0)") * INSIDE
        )
    return own.select("lang", "phrase", "a", "l", "r", "score")


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate([np.zeros(0, dtype=np.int64), *parts])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

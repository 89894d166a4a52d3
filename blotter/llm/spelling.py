"""Group spelling variants: words one edit apart, and the commonest form each leads to.

The vocabulary V is a set of words, T the transducer that changes exactly one code point (replaced,
inserted or deleted). The accepted pairs of the composition V o T o V are all pairs of near words.
V is never held whole. One edit leaves a common start and a common end which together are at least as
long as the shorter word less one, so one of them holds half of it. The vocabulary is therefore dealt by its
first half into the parts of the acceptor behind an initial state, and the reversed vocabulary by its last half. Each part
is minimised (equal remainders share a state), composed with T and with itself, and its accepted pairs are
listed. T is made unambiguous (a code point deleted from a stretch of equal ones is the last of
them), and the reversed parts leave out pairs that have half the word in common at the start, so every pair is accepted
once. Pairs are summed up per word inside the part before anything is shuffled.

A part of many or long words is dealt once more, by halves of what its words do not have in common yet, until the
remainders are so short that the alphabet bounds it. So memory is bounded, and no pair is lost.

Words come from whole texts: maximal runs of letters, A-Z lower-cased, here and there with one code point
left out as a fixed rule (``TYPO``) says. Counts are combined before each shuffle.

Defined cases: null and empty texts have no words; a null identifier counts as empty text in the typo rule. Rows
that repeat count each. Ties go to the smaller word in code-point order. Words without near words have
themselves as root. Words and texts are read whole whatever their length. Empty tables give empty results. Other columns than
identifier and text are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import staged

# Letters, the typo rule's modulus, least length and count of a word, and how much commoner a form is.
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
TYPO, MIN_CHARS, MIN_COUNT, RATIO = 97, 5, 3, 2

# Distinct words that a task gathers before it sends what it knows of them. Words times squared
# length that one part may have: some 15,000 words of which 8 code points differ.
GATHERED, WORK = 300_000, 1_000_000

_PART = ("length", "a", "b", "limit", "start", "finish")
_NEAR = "word string, n long, near long, best long, form string"


def vocabulary(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    typo: int | None = TYPO,
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """``(word, n)`` of the words that are long and common enough; without ``typo`` as they stand."""
    texts = docs.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                _count(counts, doc_id, body, typo, min_chars)
                if len(counts) >= GATHERED:
                    yield _counted(counts)
                    counts.clear()
        yield _counted(counts)

    found = texts.mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _count(counts: Counter, doc_id: str, body: bytes, typo: int | None, min_chars: int) -> None:
    prefix = zlib.crc32(f"{doc_id}:".encode())
    for word, n in Counter(LETTERS.findall(body.lower().decode("utf-8", "replace"))).items():  # lower of bytes: A-Z alone
        if typo:
            h = zlib.crc32(word.encode(), prefix)
            if h % typo == 0:
                place = h % len(word)
                word = word[:place] + word[place + 1 :]
        if len(word) >= min_chars:
            counts[word] += n


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
        names=["word", "n"],
    )


def variants(
    words: DataFrame, ratio: int = RATIO, min_chars: int = MIN_CHARS, work: int = WORK
) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for every row of ``(word, n)``.

    Words are distinct and of ``min_chars`` code points at least, three or more.
    """
    if min_chars < 3:
        raise ValueError("halves of shorter words are empty")
    words = staged(words.select("word", "n"), "vocabulary")
    near = near_words(words, work).groupBy("word").agg(
        F.sum("near").alias("n_near"),
        F.min(F.struct((-F.col("best")).alias("less"), "form")).alias("best"),
    )
    formed = (
        words.join(near, "word", "left")
        .withColumn("fit", -F.col("best.less") >= ratio * F.col("n"))
        .select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("fit"), F.col("best.form")).alias("form"),
            F.when(F.col("fit"), -F.col("best.less")).alias("form_n"),
        )
    )
    formed = staged(formed, "forms")
    return formed.join(_roots(formed), "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )


def near_words(words: DataFrame, work: int = WORK) -> DataFrame:
    """``(word, n, near, best, form)``, a row for each word and part in which it has near words:
    how many, the largest count among them, and the smallest word that has it."""
    # A word of length m meets words as long or longer by one in class m, shorter by one in class m - 1.
    size, none = F.length("word"), F.lit("")
    classed = words.select(
        F.explode(F.array(size, size - 1)).alias("length"),
        *[F.lit(0).alias(name) for name in ("a", "b", "limit")],
        *[none.alias(name) for name in ("start", "finish")],
        "word",
        "n",
    )
    parts, dealt = [], _halves(classed)
    while True:
        rest = F.col("length") - F.col("a") - F.col("b")
        large = staged(
            dealt.groupBy(*_PART)
            .agg(F.count(F.lit(1)).alias("held"))
            .filter((F.col("held") > 1) & (F.col("held") * rest * rest > work) & (rest > 1))
            .drop("held"),
            "large-parts",
        )
        if large.isEmpty():
            parts.append(dealt)
            break
        parts.append(dealt.join(large, list(_PART), "left_anti"))
        dealt = staged(_halves(dealt.join(large, list(_PART), "left_semi")), "parts")
    listed = [
        each.repartition(*_PART)
        .sortWithinPartitions(*_PART)
        .select(*_PART, "word", "n")
        .mapInArrow(_compose_parts, _NEAR)
        for each in parts
    ]
    return reduce(DataFrame.unionByName, listed)


def _halves(dealt: DataFrame) -> DataFrame:
    """Every word twice: by the first and by the last half of what its part does not have in common yet.

    ``a`` and ``b`` code points are in common at the start and the end. Pairs with ``limit`` code points in common at
    the start belong to a forward part, and not here.
    """
    half = F.floor((F.col("length") - F.col("a") - F.col("b")) / 2).cast("int")
    sides = F.explode(F.array(F.lit(False), F.lit(True))).alias("back")
    both = dealt.select("*", half.alias("half"), sides).filter("half > 0")
    back = F.col("back")
    return (
        both.withColumn("limit", F.when(back, F.col("a") + F.col("half")).otherwise(F.col("limit")))
        .withColumn("a", F.when(back, F.col("a")).otherwise(F.col("a") + F.col("half")))
        .withColumn("b", F.when(back, F.col("b") + F.col("half")).otherwise(F.col("b")))
        .withColumn("start", F.left("word", F.col("a")))
        .withColumn("finish", F.right("word", F.col("b")))
        .drop("half", "back")
    )


def _compose_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of parts to what each part's words have near them."""
    part, held, out = None, {}, _Best()
    for batch in batches:
        for *key, word, n in zip(*[c.to_pylist() for c in batch.columns]):
            if key != part:
                _compose_part(out, part, held)
                part, held = key, {}
                if len(out) >= GATHERED:
                    yield out.rows()
            held[word] = n
    _compose_part(out, part, held)
    yield out.rows()


def _compose_part(out: _Best, part: list | None, held: dict[str, int]) -> None:
    if len(held) < 2:
        return
    length, a, b, limit, start, finish = part
    for x, y in compose(Acceptor(word[a : len(word) - b] for word in held)):
        x, y = start + x + finish, start + y + finish
        if min(len(x), len(y)) == length and not (limit and x[:limit] == y[:limit]):
            out.add(x, held[x], y, held[y])


class _Best:
    """Per word how many near words it has, and the best of them."""

    def __init__(self):
        self.found: dict[str, tuple[int, int, int, str]] = {}

    def __len__(self) -> int:
        return len(self.found)

    def add(self, word: str, n: int, near: str, near_n: int) -> None:
        _, count, less, form = self.found.get(word, (n, 0, 0, ""))
        if (-near_n, near) < (less, form):
            less, form = -near_n, near
        self.found[word] = (n, count + 1, less, form)

    def rows(self) -> pa.RecordBatch:
        n, near, less, form = zip(*self.found.values()) if self.found else ((),) * 4
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array(list(self.found), pa.string()),
                pa.array(n, pa.int64()),
                pa.array(near, pa.int64()),
                pa.array([-x for x in less], pa.int64()),
                pa.array(form, pa.string()),
            ],
            names=["word", "n", "near", "best", "form"],
        )
        self.found = {}
        return batch


class Acceptor:
    """The minimal deterministic acyclic acceptor of a set of words.

    Words come in order, so all states but those of the last word are final in shape when the next one comes;
    each is replaced by an equal one if there is one. States are numbered; ``steps`` has a state's
    transitions, ``accepts`` whether it ends a word.
    """

    def __init__(self, words):
        self.steps: list[dict[str, int]] = [{}]
        self.accepts: list[bool] = [False]
        known: dict[tuple, int] = {}
        path: list[tuple[int, str]] = []
        before = ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            self._settle(path, shared, known)
            state = self._end(path)
            for c in word[shared:]:
                path.append((state, c))
                self.steps.append({})
                self.accepts.append(False)
                self.steps[state][c] = state = len(self.steps) - 1
            self.accepts[state] = True
            before = word
        self._settle(path, 0, known)

    def _end(self, path: list[tuple[int, str]]) -> int:
        return self.steps[path[-1][0]][path[-1][1]] if path else 0

    def _settle(self, path: list[tuple[int, str]], keep: int, known: dict) -> None:
        while len(path) > keep:
            state, c = path.pop()
            child = self.steps[state][c]
            shape = (self.accepts[child], *sorted(self.steps[child].items()))
            self.steps[state][c] = known.setdefault(shape, child)


def compose(acceptor: Acceptor) -> Iterator[tuple[str, str]]:
    """All pairs that the composition with the one-edit transducer and the acceptor itself accepts, each once."""
    alike: dict[tuple[int, int], list[str]] = {}
    steps, accepts = acceptor.steps, acceptor.accepts

    def common(p: int, q: int) -> list[str]:
        """What is accepted from both states, after the edit."""
        found = alike.get((p, q))
        if found is None:
            found = [""] if accepts[p] and accepts[q] else []
            after = steps[q]
            for c, to in steps[p].items():
                if c in after:
                    found += [c + rest for rest in common(to, after[c])]
            alike[p, q] = alike[q, p] = found
        return found

    stack = [(0, "")]  # before the edit both sides are in the same state
    while stack:
        state, before = stack.pop()
        for c, to in steps[state].items():
            stack.append((to, before + c))
            for d, there in steps[state].items():
                if c != d:
                    for rest in common(to, there):
                        yield before + c + rest, before + d + rest
            for rest in common(to, state):
                if rest[:1] != c:  # c was the last of its kind in a row
                    yield before + c + rest, before + rest
                    yield before + rest, before + c + rest


def _roots(formed: DataFrame) -> DataFrame:
    """``(word, root)`` of the words with a form: the last word that its forms lead to.

    A form is commoner than its word, so there is no circle. Every round doubles the steps that all words have
    made, and is written before the next.
    """
    now = staged(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(
            now.join(further, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "roots",
        )
        now = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return now

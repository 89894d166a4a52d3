"""How many tokens a unigram tokenizer makes of each text, without making them.

A unigram tokenizer cuts a text into the vocabulary pieces whose scores have the largest
sum. An Aho-Corasick automaton enumerates all pieces in one scan, and dynamic programming over
their ends carries the best sum so far and the number of pieces behind it; no path is kept.

Tie rules are the tokenizer's: at each end a later candidate must be strictly better, and
candidates come by their start, so of equal sums the longest last piece wins. A character that
is no piece itself may be unknown at the lowest score less ten; it then counts as its UTF-8 bytes
(byte fallback). Spaces become U+2581, the text gets one in front unless it has it, and each such mark begins
a segment of its own; segments are independent, so equal ones are counted once per task and remembered.

Defined cases: null and empty texts have no tokens. Repeated rows are each counted. An empty table gives an
empty result. Texts are read whole; very long segments take time and memory in proportion. Other columns than
identifier and text are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# Fixed value: how far below the lowest score an unknown character stands.
UNKNOWN_PENALTY = 10.0

REMEMBERED = 300_000
# Longer segments are not remembered.
LONG_SEGMENT = 64

_COUNTED = pa.struct([("n_tokens", pa.int64()), ("n_bytes", pa.int64())])


@dataclass
class Unigram:
    """Pieces with their scores, and the lowest score of the whole vocabulary."""

    pieces: dict[str, float]
    lowest: float


def load_vocabulary(path: str = TOKENIZER) -> Unigram:
    """The ordinary pieces of a tokenizer's vocabulary file, with the scores it gives them."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    scores = {i: model.get_score(i) for i in every}
    ordinary = (
        i for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    )
    return Unigram({model.id_to_piece(i): scores[i] for i in ordinary}, min(scores.values()))


def count_tokens(
    docs: DataFrame, vocabulary: Unigram, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, n_tokens, n_bytes)``; the latter are tokens of unknown characters."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("struct<n_tokens:bigint,n_bytes:bigint>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(shared.value)
        for batch in batches:
            counts = [counter.text(t) for t in batch.to_pylist()]
            yield pa.array([{"n_tokens": n, "n_bytes": b} for n, b in counts], type=_COUNTED)

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.select("doc_id", counted("text").alias("n")).select("doc_id", "n.*")


class Counter:
    """Counts tokens, remembering short segments."""

    def __init__(self, vocabulary: Unigram):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in vocabulary.pieces if len(p) == 1}
        self.unknown = vocabulary.lowest - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, int]] = {}

    def text(self, text: str | None) -> tuple[int, int]:
        tokens = unknown = 0
        for segment in segments(text):
            found = self.known.get(segment)
            if found is None:
                found = self.segment(segment)
                if len(segment) <= LONG_SEGMENT:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    self.known[segment] = found
            tokens += found[0]
            unknown += found[1]
        return tokens, unknown

    def segment(self, segment: str) -> tuple[int, int]:
        """Tokens, and how many of them are bytes of unknown characters."""
        n = len(segment)
        score: list[float | None] = [None] * (n + 1)
        score[0] = 0.0
        tokens, unknown = [0] * (n + 1), [0] * (n + 1)
        done = 0
        # All candidates with a smaller end come before, and longer pieces before shorter.
        for last, (length, worth) in self.automaton.iter(segment):
            end = last + 1
            while done < last:
                done += 1
                self._unknown(segment, done, score, tokens, unknown)
            start = end - length
            candidate = score[start] + worth
            if score[end] is None or candidate > score[end]:
                score[end], tokens[end], unknown[end] = candidate, tokens[start] + 1, unknown[start]
        while done < n:
            done += 1
            self._unknown(segment, done, score, tokens, unknown)
        return tokens[n], unknown[n]

    def _unknown(self, segment, end, score, tokens, unknown) -> None:
        """The last candidate for an end: its character alone, if it is no piece."""
        char = segment[end - 1]
        if char in self.single:
            return
        candidate = score[end - 1] + self.unknown
        if score[end] is None or candidate > score[end]:
            size = len(char.encode("utf-8", "surrogatepass"))
            score[end] = candidate
            tokens[end], unknown[end] = tokens[end - 1] + size, unknown[end - 1] + size


def segments(text: str | None) -> list[str]:
    """Stretches that begin with the mark."""
    if not text:
        return []
    marked = text.replace(" ", MARK)
    if not marked.startswith(MARK):
        marked = MARK + marked
    return re.findall(f"{MARK}[^{MARK}]*", marked)

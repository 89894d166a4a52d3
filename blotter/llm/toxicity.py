"""Score texts for toxicity with a small recurrent network, trained in numpy.

Words are read as they are cut at white space, in lower case, without punctuation around
them. A run of more than ``LONGEST`` characters, as in scripts without spaces, is read in pieces
of that length that overlap by half and cover it; each piece counts as a word. Each word is two inputs: a word vector and the mean of its hashed character trigram
vectors. A bidirectional gated recurrent network reads a window of words, attention pools
its states, and a logistic unit gives the window's score. Windows overlap by half and cover
the whole text; a text's score follows from its worst window.

Training: a bounded sample of labelled rows (at most ``SAMPLE`` of each label, those with the
smallest hash of their identifier; equal texts once). Spark counts in how many sample texts of
each label a word occurs. Words that enough texts have get a vector of their own, whose first
part starts at the word's log-odds where these are significant; the others share one. All
other weights start at random, and all are trained. Of a toxic text the window with the highest
summed log-odds is shown as toxic, of another text its highest and a random one as not
toxic, since a label holds for a text and not for each part of it. A quarter of the sample is
kept out of all this. It tells when to stop, and on it the worst window's score is turned into
a probability for the text by a logistic fit, corrected to the share of toxic texts among all
labels. Seeds are fixed, so a fit repeats.

Scoring is one pass without a shuffle. The model is a few megabytes whatever the data.

Defined cases: null and empty texts have one empty window, whose score the network gives too.
Repeated rows get equal scores. Labels that are null or have no document are not used; without a
single label of either class every score is 0. An empty table gives an empty result. Other
columns than identifier, text and label are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import staged, word_array

WINDOW, STRIDE = 64, 32
HIDDEN, CHARS = 8, 4
TRIGRAM_SLOTS = 1 << 12
LONGEST = 40
# Words with a vector of their own: in so many sample texts at least, and so many at most.
WORD_TEXTS, VOCABULARY = 4, 1 << 14
# Log-odds count as significant beyond so many standard errors.
SIGNIFICANT = 3.0
SAMPLE = 2000
STEPS, BATCH, RATE = 400, 128, 0.01
# Word and trigram vectors learn slower than the network and are drawn back to their start;
# other weights are drawn to zero. Of the states after every so many steps the one that does
# best on the texts kept out is taken.
SLOWER, DECAY, SHRINK, LOOK = 0.1, 0.02, 0.0005, 20
SEED = 20
THRESHOLD = 0.7

_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_CACHED_WORDS = 200_000
_FEW_WORDS = 200_000


def windows_of(count: int) -> np.ndarray:
    """Starts of overlapping windows that cover all words; the last ends with the text."""
    if count <= WINDOW:
        return np.zeros(1, dtype=np.int64)
    starts = np.arange(0, count - WINDOW, STRIDE)
    return np.append(starts, count - WINDOW)


def trigram_bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the trigrams of all words in a row, and how many each word has."""
    marked = [f"<{word}>" for word in words]
    lengths = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    codes = np.frombuffer(
        "".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32
    ).astype(np.uint64)
    first = np.ones(len(codes), dtype=bool)
    ends = np.cumsum(lengths)
    first[ends - 1] = first[ends - 2] = False
    at = np.flatnonzero(first)
    mixed = codes[at] * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ codes[at + 1]) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ codes[at + 2]) * np.uint64(0x165667B19E3779F9)
    return (mixed >> np.uint64(40)).astype(np.int64) % TRIGRAM_SLOTS, lengths - 2


@dataclass
class Network:
    """Weights by name (see :func:`fresh_network`), rows of known words, and calibration."""

    weights: dict[str, np.ndarray]
    vocabulary: dict[str, int]
    slope: float = 1.0
    shift: float = 0.0

    def word_vectors(self, words: list[str]) -> np.ndarray:
        """Both inputs of each word, side by side."""
        w = self.weights
        if not words:
            return np.zeros((0, 2 + CHARS), dtype=np.float32)
        rows = [self.vocabulary.get(word, 0) for word in words]
        slots, counts = trigram_bags(words)
        sums = np.add.reduceat(w["trigram"][slots], np.cumsum(counts) - counts, axis=0)
        return np.concatenate([w["word"][rows], sums / counts[:, None]], axis=1).astype(np.float32)

    def probability(self, worst: np.ndarray) -> np.ndarray:
        """What the worst window's score means for a text."""
        clipped = np.clip(worst, 1e-6, 1 - 1e-6)
        odds = self.slope * np.log(clipped / (1 - clipped)) + self.shift
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fresh_network(rng: np.random.Generator, log_odds: dict[str, float]) -> Network:
    """Of a word's two inputs one holds its log-odds at the start, the other is free."""
    size = 2 + CHARS
    draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    weights = {"word": draw(len(log_odds) + 1, 2), "trigram": draw(TRIGRAM_SLOTS, CHARS) / 5}
    weights["word"] /= 5
    weights["word"][0] = 0
    weights["word"][1:, 0] = list(log_odds.values())
    for d in "fb":
        weights[f"in_{d}"] = draw(size, 3 * HIDDEN)
        weights[f"in_{d}"][0] += 0.5
        weights[f"state_{d}"] = draw(HIDDEN, 3 * HIDDEN)
        weights[f"bias_{d}"] = np.zeros(3 * HIDDEN, dtype=np.float32)
    weights["attend"] = draw(2 * HIDDEN, HIDDEN)
    weights["query"] = draw(HIDDEN)
    weights["out"] = draw(2 * HIDDEN)
    weights["shift"] = np.zeros(1, dtype=np.float32)
    return Network(weights, {word: i + 1 for i, word in enumerate(log_odds)})


@dataclass
class Windows:
    """Windows of words with their labels."""

    words: list[list[str]]
    labels: np.ndarray


def train(learn: Windows, check: Windows, log_odds: dict[str, float]) -> Network:
    """Adam on the cross entropy, both labels weighted by the root of their rarity."""
    rng = np.random.default_rng(SEED)
    net = fresh_network(rng, log_odds)
    start = {name: net.weights[name].copy() for name in ("word", "trigram")}
    lexicon = _Lexicon(net, sorted({w for part in (learn, check) for window in part.words for w in window}))
    ids, watched = (np.stack([lexicon.ids(w) for w in part.words]) for part in (learn, check))
    positive = min(max(learn.labels.mean(), 1e-6), 1 - 1e-6)
    rarity = lambda labels: np.where(labels > 0, (1 - positive) ** 0.5, positive**0.5).astype(np.float32)
    weigh, weigh_watched = rarity(learn.labels), rarity(check.labels)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    order = np.zeros(0, dtype=np.int64)
    best, least = None, np.inf
    for step in range(1, STEPS + 1):
        if len(order) < min(BATCH, len(ids)):
            order = np.concatenate([order, rng.permutation(len(ids))])
        rows, order = order[:BATCH], order[BATCH:]
        gradients = _batch_gradients(net, lexicon, ids[rows], learn.labels[rows], weigh[rows])
        for name, g in gradients.items():
            m, v = moments[name]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            scale = RATE * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            change = scale * m / (np.sqrt(v) + 1e-7)
            if name in start:
                change = SLOWER * change + DECAY * (net.weights[name] - start[name])
            else:
                change = change + SHRINK * net.weights[name]
            net.weights[name] -= change
        if step % LOOK == 0:
            p = np.clip(_forward(net.weights, lexicon.inputs(net, watched), watched != 0)[0], 1e-6, 1 - 1e-6)
            y = check.labels
            loss = float((weigh_watched * -(y * np.log(p) + (1 - y) * np.log(1 - p))).mean())
            if loss < least:
                best, least = {k: v.copy() for k, v in net.weights.items()}, loss
    return Network(best, net.vocabulary)


class _Lexicon:
    """The words of the training windows: number 0 is no word."""

    def __init__(self, net: Network, words: list[str]):
        self.number = {word: i + 1 for i, word in enumerate(words)}
        self.rows = np.array([0, *(net.vocabulary.get(word, 0) for word in words)])
        slots, counts = trigram_bags(words) if words else (np.zeros(0, np.int64),) * 2
        self.counts = np.concatenate([[0], counts])
        self.slots, self.starts = slots, np.cumsum(self.counts) - self.counts

    def ids(self, window: list[str]) -> np.ndarray:
        out = np.zeros(WINDOW, dtype=np.int64)
        out[: len(window)] = [self.number[word] for word in window]
        return out

    def inputs(self, net: Network, ids: np.ndarray) -> np.ndarray:
        used, inverse = np.unique(ids, return_inverse=True)
        return self.vectors(net, used)[inverse.reshape(ids.shape)]

    def vectors(self, net: Network, words: np.ndarray) -> np.ndarray:
        slots, owner = self.bags(words)
        out = np.zeros((len(words), 2 + CHARS), dtype=np.float32)
        out[:, :2] = net.weights["word"][self.rows[words]]
        np.add.at(out[:, 2:], owner, net.weights["trigram"][slots])
        out[:, 2:] /= np.maximum(self.counts[words], 1)[:, None]
        return out

    def bags(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the given words' trigrams, and each slot's place among the words."""
        counts = self.counts[words]
        owner = np.repeat(np.arange(len(words)), counts)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.slots[self.starts[words][owner] + inner], owner


def calibrate(net: Network, worst: np.ndarray, toxic: np.ndarray, share: float) -> Network:
    """Logistic fit of labels on the worst window's log-odds, held near the plain score by a
    prior worth a few texts; ``share`` is that of toxic texts where the scores will be used."""
    clipped = np.clip(worst, 1e-3, 1 - 1e-3)
    x = np.log(clipped / (1 - clipped))
    best = (np.inf, 1.0, 0.0)
    for slope in np.linspace(0.3, 1.5, 25):
        shift = 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-(slope * x + shift)))
            pull = ((p - toxic).sum() + 0.2 * shift) / ((p * (1 - p)).sum() + 0.2)
            shift -= np.clip(pull, -1, 1)
        p = np.clip(1 / (1 + np.exp(-(slope * x + shift))), 1e-9, 1 - 1e-9)
        loss = -(toxic * np.log(p) + (1 - toxic) * np.log(1 - p)).sum()
        loss += 2 * (slope - 1) ** 2 + 0.1 * shift**2
        best = min(best, (loss, slope, shift))
    seen = min(max(toxic.mean(), 1e-3), 1 - 1e-3)
    share = min(max(share, 1e-3), 1 - 1e-3)
    prior = np.log(share / (1 - share)) - np.log(seen / (1 - seen))
    return Network(net.weights, net.vocabulary, float(best[1]), float(best[2] + prior))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Learn from the ``(doc_id, toxic)`` rows given; none if either class is missing."""
    known = (
        labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .select("doc_id", F.col("toxic").cast("int"))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    share = known.agg(F.avg("toxic")).first()[0]
    chosen = _sampled(docs, known, sample)
    learn, check = chosen.filter(~_kept_out()), chosen.filter(_kept_out())
    sizes = {r["toxic"]: r["n"] for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    log_odds = _log_odds(learn, sizes)
    shown = _shown(learn, log_odds)
    net = train(shown, _shown(check, log_odds) if check.head(1) else shown, log_odds)
    marked = check.select("toxic", score_text(docs, net)(F.col("text")).alias("score")).collect()
    if len({r["toxic"] for r in marked}) < 2:
        return net
    return calibrate(
        net, np.array([r["score"] for r in marked]), np.array([r["toxic"] for r in marked]), share
    )


def score(
    docs: DataFrame, network: Network | None, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, score)`` for every row, from the text alone."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("string").alias("text"))
    if network is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    return rows.select("doc_id", score_text(docs, network)(F.col("text")).alias("score"))


def score_text(docs: DataFrame, network: Network):
    """A column function that scores texts."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(shared.value)
        for batch in batches:
            yield pa.array(reader.scores(batch.to_pylist()), pa.float64())

    return scored


class Reader:
    """Scores texts in batches of windows; keeps what it knows of recent words."""

    def __init__(self, network: Network, together: int = 4096):
        self.network, self.together = network, together
        self.forget()

    def forget(self) -> None:
        w = self.network.weights
        self.gates = np.concatenate([w[f"in_{d}"] for d in "fb"], axis=1)
        self.bias = np.concatenate([w[f"bias_{d}"] for d in "fb"])
        self.number: dict[str, int] = {"": 0}
        self.table = np.zeros((1024, len(self.bias)), dtype=np.float32)

    def scores(self, texts: list[str | None]) -> list[float]:
        """Texts are taken a few at a time, so that words in hand stay bounded."""
        worst, some, held = np.zeros(len(texts)), [], 0
        for i, text in enumerate(texts):
            words = clean_words(text)
            some.append((i, words))
            held += len(words)
            if held >= _FEW_WORDS or i + 1 == len(texts):
                self._score(some, worst)
                some, held = [], 0
        return self.network.probability(worst).tolist()

    def _score(self, texts: list[tuple[int, list[str]]], worst: np.ndarray) -> None:
        if len(self.number) > _CACHED_WORDS:
            self.forget()
        self._learn({word for _, words in texts for word in words})
        find, reach = self.number.__getitem__, np.arange(WINDOW)
        windows, owners = [], []
        for i, words in texts:
            ids = np.fromiter(map(find, words), dtype=np.int64, count=len(words))
            ids = np.concatenate([ids, np.zeros(max(0, WINDOW - len(ids)), dtype=np.int64)])
            found = ids[windows_of(len(words))[:, None] + reach]
            windows.append(found)
            owners.append(np.full(len(found), i))
        windows, owners = np.concatenate(windows), np.concatenate(owners)
        for at in range(0, len(owners), self.together):
            part = windows[at : at + self.together]
            found = _run(self.network.weights, self.table, part)
            np.maximum.at(worst, owners[at : at + self.together], found)

    def _learn(self, words: set[str]) -> None:
        new = [word for word in words if word not in self.number]
        start = len(self.number)
        if start + len(new) > len(self.table):
            grown = np.zeros((2 * (start + len(new)), self.table.shape[1]), dtype=np.float32)
            grown[: len(self.table)] = self.table
            self.table = grown
        vectors = self.network.word_vectors(new)
        self.table[start : start + len(new)] = vectors @ self.gates + self.bias
        self.number.update(zip(new, range(start, start + len(new))))


def clean_words(text: str | None) -> list[str]:
    """Words without the punctuation around them; what is only punctuation goes. Long runs come
    in pieces."""
    words = (word.strip(_EDGE) for word in (text or "").lower().split())
    return [piece for word in words if word for piece in pieces_of(word)]


def pieces_of(run: str) -> list[str]:
    """The run itself, or pieces of ``LONGEST`` characters; the last ends with the run."""
    last = len(run) - LONGEST
    if last <= 0:
        return [run]
    return [run[at : at + LONGEST] for at in (*range(0, last, LONGEST // 2), last)]


def _pieces_of(run: Column) -> Column:
    """The same as an expression."""
    last = F.length(run) - LONGEST
    numbers = F.sequence(F.lit(0), F.ceil(last / F.lit(LONGEST // 2)).cast("int"))
    piece = lambda n: F.substring(run, F.least(n * (LONGEST // 2), last) + 1, F.lit(LONGEST))
    return F.when(last <= 0, F.array(run)).otherwise(F.transform(numbers, piece))


_EDGES = r"^[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+$"


def is_held_out(identifier: Column) -> Column:
    return F.coalesce(F.crc32(identifier.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sampled(docs: DataFrame, known: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` rows of each label, the same ones each time, with their texts."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = reduce(
        DataFrame.unionByName,
        [known.filter(F.col("toxic") == label).orderBy(*order).limit(sample) for label in (0, 1)],
    )
    # The sample's bound is that of the broadcast, too.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged(texts.join(F.broadcast(chosen), "doc_id"), "labelled").dropDuplicates(
        ["toxic", "text"]
    )


def _kept_out() -> Column:
    """The quarter of the sample on which scores are calibrated; equal texts stay together."""
    return F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit(SEED)), F.lit(4)) == 0


def _log_odds(learn: DataFrame, sizes: dict[int, int]) -> dict[str, float]:
    """The vocabulary, each word with its log-odds where they are significant, else 0."""
    stripped = F.transform(word_array(F.lower("text")), lambda w: F.regexp_replace(w, _EDGES, ""))
    cleaned = F.array_distinct(F.flatten(F.transform(stripped, _pieces_of)))
    counted = (
        learn.select("toxic", F.explode(cleaned).alias("word"))
        .groupBy("word")
        .agg(F.sum("toxic").alias("pro"), F.sum(1 - F.col("toxic")).alias("contra"))
        .filter((F.col("word") != "") & (F.col("pro") + F.col("contra") >= WORD_TEXTS))
    )
    pro, contra = F.col("pro") + 1, F.col("contra") + 1
    odds = F.log(pro / (sizes[1] + 2)) - F.log(contra / (sizes[0] + 2))
    certain = F.abs(odds) > SIGNIFICANT * F.sqrt(1 / pro + 1 / contra)
    told = counted.select(
        "word",
        F.when(certain, odds).otherwise(0.0).alias("odds"),
        (F.col("pro") + F.col("contra")).alias("texts"),
    )
    first = told.orderBy(F.abs("odds").desc(), F.desc("texts"), "word").limit(VOCABULARY)
    return {r["word"]: r["odds"] for r in first.collect()}


def _shown(chosen: DataFrame, log_odds: dict[str, float]) -> Windows:
    """The windows to learn from: at most two of each sampled text."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                words = clean_words(text)
                odds = np.concatenate([[0.0], np.cumsum([max(0.0, log_odds.get(w, 0.0)) for w in words])])
                starts = windows_of(len(words))
                sums = odds[np.minimum(starts + WINDOW, len(words))] - odds[starts]
                picks = {int(starts[np.argmax(sums)])}
                if not toxic:
                    picks.add(int(starts[xxhash.xxh64_intdigest(str(doc_id), SEED) % len(starts)]))
                out += [
                    {"doc_id": doc_id, "at": at, "toxic": toxic, "words": " ".join(words[at : at + WINDOW])}
                    for at in sorted(picks)
                ]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema(
        [("doc_id", pa.int64()), ("at", pa.int64()), ("toxic", pa.int32()), ("words", pa.string())]
    )
    shown = chosen.select(F.col("doc_id").cast("long"), "text", "toxic").mapInArrow(
        pick, "doc_id long, at long, toxic int, words string"
    )
    rows = sorted(shown.collect(), key=lambda r: (r["doc_id"], r["at"], r["words"]))
    return Windows(
        [r["words"].split(" ") if r["words"] else [] for r in rows],
        np.array([r["toxic"] for r in rows], dtype=np.float32),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def _run(w: dict, table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Scores of windows of word numbers; nothing is kept for training."""
    n, steps = ids.shape
    states = np.zeros((n, steps, 2 * HIDDEN), dtype=np.float32)
    for d, (name, order) in enumerate((("f", range(steps)), ("b", range(steps - 1, -1, -1)))):
        h = np.zeros((n, HIDDEN), dtype=np.float32)
        own = np.ascontiguousarray(table[:, d * 3 * HIDDEN : (d + 1) * 3 * HIDDEN])
        for t in order:
            h = _step(own[ids[:, t]], h, w[f"state_{name}"], ids[:, t, None] != 0)[0]
            states[:, t, d * HIDDEN : (d + 1) * HIDDEN] = h
    return _pool(w, states, ids != 0)[0]


def _step(x, h, state, live):
    """One gated step: reset, update and candidate. Steps without a word keep the state."""
    s = h @ state
    gates = _sigmoid(x[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
    r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
    c = np.tanh(x[:, 2 * HIDDEN :] + r * s[:, 2 * HIDDEN :])
    new = np.where(live, (1 - z) * c + z * h, h)
    return new, (r, z, c, s[:, 2 * HIDDEN :])


def _pool(w, states, mask):
    """Attention over words, then the logistic unit. Without words the pooled state is zero."""
    hidden = np.tanh(states @ w["attend"])
    energy = np.where(mask, hidden @ w["query"], np.float32(-1e9))
    share = np.exp(energy - energy.max(axis=1, keepdims=True)) * mask
    share = share / np.maximum(share.sum(axis=1, keepdims=True), np.float32(1e-9))
    pooled = (share[:, :, None] * states).sum(axis=1)
    return _sigmoid(pooled @ w["out"] + w["shift"][0]), hidden, share, pooled


def _forward(w, inputs, mask):
    gates = np.concatenate([inputs @ w[f"in_{d}"] + w[f"bias_{d}"] for d in "fb"], axis=2)
    n, steps = mask.shape
    states = np.zeros((n, steps, 2 * HIDDEN), dtype=np.float32)
    kept = {}
    for d, (name, order) in enumerate((("f", range(steps)), ("b", range(steps - 1, -1, -1)))):
        h = np.zeros((n, HIDDEN), dtype=np.float32)
        for t in order:
            own = gates[:, t, d * 3 * HIDDEN : (d + 1) * 3 * HIDDEN]
            new, parts = _step(own, h, w[f"state_{name}"], mask[:, t, None])
            kept[name, t] = (h, *parts)
            states[:, t, d * HIDDEN : (d + 1) * HIDDEN] = h = new
    scores, hidden, share, pooled = _pool(w, states, mask)
    return scores, (states, kept, hidden, share, pooled)


def _batch_gradients(net, lexicon, ids, labels, weigh) -> dict[str, np.ndarray]:
    """Gradients of the mean weighted cross entropy, by hand."""
    w, mask = net.weights, ids != 0
    used, inverse = np.unique(ids, return_inverse=True)
    inverse = inverse.reshape(ids.shape)
    slots, owner = lexicon.bags(used)
    per_word = np.maximum(lexicon.counts[used], 1)[:, None]
    vectors = lexicon.vectors(net, used)
    inputs = vectors[inverse]
    scores, (states, kept, hidden, share, pooled) = _forward(w, inputs, mask)

    g = {k: np.zeros_like(v) for k, v in w.items()}
    d_out = (weigh * (scores - labels) / len(labels)).astype(np.float32)
    g["out"], g["shift"] = pooled.T @ d_out, np.array([d_out.sum()], dtype=np.float32)
    d_pooled = d_out[:, None] * w["out"]
    d_share = (states * d_pooled[:, None, :]).sum(axis=2)
    d_states = share[:, :, None] * d_pooled[:, None, :]
    d_energy = share * (d_share - (share * d_share).sum(axis=1, keepdims=True))
    g["query"] = (hidden * d_energy[:, :, None]).sum(axis=(0, 1))
    d_hidden = d_energy[:, :, None] * w["query"] * (1 - hidden**2)
    g["attend"] = states.reshape(-1, 2 * HIDDEN).T @ d_hidden.reshape(-1, HIDDEN)
    d_states += d_hidden @ w["attend"].T

    d_inputs = np.zeros_like(inputs)
    steps = ids.shape[1]
    for d, (name, order) in enumerate((("f", range(steps - 1, -1, -1)), ("b", range(steps)))):
        state, weight = w[f"state_{name}"], w[f"in_{name}"]
        d_h = np.zeros((len(ids), HIDDEN), dtype=np.float32)
        for t in order:
            h, r, z, c, s = kept[name, t]
            d_h = d_h + d_states[:, t, d * HIDDEN : (d + 1) * HIDDEN]
            live = mask[:, t, None]
            d_new = d_h * live
            d_c = d_new * (1 - z) * (1 - c**2)
            d_z = d_new * (h - c) * z * (1 - z)
            d_r = d_c * s * r * (1 - r)
            d_x = np.concatenate([d_r, d_z, d_c], axis=1)
            d_s = np.concatenate([d_r, d_z, d_c * r], axis=1)
            g[f"state_{name}"] += h.T @ d_s
            g[f"in_{name}"] += inputs[:, t].T @ d_x
            g[f"bias_{name}"] += d_x.sum(axis=0)
            d_inputs[:, t] += d_x @ weight.T
            d_h = d_h * ~live + d_new * z + d_s @ state.T
    d_words = np.zeros_like(vectors)
    np.add.at(d_words, inverse.ravel(), d_inputs.reshape(-1, 2 + CHARS))
    known = lexicon.rows[used] != 0
    np.add.at(g["word"], lexicon.rows[used[known]], d_words[known, :2])
    np.add.at(g["trigram"], slots, (d_words[:, 2:] / per_word)[owner])
    return g

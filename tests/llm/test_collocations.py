"""Collocations against counting everything in memory."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from blotter.llm import collocations
from blotter.llm.collocations import _cut, _runs, windows

DOCS = "doc_id long, lang string, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, longest, least, top):
    counts = {}
    for _, lang, text in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            for m in range(1, longest + 1):
                own.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, own in counts.items():
        n = sum(c for g, c in own.items() if len(g) == 1)
        candidates = {g: a for g, a in own.items() if len(g) > 1 and a >= least}
        inside = Counter()
        for g, a in candidates.items():
            for m in range(2, len(g)):
                for s in range(len(g) - m + 1):
                    inside[g[s : s + m]] = max(inside[g[s : s + m]], a)
        ranked = []
        for g, a in candidates.items():
            if 100 * inside[g] >= 80 * a:
                continue
            score, _, l, r = min((2000000 * a // (own[g[:k]] + own[g[k:]]), k, own[g[:k]], own[g[k:]]) for k in range(1, len(g)))
            ranked.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def some_rows(seed, documents=120):
    rng = random.Random(seed)
    words = ["a", "A", "b", "c", "d", "Été", "été", "x-y", "z\x00", "w" * 300]
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "!", "\n", "\x0b"]
    out = []
    for i in range(documents):
        parts = ["new york city hall " if rng.random() < 0.2 else rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(40))]
        out.append((i, rng.choice(["en", "en", "fr", None, "und"]), "".join(parts)))
    return out


@pytest.mark.parametrize(("longest", "least", "top", "most_bits"), [(4, 5, 2000, 1 << 29), (4, 5, 2000, 64), (3, 2, 7, 1 << 29), (2, 1, 50, 1 << 29), (5, 4, 30, 1 << 29)])
def test_same_as_counting_in_memory(spark, longest, least, top, most_bits):
    """Also with a bitmap that lets every occurrence through."""
    rows = some_rows(longest)
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = collocations.collocations(df, longest=longest, least=least, top=top, most_bits=most_bits)
    want = plain(rows, longest, least, top)
    assert sorted(map(tuple, got.collect())) == want and want
    assert any(len(r[2].split()) > 2 for r in want) or longest == 2


def test_colliding_identifiers_take_another_seed(spark, monkeypatch):
    """Under the first seed all words look alike."""
    real = collocations.xxhash.xxh64_intdigest

    class Alike:
        @staticmethod
        def xxh64_intdigest(data, seed=0):
            return 5 if seed == 0 else real(data, seed)

    monkeypatch.setattr(collocations, "xxhash", Alike)
    rows = some_rows(8, 40)
    relation, words = collocations._occurrences(spark.createDataFrame(rows, DOCS), "lang", "text")
    ids = [r["w1"] for r in words.collect()]
    assert len(ids) == len(set(ids)) > 10


def test_edge_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "en", ""), (2, "en", " .,\n\t"), (3, "en", "one"), (4, "fr", "à la " * 20_000), (4, "fr", "à la")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", n int, phrase int")
    got = sorted(map(tuple, collocations.collocations(df).collect()))
    assert got == plain(rows, 4, 30, 2000) and got
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df.filter("lang = 'en'")).count() == 0


def test_exact_beyond_64_bits(spark):
    """2,000,000 times a count of some 10^13."""
    big = 9_000_000_000_001
    row = spark.range(1).selectExpr(f"{big}L as a", f"{2 * big + 1}L as parts")
    score = row.select(collocations._score(row["a"], row["parts"])).first()[0]
    assert score == 2_000_000 * big // (2 * big + 1) == 999_999


def test_runs_hold_exactly_the_marked_phrases():
    rng = np.random.default_rng(1)
    for _ in range(200):
        words = np.append(rng.integers(0, 4, rng.integers(0, 60)), 0)
        length = int(rng.integers(2, 5))
        here = windows(words, length)
        marked = np.zeros(len(words), dtype=bool)
        marked[here[rng.random(len(here)) < 0.6]] = True
        runs = _runs(words, marked, length)
        parts = _cut(runs)
        assert sum(map(len, parts)) == len(runs)
        got = Counter(tuple(runs[i : i + length]) for i in windows(runs, length))
        assert got == Counter(tuple(words[i : i + length]) for i in np.flatnonzero(marked))


def test_rows_of_relations_stay_small(spark):
    """Thousands of rows are in memory at once, so a row must not grow with its document."""
    piece = ["here are", "a few words"]
    text = ". ".join(piece * 10_000)
    df = spark.createDataFrame([(1, "en", text), (2, "fr", "x " * 40), (3, "en", "one")], DOCS)
    relation, words = collocations._occurrences(df, "lang", "text")
    sizes = [r[0] for r in relation.selectExpr("size(run)").collect()]
    assert sum(sizes) == 20_000 * 2.5 + 20_000 + 41 + 2 and max(sizes) <= 256
    longer = collocations._extended(relation, words.filter("a >= 30"), 1, 1 << 20)
    sizes = [r[0] for r in longer.selectExpr("size(run)").collect()]
    assert sum(sizes) == 20_000 * 2.5 + 20_000 + 41 and max(sizes) <= 256
    ends = longer.selectExpr("element_at(run, -1) AS last").distinct().collect()
    assert [r["last"] for r in ends] == [0]

"""Spelling variants against comparing every word with every other."""

import random
import re
import zlib
from collections import Counter

import pytest

from blotter.llm import spelling
from blotter.llm.spelling import Acceptor, compose

DOCS = "doc_id long, text string"
WORDS = "word string, n long"


def one_edit(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def plain(counts):
    """``{word: (n, n_near, form, form_n, root)}``"""
    form, out = {}, {}
    for word, n in counts.items():
        near = sorted((-counts[o], o) for o in counts if one_edit(word, o))
        if near and -near[0][0] >= 2 * n:
            form[word] = near[0][1]
        out[word] = len(near)
    found = {}
    for word, n in counts.items():
        root = word
        while root in form:
            root = form[root]
        found[word] = (n, out[word], form.get(word), counts.get(form.get(word)), root)
    return found


def got(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def some_words(seed, size, alphabet, lengths, start=""):
    rng = random.Random(seed)
    words = {}
    while len(words) < size:
        word = start + "".join(rng.choice(alphabet) for _ in range(rng.choice(lengths)))
        words[word] = int(3 + rng.paretovariate(0.5) % 10**6)
    return words


@pytest.mark.parametrize("work", [spelling.WORK, 200, 1])
def test_same_as_comparing_all_words(spark, work):
    """Also with parts that are dealt again and again, down to single code points."""
    words = some_words(1, 500, "abc", [5, 6, 7, 8]) | some_words(2, 200, "abé", [2, 3, 4, 5], "commonstart")
    words |= {"w" * n: n for n in range(5, 40)} | {"v" * 3000 + "x": 5, "v" * 3001: 11, "v" * 3000: 100, "u" + "v" * 3000: 4}
    df = spark.createDataFrame(list(words.items()), WORDS).repartition(5)
    want = plain(words)
    assert got(spelling.variants(df, work=work)) == want
    assert any(root != form and form for _, _, form, _, root in want.values())


def test_composition_accepts_each_pair_once_and_acceptors_are_minimal():
    for seed in range(40):
        words = sorted(some_words(seed, 60, "ab" if seed % 2 else "abcdé", [1, 2, 3, 4, 5]))
        if seed % 3 == 0:
            words.append("")
        acceptor = Acceptor(words)
        pairs = Counter(compose(acceptor))
        assert set(pairs) == {(x, y) for x in words for y in words if one_edit(x, y)}
        assert max(pairs.values(), default=1) == 1

        def remainders(prefix):
            return frozenset(w[len(prefix) :] for w in words if w.startswith(prefix))

        reached, todo = set(), [0]
        while todo:
            state = todo.pop()
            if state not in reached:
                reached.add(state)
                todo += acceptor.steps[state].values()
        prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
        assert len(reached) == len({remainders(p) for p in prefixes})


def plain_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_words_of_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(None, "École ÉCOLE École"), (7, None), (8, ""), (9, "Straße naïve×x÷ " * 3), (9, "y" * 100_000)] * 2
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], DOCS + ", n int, word string").repartition(6)
    found = {r["word"]: r["n"] for r in spelling.vocabulary(df).collect()}
    assert found == plain_counts(rows)
    assert "École".translate({c: c + 32 for c in range(65, 91)}) in found and "naïve×x÷" in found


def test_edge_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert spelling.variants(spelling.vocabulary(none)).count() == 0
    lone = spark.createDataFrame([("alone", 5)], WORDS)
    assert got(spelling.variants(lone)) == {"alone": (5, 0, None, None, "alone")}
    ties = spark.createDataFrame([("words", 2), ("wordz", 4), ("worda", 4), ("éwords", 4)], WORDS)
    assert got(spelling.variants(ties))["words"] == (2, 3, "worda", 4, "worda")
    with pytest.raises(ValueError):
        spelling.variants(lone, min_chars=2)

"""Operators that compare documents, against brute force on small fixtures."""

import hashlib
import random
import time
import re

import duckdb
import numpy as np
import pytest
import xxhash

from blotter.llm import decontaminate, simhash, substring_dedup
from blotter.llm.components import connected_components
from blotter.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def documents(sf_dir):
    found = duckdb.connect().execute(f"select doc_id, text from '{sf_dir}/documents.parquet'")
    return found.fetchall()


def near_texts(groups=12, copies=6, length=220):
    rng = random.Random(7)
    texts = []
    for _ in range(groups):
        base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(length)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(length)] = "changed"
            texts.append(" ".join(own))
    return texts


# --- SimHash ---------------------------------------------------------------------


def slow_fingerprint(text):
    low = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    size = min(3, len(low))
    shingles = [" ".join(low[i : i + size]) for i in range(len(low) - size + 1)] if low else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, prints):
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, _ in rows:
        for b, _ in rows:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


@pytest.mark.parametrize("group", [2048, 3])
def test_simhash_links_all_within_three_bits(spark, group):
    texts = [*near_texts(), None, "", "  \t\n", "one two", "One two", "one two"]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.near_duplicates(simhash.fingerprints(docs), group=group).collect()
    prints = {i: slow_fingerprint(t) for i, t in rows}
    assert {r["doc_id"]: r["bits"] % 2**64 for r in found} == prints
    components = slow_components(rows, prints)
    assert {r["doc_id"]: r["component_id"] for r in found} == components
    assert len(set(prints.values())) > len(set(components.values())) > 12


def test_simhash_query_on_the_given_table(spark, sf_dir):
    rows = documents(sf_dir)
    prints = {i: slow_fingerprint(t) for i, t in rows}
    found = {r["doc_id"]: r for r in QUERIES["op5_simhash_near_dedup"](spark, sf_dir).collect()}
    assert {i: r["fingerprint"] for i, r in found.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in found.items()} == slow_components(rows, prints)


def test_golay_code_is_perfect_and_keys_miss_no_pair():
    counts = np.bincount(simhash.golay_decoder().astype(np.int64) & 0xFFF, minlength=4096)
    assert (counts == 2048).all()
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False).tolist():
            b[i] ^= np.uint64(1 << bit)
    (rows_a, keys_a), (rows_b, keys_b) = simhash.golay_keys(a), simhash.golay_keys(b)
    for i in range(len(a)):
        assert np.intersect1d(keys_a[rows_a == i], keys_b[rows_b == i]).size


def test_simhash_edge_rows(spark):
    rows = [(None, "a b c"), (5, "a b c"), (2, "a b c"), (2, "a b c"), (None, None)]
    docs = spark.createDataFrame([(*r, "en", None, 1) for r in rows], DOCS).withColumnsRenamed(
        {"lang": "bits", "n_chars": "component_id"}
    )
    found = simhash.near_duplicates(simhash.fingerprints(docs))
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in found.collect())
    assert got == [("2", "2"), ("2", "2"), ("5", "2"), ("None", "None"), ("None", "None")]
    kept = simhash.keep_first(docs, found)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "None", "None"]
    empty = simhash.near_duplicates(simhash.fingerprints(docs.limit(0)))
    assert empty.columns == ["doc_id", "tag", "bits", "component_id", "first_tag"] and empty.count() == 0
    assert simhash.keep_first(docs.limit(0), empty).count() == 0


def test_different_texts_of_one_identifier_are_different_documents(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    rows = [(1, one), (1, two), (1, two), (2, one), (3, two), (4, None), (4, "z"), (0, "z")]
    docs = spark.createDataFrame([(*r, "a", "b", 7) for r in rows], DOCS).withColumnsRenamed({"lang": "_tag", "source": "tag"})
    found = simhash.near_duplicates(simhash.fingerprints(docs))
    kept = simhash.keep_first(docs, found)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(0, "z"), (1, one), (1, two), (4, None)], key=str)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7), (101, 100), (205, 203)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {
        **{i: 0 for i in range(61)}, 100: 100, 101: 100, 203: 203, 205: 203,
    }


# --- substring deduplication ------------------------------------------------------


def slow_repeats(rows, length):
    windows = {}
    for doc_id, text in rows:
        own = words(text)
        for i in range(len(own) - length + 1):
            key = tuple(own[i : i + length])
            windows[key] = min(windows.get(key, doc_id), doc_id)
    out = {}
    for doc_id, text in rows:
        own, gone = words(text), set()
        for i in range(len(own) - length + 1):
            if windows[tuple(own[i : i + length])] < doc_id:
                gone.update(range(i, i + length))
        kept = " ".join(w for i, w in enumerate(own) if i not in gone)
        out[doc_id] = (len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 3, 0])
@pytest.mark.parametrize("length, seed", [(13, 5), (4, 2), (3, 3)])
def test_repeated_windows_are_removed(spark, length, seed, hot):
    rng = random.Random(5)
    passages = [[rng.choice("abcdefghijklmnop") * 2 for _ in range(rng.randrange(8, 40))] for _ in range(6)]
    rows = [(i, t) for i, t in enumerate([None, "", "a b", "ha " * 50, "ha " * 70])]
    for i in range(5, 40):
        parts = [[f"w{rng.randrange(500)}" for _ in range(rng.randrange(30))], rng.choice(passages)]
        rows.append((i, "\t".join(sum(parts * rng.randrange(1, 3), []))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.remove_repeats(docs, length=length, seed=seed, hot=hot)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found.collect()}
    assert got == slow_repeats(rows, length)
    assert sum(x[1] for x in got.values()) > 100


def test_repeats_edge_rows(spark):
    line = " ".join(f"x{i}" for i in range(20))
    other = line.replace("x3", "y")
    rows = [(None, line), (4, line), (4, line), (9, line), (4, other), (9, None)]
    docs = spark.createDataFrame([(*r, "kept", "tag", 1) for r in rows], DOCS).withColumnsRenamed(
        {"lang": "kept", "source": "tag", "n_chars": "windows"}
    )
    got = substring_dedup.remove_repeats(docs)
    rows = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in got.collect())
    assert rows == [("4", 20, 0), ("4", 20, 0), ("4", 20, 0), ("9", 0, 0), ("9", 20, 20), ("None", 20, 0)]
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


# --- decontamination --------------------------------------------------------------


@pytest.fixture(scope="module")
def items():
    rng = random.Random(11)
    syllables = [a + b for a in "bdgklmnprst" for b in ("a", "en", "i", "or", "u")]
    phrase = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(n))
    return [phrase(n) for n in (30, 14, 20, 45)], phrase


def edited(text, edits, rng):
    chars = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(chars)), rng.randrange(3)
        if kind == 0:
            chars[at] = "z"
        elif kind == 1:
            chars.insert(at, "z")
        else:
            del chars[at]
    return "".join(chars)


def test_leaks_within_the_edit_budget_are_found(items):
    texts, phrase = items
    index = decontaminate.Index.build(list(range(len(texts))), texts)
    rng = random.Random(2)
    for i, text in enumerate(texts):
        normal = decontaminate.normal(text)
        for _ in range(40):
            at = rng.randrange(len(normal) - decontaminate.WINDOW + 1)
            passage = normal[at : at + decontaminate.WINDOW].strip()
            passage = edited(passage.ljust(decontaminate.WINDOW, "q"), 2, rng).strip()
            document = f"{phrase(40)}. {passage.upper()}! {phrase(60)}"
            assert i in [x["item_id"] for x in index.leaks(document)]
    for _ in range(20):
        assert index.leaks(phrase(400)) == []


def test_banded_alignment_counts_edits(items):
    """The fewest edits reported are those of a plain alignment of some window."""
    texts, phrase = items
    index = decontaminate.Index.build([0], [texts[0]])
    item = decontaminate.normal(texts[0])
    rng = random.Random(4)
    for edits in (0, 1, 3):
        document = decontaminate.normal(f"{phrase(5)} {edited(item, edits, rng)} {phrase(5)}")
        found = index.leaks(document)[0]
        least = min(
            plain_edits(item[s : s + decontaminate.WINDOW], document)
            for s in range(len(item) - decontaminate.WINDOW + 1)
        )
        assert least <= found["edits"] <= edits and found["windows"] > 0
        assert item[80:100] in document[found["start"] : found["end"]] or edits


def plain_edits(window, text):
    """Fewest edits that turn the window into any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(window, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_leaks_query_finds_all_verbatim_passages(spark, sf_dir):
    con = duckdb.connect()
    benchmark = con.execute(f"select item_id, text from '{sf_dir}/benchmark.parquet'").fetchall()
    found = {(r["doc_id"], r["item_id"]) for r in QUERIES["op2_decontamination"](spark, sf_dir).collect()}
    normal = decontaminate.normal
    want = {(d, i) for d, t in documents(sf_dir) for i, x in benchmark if normal(x) in normal(t)}
    assert want and want <= found


def test_leaks_edge_rows(spark, items):
    texts, phrase = items
    long_text = phrase(9000) + " " + texts[2] + " " + phrase(20)
    rows = [(1, None), (2, ""), (None, texts[0]), (3, texts[1]), (3, texts[1]), (4, long_text)]
    docs = spark.createDataFrame([(*r, "x", "y", 0) for r in rows], DOCS).withColumnsRenamed(
        {"lang": "item_id", "source": "edits"}
    )
    benchmark = spark.createDataFrame(
        [(0, texts[0]), (1, texts[1]), (1, texts[1]), (None, texts[2]), (5, None), (6, "short")],
        "item_id long, text string",
    )
    found = decontaminate.find_leaks(docs, benchmark)
    got = sorted((str(r["doc_id"]), str(r["item_id"])) for r in found.collect())
    assert got == [("3", "1")] * 4 + [("4", "None"), ("None", "0")]
    assert sorted(r["doc_id"] for r in decontaminate.remove_leaks(docs, benchmark).collect()) == [1, 2]
    assert decontaminate.remove_leaks(docs, benchmark).columns == docs.columns
    assert decontaminate.find_leaks(docs.limit(0), benchmark).count() == 0
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0
    assert len(list(decontaminate.leak_columns(benchmark, block=100))) > 2
    whole, parts = (sorted(map(str, decontaminate.find_leaks(docs, benchmark, block=b).collect())) for b in (10**6, 100))
    assert whole == parts and whole
    kept = decontaminate.remove_leaks(docs, benchmark, block=100)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


def test_repetitive_text_costs_no_more_than_other_text():
    """A million equal letters and rows of numbers against items of thousands of them."""
    index = decontaminate.Index.build([1, 2, 3], ["a" * 5000, "0 " * 2500, "12 7 " * 900 + "end of table"])
    for text, items in (("A" * 1_000_000, {1}), ("0 " * 400_000, {2}), ("12 7 " * 100_000, {3}), ("0 1 " * 100_000, set())):
        began = time.process_time()
        assert {x["item_id"] for x in index.leaks(text)} == items
        assert time.process_time() - began < 8
    found = index.leaks("b " * 5000 + "a" * 9000)[0]
    assert (found["item_id"], found["windows"], found["edits"]) == (1, 1, 0)
    assert found["start"] < 10_000 + 60 and found["end"] >= 19_000 - 5


def test_finds_are_exactly_those_of_plain_alignment():
    """Few letters, so chance matches, repeats and near misses are common."""
    rng = random.Random(9)
    for _ in range(12):
        letters = rng.choice(["ab", "abc ", "a b"])
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(8, 90))) for _ in range(4)]
        index = decontaminate.Index.build(list(range(4)), texts)
        source = decontaminate.normal(rng.choice(texts))
        at = rng.randrange(max(1, len(source) - 60))
        text = "".join(rng.choice(letters) for _ in range(80)) + edited(source[at : at + 70], rng.randrange(7), rng) + "ab" * 9
        document, want = decontaminate.normal(text), set()
        for i, item in enumerate(map(decontaminate.normal, texts)):
            width = min(decontaminate.WINDOW, len(item))
            budget = min(width * decontaminate.EDITS // decontaminate.WINDOW, (width - decontaminate.Q) // decontaminate.Q)
            if len(item) >= decontaminate.Q and any(
                plain_edits(item[s : s + width], document) <= budget for s in range(len(item) - width + 1)
            ):
                want.add(i)
        assert {x["item_id"] for x in index.leaks(text)} == want


def test_pieces_of_very_long_texts_overlap(monkeypatch, items):
    texts, phrase = items
    monkeypatch.setattr(decontaminate, "PIECE", 400)
    index = decontaminate.Index.build([7], [texts[0]])
    for lead in range(0, 60, 7):
        assert [x["item_id"] for x in index.leaks(phrase(50 + lead) + " " + texts[0] + " " + phrase(90))] == [7]

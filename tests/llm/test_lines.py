"""Line deduplication against a plain version, and the bitmaps behind it."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blotter.llm import bits, line_dedup

DOCS = "doc_id long, text string"
WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_documents, min_chars=1, keep_first=False):
    """Sorted ``(doc_id, n_lines, n_dropped, kept)`` by counting every line in memory."""
    parts = [[(line, line.strip(WHITE).translate(LOWER)) for line in (t or "").split("\n")] for _, t in rows]
    documents, first = {}, {}
    for place, ((doc_id, text), lines) in enumerate(zip(rows, parts)):
        for key in {k for _, k in lines}:
            documents[key] = documents.get(key, 0) + 1
        for i, (_, key) in enumerate(lines):
            at = (doc_id is None, doc_id or 0, i)
            first[key] = min(first.get(key, at), at)
    out = []
    for (doc_id, _), lines in zip(rows, parts):
        kept = [
            line
            for i, (line, key) in enumerate(lines)
            if documents[key] < min_documents
            or len(key) < min_chars
            or (keep_first and first[key] == (doc_id is None, doc_id or 0, i))
        ]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def found(df):
    rows = df.collect()
    for r in rows:
        assert r["kept_sha256"] == hashlib.sha256(r["kept"].encode()).hexdigest()
    return sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in rows], key=str)


def some_rows(seed):
    rng = random.Random(seed)
    common = [" Share  this ", "share  THIS", "\tÀ Propos", "à propos", "x", "", " ", "long " * 400, "é", "É"]
    return [
        (i, "\n".join(rng.choice(common) if rng.random() < 0.5 else f"own {rng.randrange(300)}" for _ in range(rng.randrange(1, 9))))
        for i in range(150)
    ]


@pytest.mark.parametrize("held", [line_dedup.HELD, 0])
@pytest.mark.parametrize("options", [{}, {"min_documents": 2}, {"min_documents": 3, "min_chars": 2}, {"min_chars": 0}])
def test_same_as_counting_in_memory(spark, options, held):
    rows = some_rows(1)
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    want = plain(rows, options.get("min_documents", 10), options.get("min_chars", 1))
    assert found(line_dedup.remove_lines(df, held=held, **options)) == want
    assert any(n for _, _, n, _ in want)


@pytest.mark.parametrize("held", [line_dedup.HELD, 0])
def test_first_occurrence_stays(spark, held):
    rows = some_rows(2)
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = found(line_dedup.remove_lines(df, min_documents=2, keep_first=True, held=held))
    assert got == plain(rows, 2, keep_first=True)
    assert got != plain(rows, 2)


def test_a_full_filter_changes_no_result(spark):
    """64 bits for thousands of lines: every line is suspected, none is wrongly dropped."""
    rows = [(i, f"line {i}\nshared") for i in range(3000)]
    df = spark.createDataFrame(rows, DOCS)
    got = found(line_dedup.remove_lines(df, most_bits=64))
    assert got == plain(rows, 10) and {n for _, _, n, _ in got} == {1}


@pytest.mark.parametrize("held", [line_dedup.HELD, 0])
def test_line_edge_rows(spark, held):
    rows = [(1, None), (None, "a\nb"), (None, "a\nb"), (2, ""), (2, "a"), (2, "a"), (3, "\n\n"), (4, "z" * 300_000 + "\na"), (5, "A ")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], DOCS + ", tag int, key string")
    assert found(line_dedup.remove_lines(df, min_documents=3, held=held)) == plain(rows, 3)
    assert found(line_dedup.remove_lines(df, min_documents=2, min_chars=0, held=held)) == plain(rows, 2, 0)
    assert line_dedup.remove_lines(df.limit(0), held=held).count() == 0
    with pytest.raises(ValueError):
        line_dedup.remove_lines(df, min_documents=1)


def test_bitmaps_forget_nothing_and_tell_second_sights(spark):
    hashes = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    some = bits.bitmap_of(hashes.filter("h % 3 = 0"), 7000)
    every = np.array([r["h"] for r in hashes.collect()])
    inside = every[every % 3 == 0]  # of either sign: numpy's remainder is zero where Spark's is
    assert some.has(inside).all()
    outside = every[every % 3 != 0]
    assert some.has(outside).mean() < 0.02
    words = bits.words_for(20_000)
    seen = bits.Gathered(words)
    (batch,) = [*seen.add(every), *seen.add(every[:500]), *seen.rows()]
    rows = spark.createDataFrame(pa.Table.from_batches([batch]))
    twice = bits.Bitmap(bits.merged(rows.repartition(3), words), "twice", words)
    assert twice.has(every[:500]).all() and twice.has(every[500:]).mean() < 0.02

"""Nearest neighbours, mixing, and the pipeline."""

import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from blotter.llm import ann, decontaminate, mixing, pii
from blotter.llm.queries import QUERIES
from blotter.sources.shared import shared_root
from tests.llm.test_pairs_and_spans import DOCS as DOCUMENTS
from tests.llm.test_pairs_and_spans import slow_components, slow_fingerprint

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    """``{query: [(vec_id, distance)]}`` over usable rows, exact."""
    good = {
        i: np.array(v, dtype=np.float32).astype(float)
        for i, v in rows
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)
    }
    out = {}
    for q in (i for i in good if i % 100 == 0):
        same = [i for i in good if i != q and len(good[i]) == len(good[q])]
        ranked = sorted((float(np.sqrt(((good[i] - good[q]) ** 2).sum())), i) for i in same)
        out[q] = [(i, d) for d, i in ranked[:k]]
    return out


@pytest.mark.parametrize("block", [16_384, 700])
def test_recall_and_exact_scores(spark, block):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((3000, 24)))]
    df = spark.createDataFrame([(*r, 0) for r in rows], VECTORS)
    found = ann.nearest(df, F.col("vec_id") % 100 == 0, block=block, query_block=11).collect()
    want = brute(rows, 10)
    hits = sum((r["vec_id"], r["score"]) in want[r["query_id"]] for r in found)
    assert hits >= 0.9 * sum(map(len, want.values())) and len(found) == 300


def test_recall_on_the_given_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute(rows, 10)
    found = QUERIES["op6_ann_search"](spark, sf_dir).collect()
    hits = sum(r["vec_id"] in [i for i, _ in want[r["query_id"]]] for r in found)
    assert hits >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize(("dimension", "norm"), [(64, 1.0), (64, 0.05), (128, 1.0), (384, 1.0)])
def test_recall_whatever_the_dimension_and_norms(dimension, norm):
    rng = np.random.default_rng(6)
    points = rng.standard_normal((6000, dimension))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    points[::3] *= norm
    ids, queries = np.arange(6000), np.arange(1, 6000, 300)
    table = lambda rows, **more: pa.table({"vec_id": rows, "vector": list(points[rows]), **more})
    bounds = ann._bounds(table(queries), table(ids), 10)
    limits = {name: bounds[name].to_numpy() for name in ("bound", "reach")}
    found = ann._search(table(queries, **limits), table(ids), 10).to_pydict()
    hits = 0
    for q in queries:
        exact = np.linalg.norm(points - points[q], axis=1)
        exact[q] = np.inf
        got = [i for i, own in zip(found["vec_id"], found["query_id"]) if own == q]
        assert len(got) == 10 and q not in got
        hits += len(set(np.argsort(exact)[:10]) & set(got))
    assert hits >= 0.95 * 10 * len(queries)


@pytest.mark.parametrize("size", [1.5e308, 1e160, 1e-160, 1e-320, 1.0])
def test_any_finite_size_of_components_ends_and_is_exact(spark, size):
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 8)))]
    rows[5] = (5, (np.sign(rng.standard_normal(8)) * size).tolist())
    rows[100] = (100, (np.sign(rng.standard_normal(8)) * size).tolist())
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    found = ann.nearest(df, F.col("vec_id") % 100 == 0, block=150).orderBy("query_id", "rank").collect()
    points = {i: np.array(v) for i, v in rows}
    for q in (0, 100, 200):
        with np.errstate(over="ignore"):
            ranked = sorted((float(np.sqrt(((points[i] - points[q]) ** 2).sum())), i) for i in points if i != q)
        assert [(r["score"], r["vec_id"]) for r in found if r["query_id"] == q] == ranked[:10]


def test_a_very_common_vector(spark):
    """Hundreds of copies of one vector, which is asked for too: ties go to the smaller identifiers."""
    rng = np.random.default_rng(8)
    common = rng.standard_normal(16).tolist()
    rows = [(i, common if i % 3 == 0 else rng.standard_normal(16).tolist(), 0) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = ann.nearest(df, F.col("vec_id") == 300, block=200).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(3 * i, 0.0) for i in range(10)]


def test_search_edge_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.0]), (5, [1.0, 0.0]), (3, [1.0, 0.0]), (8, [0.0, 2.0]), (8, [0.0, 2.0]), (8, [0.0, 3.0]),
        (9, None), (10, []), (11, [0.0, 0.0]), (12, [1.0, None]), (13, [inf, 1.0]), (14, [nan, 1.0]),
        (None, [1.0, 1.0]), (15, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 4.0]), (200, [0.0, 0.0]), (-100, [2.0, 0.0]),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], VECTORS).withColumn("score", F.lit(1))
    found = ann.nearest(df, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {-100: [0, 3, 5, 8], 0: [3, 5, -100, 8], 100: [15]}
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


# --- mixing ------------------------------------------------------------------------


def level(sizes, weights, repeats):
    """Targets by plain resharing until nothing is above."""
    total, open_, out = sum(sizes), set(range(len(sizes))), {}
    while open_:
        left = total - sum(out.values())
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        above = [i for i in open_ if share[i] > repeats * sizes[i]]
        if not above:
            return out | share
        for i in above:
            out[i] = repeats * sizes[i]
            open_.remove(i)
    return out


def test_targets_are_those_of_resharing(spark):
    rng = random.Random(3)
    for _ in range(4):
        names = sorted(rng.sample("abcdefghijklmnopqrstuvwxyz", 9)) + [None]
        sizes = [rng.choice([0, 1, 5, 50, 700, 3000]) for _ in names]
        rows = [(i, 0, n, s) for i, (n, s) in enumerate(zip(names, sizes))]
        sized = spark.createDataFrame(rows, "doc_id long, tag long, source string, size long")
        found = {r["source"]: r["target"] for r in mixing.source_targets(sized, (5, 2, 1)).collect()}
        want = level(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
        assert found == pytest.approx({n: want[i] for i, n in enumerate(names)})


def test_mix_is_near_its_targets_and_repeats(spark):
    rng = random.Random(2)
    rows = [(i, i, f"s{min(rng.randrange(8), 5)}", rng.randrange(1, 400)) for i in range(6000)]
    schema = "doc_id long, tag long, source string, size long"
    first = mixing.mix(spark.createDataFrame(rows, schema)).collect()
    again = mixing.mix(spark.createDataFrame(rows[::-1], schema).repartition(5)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(first) == len(rows)
    taken, target = {}, {}
    for r in first:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
    for source in target:
        assert taken[source] == pytest.approx(target[source], abs=200.5)
    assert {r["copies"] for r in first if r["source"] == "s2"} >= {0, 1}


def plain_mix(rows, weights, by_odds=True):
    """``{doc_id: copies}`` of the method, source by source in memory."""
    names = sorted({r[2] for r in rows}, key=lambda n: (n is None, n))
    sizes = [sum(r[3] for r in rows if r[2] == n) for n in names]
    targets = level(sizes, [weights[i % len(weights)] for i in range(len(names))], 3)
    out = {}
    for i, name in enumerate(names):
        own = [r for r in rows if r[2] == name]
        rate = targets[i] / sizes[i] if sizes[i] else 0.0
        lengths = {r[0]: len(f"{r[3]:b}") for r in own}
        mean = sum(r[3] * lengths[r[0]] for r in own) / sizes[i] if sizes[i] else 0.0
        spread = max(max(lengths.values()) - mean, mean - min(lengths.values()))
        room = min(1.0, (3 / rate if rate else 1.0) - 1.0)
        often = {d: max(0.0, rate * (1 + mixing.TILT * room * ((g - mean) / spread if spread else 0.0))) for d, g in lengths.items()}
        left = targets[i] - sum(int(often[r[0]]) * r[3] for r in own)

        def rank(r):
            p = often[r[0]] % 1
            u = (int(hashlib.md5(f"{mixing.SEED}:{r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52
            return (-1.0 if not p else (u / (1 - u)) / (p / (1 - p)) if by_odds else u, r[0])

        below = 0
        for r in sorted(own, key=rank):
            more = often[r[0]] % 1 > 0 and below + r[3] / 2 <= left
            out[r[0]] = int(often[r[0]]) + more
            below += r[3]
    return out


def test_mix_is_pareto_sampling_with_unequal_chances(spark):
    """As in memory; ranking by the random numbers alone takes other documents."""
    rng = random.Random(4)
    rows = [(i, i, rng.choice(["a", "a", "a", "b", "c", "d", None]), int(rng.paretovariate(0.6)) % 5000) for i in range(3000)]
    sized = spark.createDataFrame(rows, "doc_id long, tag long, source string, size long").repartition(7)
    found = {r["doc_id"]: r for r in mixing.mix(sized).collect()}
    want = plain_mix(rows, (5, 2, 1))
    assert {d: r["copies"] for d, r in found.items()} == want
    assert plain_mix(rows, (5, 2, 1), by_odds=False) != want
    chances = {r["doc_id"]: (r["source"], r["p"]) for r in mixing.rated_rows(sized, (5, 2, 1), 3, mixing.SEED, 8).collect()}
    assert len({p for s, p in chances.values() if s == "a"}) > 5
    halves = [[found[r[0]]["copies"] for r in rows if r[2] == "a" and (r[3] > 50) == long] for long in (True, False)]
    assert sum(halves[0]) / len(halves[0]) > sum(halves[1]) / len(halves[1])


def test_ranges_are_even_when_a_target_is_near_a_multiple(spark):
    """And when two thirds of all rows are equal: no task gets more than a few shares."""
    rows = ("IF(id % 3 = 0, id, 7L) AS doc_id", "7L AS tag", "concat('s', CAST(id < 20 AS int)) AS source", "10L AS size")
    sized = spark.range(16000).selectExpr(*rows)
    for weights in ((1.0001, 0.9999), (1, 1)):
        mixed = mixing.mix(sized, weights)
        assert mixed.count() == 16000
        taken = mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("x")).collect()
        assert all(abs(r["t"] - r["x"]) <= 10 for r in taken)
    rated = mixing.rated_rows(sized.withColumn("copy", F.monotonically_increasing_id()), (1, 1), 3, 1, 8)
    ranged = rated.repartitionByRange(16, "source", "rank", "doc_id", "size", "tag", "copy")
    counts = [r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect()]
    assert max(counts) < 3 * 16000 / 16


def test_mixed_documents_with_columns_of_the_same_names(spark):
    docs = spark.createDataFrame([(1, "x y", "a", 9, 9, "t", "u")], "doc_id long, text string, source string, copies int, taken int, tag string, _tag string")
    row = mixing.mixed_documents(docs, mixing.mix(mixing.measure(docs))).first()
    assert row.asDict() == {"doc_id": 1, "text": "x y", "source": "a", "tag": "t", "_tag": "u", "copies": 1, "taken": 2}


def test_mix_edge_rows(spark, plan, sf_dir):
    rows = [(1, None, None), (2, "", "a"), (None, "x y", "a"), (None, "x y", "a"), (3, "x " * 9, None), (3, "z", "é")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, taken int")
    mixed = mixing.mix(mixing.measure(docs))
    assert mixed.count() == 6
    kept = mixing.mixed_documents(docs, mixed)
    assert kept.columns == ["doc_id", "text", "source", "copies", "taken"]
    assert mixing.mix(mixing.measure(docs.limit(0))).count() == 0
    assert not re.search("Python|Pandas|Arrow", plan(QUERIES["op8_source_mixing"](spark, sf_dir)))


# --- pipeline ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Per stage its input and its output, on the given table."""
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.staged(stage(spark, docs, sf_dir), name)
        seen[name] = (docs, after)
        docs = after
    return seen


def test_all_but_the_last_stage_keep_the_columns(spark, sf_dir, stages):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    for name, (_, after) in stages.items():
        assert after.columns == columns + (["copies", "taken"] if name == "mixing" else [])


def test_toxicity_stage_follows_scores_and_labels(spark, sf_dir, stages):
    given, clean = stages["toxicity"]
    scores = {r["doc_id"]: r["score"] for r in QUERIES["op9_toxicity"](spark, sf_dir).collect()}
    kept = {r["doc_id"] for r in clean.collect()}
    assert kept == {i for i, score in scores.items() if score < 0.7}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").join(given, "doc_id").collect()
    toxic, fine = ({r["doc_id"] for r in labels if r["toxic"] == x} for x in (1, 0))
    assert len(toxic & kept) <= 0.5 * len(toxic) and len(fine & kept) >= 0.95 * len(fine)


def test_near_duplicate_stage_keeps_the_first_of_each_plain_component(stages):
    given, clean = stages["near_duplicates"]
    rows = [(r["doc_id"], r["text"]) for r in given.collect()]
    components = slow_components(rows, {i: slow_fingerprint(t) for i, t in rows})
    assert {r["doc_id"] for r in clean.collect()} == set(components.values()) < set(components)


def test_decontamination_stage_drops_verbatim_passages_and_little_else(spark, sf_dir, stages):
    given, clean = stages["decontamination"]
    normal = decontaminate.normal
    items = [normal(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    verbatim = {r["doc_id"] for r in given.collect() if any(i in normal(r["text"]) for i in items)}
    gone = {r["doc_id"] for r in given.collect()} - {r["doc_id"] for r in clean.collect()}
    assert verbatim and verbatim <= gone and len(gone - verbatim) <= 0.02 * given.count()


def test_mixing_stage_is_the_plain_mix(stages):
    given, mixed = stages["mixing"]
    rows = [(r["doc_id"], 0, r["source"], len(re.findall(r"[^ \t-\r]+", r["text"] or ""))) for r in given.collect()]
    want = {i: c for i, c in plain_mix(rows, corpus_pipeline.MIX_WEIGHTS).items() if c}
    assert {r["doc_id"]: r["copies"] for r in mixed.collect()} == want


def test_run_is_its_stages_and_leaves_nothing_else_behind(spark, sf_dir, stages):
    shared = Path(shared_root(spark).removeprefix("file:"))
    names = [name for name, _ in corpus_pipeline.STAGES]
    left = lambda: {p.name for n in names for p in shared.rglob(f"{n}-*")}
    before = left()
    found = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, found.collect())) == sorted(map(str, stages["mixing"][1].collect()))
    assert len(left() - before) == 1  # the result's own


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_nulls_ties_empty_tables_and_any_extra_columns(spark, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    schema = DOCUMENTS + ", tag int, copies int, bits long, score double, component_id long, spans string"
    text = "some words that nobody repeats here"
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, None, None, None, None), (None, "x", "en", "a", 1), (None, None, None, "b", None), (3, "", "fr", "b", 0), (4, "long " * 60_000, "en", "a", 9)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 0.5, 4, "s") for r in rows], schema)
    after = stage(spark, docs, sf_dir)
    assert [c for c in after.columns if c not in ("copies", "taken")] == [c for c in docs.columns if c not in ("copies", "taken")]
    found = [r["doc_id"] for r in after.collect()]
    assert set(found) <= {1, 2, 3, 4, None}
    if name in ("toxicity", "decontamination", "personal_data"):
        assert len(found) == len(rows)
    if name == "near_duplicates":  # equal rows are one; the null and the empty text are alike
        assert sorted(map(str, found)) == ["1", "2", "4", "None", "None"]
    none = stage(spark, docs.limit(0), sf_dir)
    assert none.columns == after.columns and none.count() == 0


def test_personal_data_goes_and_documents_stay(stages):
    given, clean = stages["personal_data"]
    assert given.count() == clean.count()
    left = pii.find_spans(clean, pii.fit_classifier(clean)).selectExpr("sum(size(base))").first()[0]
    assert left == 0 and clean.filter("text like '%<EMAIL>%'").count() > 0
    assert clean.filter("n_chars <> length(text)").count() == 0

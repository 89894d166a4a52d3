import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from blotter.operators import clustering, features, pooled, scoring
from blotter.operators.cells import CenterGrid
from blotter.operators.features import STANDARDIZED, WEIGHT
from blotter.plans import (
    STUDIES,
    assign_gmm,
    assign_kmeans,
    domestic_in_homes,
    prepare_points,
    score_models,
    sweep,
    sweep_from_pool,
)
from blotter.plans.hotspots import GMM_RESTARTS, fit_models, partitions_for
from blotter.sources import shared_root
from checks.fixture import incident_table

COORDS = ["Latitude", "Longitude"]
SPOTS = [(41.7, -87.8), (41.9, -87.6), (41.8, -87.5)]


@pytest.fixture(scope="module")
def planted(spark):
    """Three far-apart spots; one place holds a third of all rows."""
    rng = random.Random(7)
    rows = [(*SPOTS[i % 3],) for i in range(300)]
    rows = [
        (i, lat + rng.gauss(0, 0.003), lon + rng.gauss(0, 0.003))
        for i, (lat, lon) in enumerate(rows)
    ]
    rows += [(300 + i, *SPOTS[0]) for i in range(150)]
    return spark.createDataFrame(rows, "ID int, Latitude double, Longitude double")


@pytest.fixture(scope="module")
def domestic(spark, sf_dir):
    return domestic_in_homes(incident_table(spark, sf_dir)).select("ID", *COORDS).persist()


def test_scale_of_weighted_points_is_that_of_the_rows(planted):
    scale = features.measure_scale(features.collapse_points(planted))
    scaler = features.fit_scaler(features.assemble_features(planted))
    assert scale.rows == 450 and scale.points == 301
    assert scale.stddev == pytest.approx(list(scaler.std), rel=1e-12)


def test_standardized_columns_equal_the_scaler(planted):
    assembled = features.assemble_features(planted)
    by_model = features.standardize_features(assembled, features.fit_scaler(assembled))
    scale = features.measure_scale(features.collapse_points(planted))
    both = features.standardize_columns(
        by_model.withColumnRenamed(STANDARDIZED, "expected"), scale
    ).select(vector_to_array("expected").alias("e"), vector_to_array(STANDARDIZED).alias("g"))
    for row in both.collect():
        assert row["g"] == pytest.approx(row["e"], rel=1e-12)


def test_constant_column_scales_to_zero(spark):
    flat = spark.createDataFrame(
        [(41.8, -87.0), (41.8, -87.5)], "Latitude double, Longitude double"
    )
    scale = features.measure_scale(features.collapse_points(flat))
    rows = features.standardize_columns(flat, scale).collect()
    assert all(r[STANDARDIZED][0] == 0.0 for r in rows)


def test_collapse_keeps_every_row(planted):
    points = features.collapse_points(planted)
    assert points.agg(F.sum(WEIGHT)).first()[0] == planted.count()
    assert points.agg(F.max(WEIGHT)).first()[0] == 150


def test_kmeans_finds_planted_spots(spark, planted):
    points = prepare_points(planted)
    model = fit_models(points, [3])[3]
    centers = clustering.kmeans_centers(model, points.frame, points.scale).collect()
    found = sorted((r["Latitude"], r["Longitude"]) for r in centers)
    for got, want in zip(found, sorted(SPOTS)):
        assert got == pytest.approx(want, abs=0.002)


def test_weighted_points_reach_the_cost_of_all_rows(planted):
    """Collapsing changes the work, not the optimum."""
    assembled = features.assemble_features(planted)
    rows = features.standardize_features(assembled, features.fit_scaler(assembled))
    full = clustering.fit_kmeans(rows, 3).summary.trainingCost
    cost = sweep(planted, [3]).first()["cost"]
    assert cost == pytest.approx(full, rel=1e-6)


def test_every_prediction_is_the_nearest_center(domestic):
    points = prepare_points(domestic)
    model = fit_models(points, [5])[5]
    scaled = features.standardize_columns(domestic, points.scale).withColumn(
        "v", vector_to_array(STANDARDIZED)
    )
    centers = [list(map(float, c)) for c in model.clusterCenters()]
    predicted = model.transform(scaled).withColumns(
        {"x": F.get("v", F.lit(0)), "y": F.get("v", F.lit(1))}
    )
    both = clustering.assign_nearest_center(predicted, ["x", "y"], centers, "nearest")
    assert both.filter(F.col("prediction_5") != F.col("nearest")).count() == 0


def test_nearest_center_takes_the_lowest_on_a_tie(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 0.0), (-3.0, 0.0)], "x double, y double")
    centers = [(1.0, 0.0), (-1.0, 0.0), (1.0, 0.0)]
    got = clustering.assign_nearest_center(df, ["x", "y"], centers).collect()
    assert [r["prediction"] for r in got] == [0, 0, 1]
    assert clustering.assign_nearest_center(df, ["x", "y"], centers[:1]).count() == 3


def test_cluster_sizes_sum_to_the_rows(planted):
    assigned = assign_kmeans(planted, 4)
    assert assigned.count() == planted.count()
    points = prepare_points(planted)
    model = fit_models(points, [4])[4]
    centers = clustering.kmeans_centers(model, points.frame, points.scale).collect()
    assert sum(r["size"] for r in centers) == planted.count()
    counted = {r["prediction"]: r["count"] for r in assigned.groupBy("prediction").count().collect()}
    assert counted == {r["cluster"]: r["size"] for r in centers}


def test_gmm_posterior_sums_to_one_and_peaks_at_the_prediction(domestic):
    assigned = assign_gmm(domestic, 3, max_iter=10)
    assert assigned.count() == domestic.count()
    for row in assigned.collect():
        p = list(row["probability"])
        assert sum(p) == pytest.approx(1.0, abs=1e-9)
        assert p[row["prediction"]] == max(p)


def test_gmm_finds_planted_spots(spark, planted):
    """EM from a random start may stop early; the likeliest of a few starts must not."""
    spread = planted.filter("ID < 300")
    points = prepare_points(spread)
    models = [fit_models(points, [3], "gmm", seed=seed)[3] for seed in range(6)]
    best = max(models, key=lambda m: m.summary.logLikelihood)
    means = clustering.gmm_components(spark, best, points.scale).collect()
    found = sorted((r["Latitude"], r["Longitude"]) for r in means)
    for got, want in zip(found, sorted(SPOTS)):
        assert got == pytest.approx(want, abs=0.01)
    assert sum(r["mixing_weight"] for r in means) == pytest.approx(1.0)


def test_restarts_keep_the_likeliest_mixture(planted):
    with prepare_points(planted) as points:
        alone = [fit_models(points, [3], "gmm", seed=20 + i)[3].summary.logLikelihood for i in range(GMM_RESTARTS)]
        best = fit_models(points, [3], "gmm", restarts=GMM_RESTARTS)[3]
        assert best.summary.logLikelihood == pytest.approx(max(alone), rel=1e-9)
        found = sorted(points.scale.unscaled(g.mean) for g in best.gaussians)
        with pytest.raises(ValueError):
            fit_models(points, [3], "kmeans", restarts=2)
    for got, want in zip(found, sorted(SPOTS)):
        assert got == pytest.approx(want, abs=0.01)


def test_pooled_sweep_costs_no_more_and_reads_the_incidents_once(spark, planted, domestic):
    for incidents in (planted, domestic):
        ks = [2, 3, 4, 6, 9]
        usual = {r["k"]: r for r in sweep(incidents, ks).collect()}
        found = {r["k"]: r for r in sweep_from_pool(incidents, ks).collect()}
        assert list(found) == ks
        for k in ks:
            assert found[k]["cost"] <= usual[k]["cost"] * 1.01 + 1e-9
    assert tuple(scoring.best_k(sweep_from_pool(planted, ks)).first())[0] == 3


def test_pooled_models_are_settled_and_weighted(planted):
    with prepare_points(planted) as points:
        models = pooled.fit_pooled(points.frame, points.centred, WEIGHT, [3, 1])
        rows = points.frame.select(*points.centred, WEIGHT).collect()
    data = np.array([tuple(r) for r in rows])
    xs, w = data[:, :2], data[:, 2]
    for k, model in models.items():
        centers = np.array(model.centers)
        squares = ((xs[:, None] - centers) ** 2).sum(axis=2)
        own = squares.argmin(axis=1)
        assert model.cost == pytest.approx(float((w * squares.min(axis=1)).sum()), rel=1e-9)
        for i in range(k):
            assert np.average(xs[own == i], axis=0, weights=w[own == i]) == pytest.approx(centers[i], abs=1e-4)


def test_pooled_fit_with_fewer_points_than_centers(spark):
    few = spark.createDataFrame([(41.8, -87.0), (41.9, -87.5)] * 3, "Latitude double, Longitude double")
    assert [r["cost"] for r in sweep_from_pool(few, [2, 5]).collect()] == pytest.approx([0, 0], abs=1e-12)


def test_moments_merge_exactly_around_a_large_mean(spark):
    rng = random.Random(1)
    values = [(1e9 + rng.gauss(0, 1.0), rng.uniform(-1, 1), rng.randrange(1, 6), i % 7) for i in range(4000)]
    df = spark.createDataFrame(values, "a double, b double, weight int, file int")
    copies = np.repeat(np.array([v[:2] for v in values]), [v[2] for v in values], axis=0)
    whole = features.column_moments(df, ["a", "b"], "weight")
    per_file = features.column_moments(df, ["a", "b"], "weight", by=["file"])
    kept, added = per_file.filter("file < 5"), per_file.filter("file >= 5")
    merged = features.merge_moments(kept.unionByName(added), ["a", "b"])
    for moments in (whole, merged):
        row = moments.select("rows", "points", "mean_a", *features.moments_stddev(moments, ["a", "b"])).first()
        assert (row["rows"], row["points"]) == (len(copies), 4000)
        assert row["mean_a"] == pytest.approx(copies[:, 0].mean(), abs=1e-6)
        assert row["a"] == pytest.approx(copies[:, 0].std(ddof=1), abs=1e-6)
        assert row["b"] == pytest.approx(copies[:, 1].std(ddof=1), abs=1e-6)
    none = features.column_moments(df.limit(0), ["a"])
    assert none.select("rows", *features.moments_stddev(none, ["a"])).first() == (0.0, None)


def test_scale_reads_the_points_once(planted, plan):
    moments = features.column_moments(features.collapse_points(planted), COORDS, WEIGHT)
    assert plan(moments).count("Scan ExistingRDD") <= 2  # named once in the tree and once in the list


def test_same_seed_same_clusters_however_the_input_is_split(domestic):
    once = sweep(domestic, [4], seed=5).first()
    again = sweep(domestic.repartition(7), [4], seed=5).first()
    assert again["cost"] == pytest.approx(once["cost"], rel=1e-9)


def test_more_clusters_than_points_gives_fewer_centers(spark):
    five = spark.createDataFrame(
        [(float(i), float(i * i)) for i in range(5)], "Latitude double, Longitude double"
    )
    points = prepare_points(five)
    assert len(fit_models(points, [30])[30].clusterCenters()) == 5
    two = five.limit(2)
    assert sweep(two, [2]).first()["silhouette"] == 0.0


@pytest.mark.parametrize("rows", [[], [(41.8, -87.6)], [(41.8, -87.6)] * 4])
def test_fewer_than_two_points_is_refused(spark, rows):
    df = spark.createDataFrame(rows, "Latitude double, Longitude double")
    with pytest.raises(ValueError, match="2 distinct points"):
        sweep(df, [2])


def test_sweep_and_best_k(planted):
    scores = sweep(planted, [2, 3, 4, 5])
    rows = scores.orderBy("k").collect()
    assert [r["k"] for r in rows] == [2, 3, 4, 5]
    costs = [r["cost"] for r in rows]
    assert costs == sorted(costs, reverse=True)
    assert scoring.best_k(scores).first()["k"] == 3


def test_best_k_breaks_ties_low_and_ignores_missing_scores(spark):
    scores = spark.createDataFrame(
        [(3, 0.5), (4, None), (5, 0.7), (6, 0.7)], "k int, silhouette double"
    )
    assert tuple(scoring.best_k(scores).first()) == (5, 0.7)


# --- silhouette -------------------------------------------------------------------


def brute_force_silhouette(rows):
    """All pairs, by definition. ``rows`` are (x, y, label)."""
    total = 0.0
    for i, (x, y, label) in enumerate(rows):
        distances = {}
        for j, (u, v, other) in enumerate(rows):
            if i != j:
                distances.setdefault(other, []).append((x - u) ** 2 + (y - v) ** 2)
        if label not in distances:
            continue
        a = sum(distances[label]) / len(distances[label])
        b = min(sum(d) / len(d) for other, d in distances.items() if other != label)
        total += 0.0 if a == b else (b - a) / max(a, b)
    return total / len(rows)


@pytest.fixture(scope="module")
def labelled_rows():
    rng = random.Random(3)
    rows = [(rng.gauss(c, 1.0), rng.gauss(-c, 2.0), c) for c in range(4) for _ in range(25)]
    rows += [(9.0, 9.0, 7)]  # alone in its cluster
    rows += [(0.5, 0.5, 0)] * 20  # copies of one point
    return rows


def test_silhouette_is_its_definition(spark, labelled_rows):
    df = spark.createDataFrame(labelled_rows, "x double, y double, label int")
    got = scoring.silhouette_scores(df, ["x", "y"], ["label"]).first()
    assert got["clusters"] == 5
    assert got["silhouette"] == pytest.approx(brute_force_silhouette(labelled_rows), abs=1e-9)


def test_weighted_silhouette_counts_copies_as_neighbours(spark, labelled_rows):
    df = spark.createDataFrame(labelled_rows, "x double, y double, label int")
    points = df.groupBy("x", "y", "label").agg(F.count("*").alias("weight"))
    got = scoring.silhouette_scores(points, ["x", "y"], ["label"], "weight").first()
    assert got["silhouette"] == pytest.approx(brute_force_silhouette(labelled_rows), abs=1e-9)


def test_silhouette_is_that_of_the_evaluator(spark, labelled_rows):
    df = spark.createDataFrame(labelled_rows, "x double, y double, label int").withColumns(
        {"v": array_to_vector(F.array("x", "y")), "prediction": F.col("label")}
    )
    evaluator = ClusteringEvaluator(
        featuresCol="v", metricName="silhouette", distanceMeasure="squaredEuclidean"
    )
    got = scoring.silhouette_scores(df, ["x", "y"], ["label"]).first()["silhouette"]
    assert got == pytest.approx(evaluator.evaluate(df), abs=1e-9)


def test_all_labellings_in_one_call(spark, labelled_rows):
    df = spark.createDataFrame(labelled_rows, "x double, y double, label int").withColumns(
        {"half": (F.col("x") > 1).cast("int"), "one": F.lit(4)}
    )
    rows = {
        r["labelling"]: r
        for r in scoring.silhouette_scores(df, ["x", "y"], ["label", "half", "one"]).collect()
    }
    halves = [(x, y, int(x > 1)) for x, y, _ in labelled_rows]
    assert rows["half"]["silhouette"] == pytest.approx(brute_force_silhouette(halves), abs=1e-9)
    assert rows["one"]["silhouette"] is None and rows["one"]["clusters"] == 1


@pytest.mark.parametrize("most_constant", [scoring.CONSTANT, 0])
@pytest.mark.parametrize("gap", [1, 1024])
def test_silhouette_is_the_same_by_constants_and_by_tables(spark, labelled_rows, most_constant, gap):
    """Also with sparse and negative labels."""
    rows = [(x, y, ((i * 7) % 11 - 4) * gap) for i, (x, y, _) in enumerate([*labelled_rows, *labelled_rows[:9]])]
    df = spark.createDataFrame(rows, "x double, y double, label int")
    got = scoring.silhouette_scores(df, ["x", "y"], ["label"], most_constant=most_constant).first()
    assert got["silhouette"] == pytest.approx(brute_force_silhouette(rows), abs=1e-9)


@pytest.mark.parametrize("k", [40, 500, 3000])
def test_silhouette_of_many_clusters_is_that_of_the_evaluator(spark, k):
    """Clusters of very different spread, so the nearest mean is often not the nearest cluster."""
    rng = random.Random(k)
    spots = [(rng.uniform(0, 50), rng.uniform(-9, 9), rng.choice([0.01, 0.3, 4.0])) for _ in range(k)]
    rows = []
    for i in range(4 * k):
        x, y, spread = spots[i % k]
        rows.append((rng.gauss(x, spread), rng.gauss(y, spread), i % k))
    df = spark.createDataFrame(rows, "x double, y double, label int").withColumns(
        {"v": array_to_vector(F.array("x", "y")), "prediction": F.col("label")}
    )
    evaluator = ClusteringEvaluator(
        featuresCol="v", metricName="silhouette", distanceMeasure="squaredEuclidean"
    )
    want = evaluator.evaluate(df)
    for most_constant in (scoring.CONSTANT, 0):
        got = scoring.silhouette_scores(df, ["x", "y"], ["label"], most_constant=most_constant).first()
        assert got["silhouette"] == pytest.approx(want, abs=1e-9) and got["clusters"] == k


def test_cell_lists_are_short_and_keep_every_winner():
    rng = np.random.default_rng(4)
    centers = rng.uniform([41.6, -87.9], [42.0, -87.5], (1000, 2))
    centers[500:520] = centers[:20]  # equal centers tie
    grid = CenterGrid(centers)
    assert np.mean([len(x) for x in grid.lists]) < 8
    points = rng.uniform([41.4, -88.1], [42.2, -87.3], (3000, 2))
    width = (grid.high - grid.low) / grid.steps
    cells = np.clip(((points - grid.low) / width).astype(int), 0, grid.steps - 1)
    for point, cell in zip(points, cells):
        best = int(((centers - point) ** 2).sum(axis=1).argmin())
        assert best in grid.lists[cell[0] * grid.steps + cell[1]]


def test_many_centers_give_what_comparing_all_gives(spark):
    """Lattices tie everywhere; some points are far outside, huge or no numbers."""
    rng = random.Random(9)
    lattice = [(41.5 + i * 0.25, -88.0 + j * 0.25) for i in range(8) for j in range(8)]
    points = [(41.0 + rng.randrange(40) / 8, -89.0 + rng.randrange(40) / 8) for _ in range(500)]
    points += [(1e18, -1e18), (float("nan"), 1.0), (float("inf"), 2.0), (None, 3.0), (-1e300, 1e300), (41.5, -1e12)]
    df = spark.createDataFrame(points, "Latitude double, Longitude double")
    for centers in (lattice, lattice[::-1] + lattice, [(1.0, 2.0)] * 30):
        all_of_them = [f"struct((Latitude - {a}D) * (Latitude - {a}D) + (Longitude - {b}D) * (Longitude - {b}D) as d, {i} as i)" for i, (a, b) in enumerate(centers)]
        want = f"if(Latitude is null or Longitude is null, null, array_min(array({', '.join(all_of_them)})).i)"
        both = df.select(clustering.nearest_center(COORDS, centers).alias("got"), F.expr(want).alias("want"))
        assert both.filter("not (got <=> want)").count() == 0


def test_best_k_without_scores_is_null(spark):
    scores = spark.createDataFrame([(3, None), (4, None)], "k int, silhouette double")
    assert tuple(scoring.best_k(scores).first()) == (None, None)


def test_intermediates_are_removed(spark, planted):
    shared = Path(shared_root(spark).removeprefix("file:"))
    left = lambda: sorted(p for p in shared.rglob("points-*"))
    before = left()
    sweep(planted, [2, 3])
    with pytest.raises(ValueError):
        sweep(planted.limit(1), [2])
    assert left() == before


def test_fits_do_not_depend_on_the_number_of_partitions(planted):
    costs = []
    for share in (10**6, 7):
        with prepare_points(planted, points_per_partition=share) as points:
            costs.append(fit_models(points, [3])[3].summary.trainingCost)
    assert costs[0] == pytest.approx(costs[1], rel=1e-6)


def test_model_scores_agree_with_the_evaluator(domestic):
    """The evaluator sees every incident, we see places with weights; scores are the same."""
    evaluator = ClusteringEvaluator(
        predictionCol="prediction_3",
        featuresCol=STANDARDIZED,
        metricName="silhouette",
        distanceMeasure="squaredEuclidean",
    )
    with prepare_points(domestic) as points:
        assert points.scale.rows > points.scale.points
        models = fit_models(points, [3])
        got = score_models(points, models).first()["silhouette"]
    rows = features.standardize_columns(domestic, points.scale)
    want = evaluator.evaluate(models[3].transform(rows))
    assert math.isclose(got, want, abs_tol=1e-6)


def test_partitions_follow_the_points():
    assert [partitions_for(n) for n in (2, 160_000, 160_001, 10**9)] == [8, 8, 9, 50_000]
    assert partitions_for(1000, 10) == 100


def test_studies_cover_the_cluster_counts():
    assert {s.ks for s in STUDIES.values()} == {(3,), (30,), tuple(range(3, 10))}

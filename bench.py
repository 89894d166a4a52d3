"""Headline queries, timed to a forced result. Prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. All queries
run once to warm up and then three times each; the median counts. Further queries
run once, cold, and are not in the total. The total also
leaves out ``kmeans_k_sweep_uncached``, which runs once: it is the same sweep
done the plain way for comparison, row by row, nothing held in memory, one model
after another.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from blotter.operators import clustering, features  # noqa: E402
from blotter.plans import STUDIES, domestic_in_homes, prepare_points, sweep  # noqa: E402
from blotter.plans.hotspots import fit_models  # noqa: E402
from blotter.sources import fresh_folder, remove_folder, stage_incidents  # noqa: E402
from checks.fixture import csv_incidents, incident_table, incident_view, lineitem_points  # noqa: E402
from checks.registry import QUERIES  # noqa: E402

RUNS = 3


def force(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def fit(incidents: DataFrame, k: int, algorithm: str) -> None:
    with prepare_points(incidents) as points:
        fit_models(points, [k], algorithm)


def stage_and_remove(spark, incidents: DataFrame) -> None:
    folder = fresh_folder(spark, "bench")
    stage_incidents(incidents, folder)
    remove_folder(spark, folder)


def spread(points: DataFrame, times: int) -> DataFrame:
    """So many times the points, all distinct."""
    shift = F.explode(F.sequence(F.lit(1), F.lit(times)))
    return points.withColumn("shift", shift).select(
        (F.col("l_quantity") + F.col("shift") * 1e-4).alias("Latitude"),
        (F.col("l_extendedprice") / 1e4 - F.col("shift") * 1e-5).alias("Longitude"),
    )


def sweep_uncached(incidents: DataFrame, ks) -> None:
    assembled = features.assemble_features(incidents)
    scaled = features.standardize_features(assembled, features.fit_scaler(assembled))
    evaluator = ClusteringEvaluator(
        featuresCol=features.STANDARDIZED,
        metricName="silhouette",
        distanceMeasure="squaredEuclidean",
    )
    for k in ks:
        evaluator.evaluate(clustering.fit_kmeans(scaled, k).transform(scaled))


def seconds(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="blotter-bench-"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def domestic():
        return domestic_in_homes(incident_table(spark, sf_dir))

    ks = STUDIES["domestic_kmeans_3_to_9"].ks
    headline = {
        "count_by_primary_type": lambda: force(QUERIES["count_by_primary_type"](spark, sf_dir)),
        "count_by_field_raw_lines": lambda: force(
            QUERIES["count_by_field_raw_lines"](spark, sf_dir)
        ),
        "csv_scan_typed": lambda: force(csv_incidents(spark, sf_dir)),
        "incidents_domestic": lambda: force(domestic()),
        "incidents_domestic_from_csv": lambda: force(
            domestic_in_homes(csv_incidents(spark, sf_dir))
        ),
        "incidents_street_night": lambda: force(QUERIES["incidents_street_night"](spark, sf_dir)),
        "assign_nearest_center": lambda: force(QUERIES["assign_nearest_center"](spark, sf_dir)),
        "silhouette_score": lambda: force(QUERIES["silhouette_score"](spark, sf_dir)),
        "score_by_k": lambda: force(QUERIES["score_by_k"](spark, sf_dir)),
        "kmeans_fit_k3": lambda: fit(domestic(), 3, "kmeans"),
        "kmeans_fit_k30": lambda: fit(domestic(), 30, "kmeans"),
        "gmm_fit_k3": lambda: fit(domestic(), 3, "gmm"),
        "kmeans_k_sweep": lambda: force(sweep(domestic(), ks)),
    }
    # Not part of the total, which so stays comparable between rounds.
    more = {
        name: (lambda name=name: force(QUERIES[name](spark, sf_dir)))
        for name in (
            "incidents_street_day",
            "incidents_domestic_by_year",
            "assign_many_centers",
            "silhouette_many_clusters",
            "kmeans_predict",
            "gmm_predict",
            "planted_cluster_map",
            "domestic_kmeans_30",
            "kmeans_k_sweep_from_pool",
            "merged_moments",
            "filter_bbox_by_place",
            "filter_small_box_by_place",
            "cluster_map_tiles",
            "csv_rejected_records",
        )
    } | {
        "stage_incidents": lambda: stage_and_remove(spark, incident_view(spark, sf_dir)),
        "kmeans_fit_k30_all_lineitem_points": lambda: fit(spread(lineitem_points(spark, sf_dir), 1), 30, "kmeans"),
    }
    for run in headline.values():
        run()

    def medians(queries, runs):
        return {
            name: round(statistics.median(seconds(run) for _ in range(runs)), 3)
            for name, run in queries.items()
        }

    times = medians(headline, RUNS)
    total = sum(times.values())
    times |= medians(more, 1)
    times["kmeans_k_sweep_uncached"] = round(seconds(lambda: sweep_uncached(domestic(), ks)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(total, 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Where incidents cluster: fit, assign, score, and sweep over cluster counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from blotter.operators import clustering, pooled
from blotter.operators.features import (
    STANDARDIZED,
    WEIGHT,
    Scale,
    collapse_points,
    measure_scale,
    standardize_columns,
)
from blotter.operators.scoring import silhouette_scores
from blotter.schema import COORDINATES
from blotter.sources.shared import fresh_folder, remove_folder

_CENTRED = "centred"

# A task's share of the points: a pass over it outweighs starting the task, and some tasks are
# there from small sizes on.
POINTS_PER_PARTITION = 20_000
LEAST_PARTITIONS = 8
# Fits that run side by side. They share the points held, so this costs no memory by size.
PARALLELISM = 4
# Starts of a mixture. On planted spots half of the single starts end in a poor optimum.
GMM_RESTARTS = 6


@dataclass(frozen=True)
class PointSet:
    """Weighted distinct points ready for repeated passes, and their scale.

    ``close`` (or leaving the ``with`` block) frees the memory and the files behind it.
    """

    frame: DataFrame
    scale: Scale
    folder: str

    @property
    def centred(self) -> list[str]:
        return [f"{_CENTRED}_{c}" for c in self.scale.columns]

    def close(self) -> None:
        self.frame.unpersist()
        remove_folder(self.frame.sparkSession, self.folder)

    def __enter__(self) -> PointSet:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def prepare_points(
    incidents: DataFrame,
    coords: Sequence[str] = COORDINATES,
    points_per_partition: int = POINTS_PER_PARTITION,
) -> PointSet:
    """Collapse incidents to weighted points and write them to the shared folder.

    Every later pass, and every lost executor, reads points and never the incidents
    again. The points are held once, as vectors, and all fits and scores read that copy.
    Hash partitioning into one partition per ``points_per_partition`` points (and
    ``LEAST_PARTITIONS`` at least), sorted inside, makes the layout depend on the points
    alone and not on how the input happened to be split; so a seeded fit repeats, up to
    the rounding of sums.
    """
    spark = incidents.sparkSession
    folder = fresh_folder(spark, "points")
    try:
        collapse_points(incidents.select(*coords), coords).write.parquet(folder)
        points = spark.read.parquet(folder)
        scale = measure_scale(points, coords)
    except BaseException:
        remove_folder(spark, folder)
        raise
    frame = (
        standardize_columns(points, scale)
        .withColumns({f"{_CENTRED}_{c}": x for c, x in zip(coords, scale.centred())})
        .repartition(partitions_for(scale.points, points_per_partition), *coords)
        .sortWithinPartitions(*coords)
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    return PointSet(frame, scale, folder)


def partitions_for(points: int, points_per_partition: int = POINTS_PER_PARTITION) -> int:
    return max(LEAST_PARTITIONS, -(-points // points_per_partition))


def fit_models(
    points: PointSet,
    ks: Sequence[int],
    algorithm: str = "kmeans",
    seed: int = clustering.SEED,
    max_iter: int | None = None,
    parallelism: int = PARALLELISM,
    restarts: int = 1,
) -> dict:
    """One model per k. Fits are independent, so a few run side by side.

    A mixture is fitted ``restarts`` times, from ``seed``, ``seed + 1`` and so on over the same points held,
    and the likeliest is kept, of equals the one of the lowest seed. k-means draws its start from the whole
    data and has one.
    """
    fit = {"kmeans": clustering.fit_kmeans, "gmm": clustering.fit_gmm}[algorithm]
    if restarts < 1 or (restarts > 1 and algorithm != "gmm"):
        raise ValueError("a mixture has one start or more, k-means one")
    options = {"weight": WEIGHT}
    if max_iter:
        options["max_iter"] = max_iter

    def one(start):
        k, own_seed = start
        names = {"prediction": _prediction(k)}
        if algorithm == "gmm":
            names["probability"] = f"probability_{k}"
        return fit(points.frame, k, seed=own_seed, **options, **names)

    task = inheritable_thread_target(points.frame.sparkSession)(one)
    starts = [(k, seed + i) for k in ks for i in range(restarts)]
    with ThreadPool(max(1, min(parallelism, len(starts)))) as pool:
        fitted = list(zip(starts, pool.map(task, starts)))
    if restarts == 1:
        return {k: model for (k, _), model in fitted}
    return {
        k: max((m for (own, _), m in fitted if own == k), key=lambda m: m.summary.logLikelihood)
        for k in ks
    }


def score_models(points: PointSet, models: dict) -> DataFrame:
    """``(k, silhouette, cost or log_likelihood)`` of fitted models, in k order.

    All models label the points in one frame and are scored in the same passes.
    """
    spark = points.frame.sparkSession
    labelled = points.frame
    for model in models.values():
        labelled = model.transform(labelled)
    labels = [_prediction(k) for k in models]
    scores = silhouette_scores(labelled, points.centred, labels, WEIGHT).collect()
    silhouettes = {row["labelling"]: row["silhouette"] for row in scores}

    first = next(iter(models.values()))
    measure = "cost" if hasattr(first, "clusterCenters") else "log_likelihood"
    rows = [
        (
            k,
            silhouettes[_prediction(k)],
            float(
                model.summary.trainingCost
                if measure == "cost"
                else model.summary.logLikelihood
            ),
        )
        for k, model in models.items()
    ]
    schema = T.StructType(
        [
            T.StructField("k", T.IntegerType()),
            T.StructField("silhouette", T.DoubleType()),
            T.StructField(measure, T.DoubleType()),
        ]
    )
    return spark.createDataFrame(rows, schema)


def sweep(
    incidents: DataFrame,
    ks: Sequence[int],
    algorithm: str = "kmeans",
    seed: int = clustering.SEED,
    max_iter: int | None = None,
    parallelism: int = PARALLELISM,
    restarts: int = 1,
) -> DataFrame:
    """Fit and score every k over one prepared set of points."""
    with prepare_points(incidents) as points:
        models = fit_models(points, ks, algorithm, seed, max_iter, parallelism, restarts)
        return score_models(points, models)


def sweep_from_pool(
    incidents: DataFrame,
    ks: Sequence[int],
    seed: int = clustering.SEED,
    max_iter: int = clustering.KMEANS_MAX_ITER,
) -> DataFrame:
    """``(k, silhouette, cost)`` of k-means for every k, all from one pool of candidate centers.

    ``sweep`` starts each k anew. Here the candidates are drawn once, and every pass over the points
    serves all ks (``pooled``).
    """
    with prepare_points(incidents) as points:
        models = pooled.fit_pooled(points.frame, points.centred, WEIGHT, ks, seed, max_iter)
        labelled = points.frame.withColumns(
            {_prediction(k): clustering.nearest_center(points.centred, m.centers) for k, m in models.items()}
        )
        labels = [_prediction(k) for k in models]
        scores = silhouette_scores(labelled, points.centred, labels, WEIGHT).collect()
    found = {row["labelling"]: row["silhouette"] for row in scores}
    return incidents.sparkSession.createDataFrame(
        [(k, found[_prediction(k)], m.cost) for k, m in models.items()],
        "k int, silhouette double, cost double",
    )


def assign_kmeans(
    incidents: DataFrame, k: int, seed: int = clustering.SEED, max_iter: int | None = None
) -> DataFrame:
    """Every incident with its k-means cluster."""
    return _fit_and_assign(incidents, k, "kmeans", seed, max_iter)


def assign_gmm(
    incidents: DataFrame,
    k: int,
    seed: int = clustering.SEED,
    max_iter: int | None = None,
    restarts: int = 1,
) -> DataFrame:
    """Every incident with its posterior and its most probable component."""
    return _fit_and_assign(incidents, k, "gmm", seed, max_iter, restarts)


def _fit_and_assign(incidents, k, algorithm, seed, max_iter, restarts=1) -> DataFrame:
    with prepare_points(incidents) as points:
        model = fit_models(points, [k], algorithm, seed, max_iter, restarts=restarts)[k]
    model = model.setPredictionCol("prediction")
    if algorithm == "gmm":
        model = model.setProbabilityCol("probability")
    return model.transform(standardize_columns(incidents, points.scale)).drop(STANDARDIZED)


def _prediction(k: int) -> str:
    return f"prediction_{k}"

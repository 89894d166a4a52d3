"""Cluster models and cluster assignment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_

from pyspark.ml.clustering import (
    GaussianMixture,
    GaussianMixtureModel,
    KMeans,
    KMeansModel,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.operators.cells import CenterGrid, constant
from blotter.operators.features import STANDARDIZED, WEIGHT, Scale

# The library default seed is a hash that differs between Python processes.
SEED = 20

# Iteration limits and tolerances of the two models.
KMEANS_MAX_ITER = 20
KMEANS_TOL = 1e-4
GMM_MAX_ITER = 100
GMM_TOL = 0.01

# Centers up to which comparing with all is quicker than finding a cell.
FEW_CENTERS = 16


def fit_kmeans(
    points: DataFrame,
    k: int,
    weight: str | None = None,
    seed: int = SEED,
    max_iter: int = KMEANS_MAX_ITER,
    prediction: str = "prediction",
) -> KMeansModel:
    """k-means on the standardized vectors. Fewer distinct points give fewer centers."""
    model = KMeans(
        featuresCol=STANDARDIZED,
        predictionCol=prediction,
        k=k,
        seed=seed,
        maxIter=max_iter,
        tol=KMEANS_TOL,
    )
    return (model.setWeightCol(weight) if weight else model).fit(points)


def fit_gmm(
    points: DataFrame,
    k: int,
    weight: str | None = None,
    seed: int = SEED,
    max_iter: int = GMM_MAX_ITER,
    prediction: str = "prediction",
    probability: str = "probability",
) -> GaussianMixtureModel:
    """Gaussian mixture on the standardized vectors."""
    model = GaussianMixture(
        featuresCol=STANDARDIZED,
        predictionCol=prediction,
        probabilityCol=probability,
        k=k,
        seed=seed,
        maxIter=max_iter,
        tol=GMM_TOL,
    )
    return (model.setWeightCol(weight) if weight else model).fit(points)


def kmeans_centers(model: KMeansModel, points: DataFrame, scale: Scale) -> DataFrame:
    """One row per cluster: its center in the original units and the rows it holds."""
    label = model.getPredictionCol()
    held = model.transform(points).groupBy(label).agg(F.sum(WEIGHT).alias("size"))
    sizes = {row[label]: row["size"] for row in held.collect()}
    rows = [
        (i, *scale.unscaled(center), sizes.get(i, 0))
        for i, center in enumerate(model.clusterCenters())
    ]
    columns = [T.StructField(c, T.DoubleType()) for c in scale.columns]
    return points.sparkSession.createDataFrame(
        rows,
        T.StructType(
            [
                T.StructField("cluster", T.IntegerType()),
                *columns,
                T.StructField("size", T.LongType()),
            ]
        ),
    )


def gmm_components(spark: SparkSession, model: GaussianMixtureModel, scale: Scale) -> DataFrame:
    """One row per component: mixing weight, mean in the original units, covariance.

    The covariance stays in standardized units, row by row.
    """
    rows = [
        (
            i,
            float(weight),
            *scale.unscaled(gaussian.mean),
            [float(v) for v in gaussian.cov.toArray().ravel()],
        )
        for i, (weight, gaussian) in enumerate(zip(model.weights, model.gaussians))
    ]
    columns = [T.StructField(c, T.DoubleType()) for c in scale.columns]
    return spark.createDataFrame(
        rows,
        T.StructType(
            [
                T.StructField("cluster", T.IntegerType()),
                T.StructField("mixing_weight", T.DoubleType()),
                *columns,
                T.StructField("covariance", T.ArrayType(T.DoubleType())),
            ]
        ),
    )


def nearest_center(columns: Sequence[str], centers: Sequence[Sequence[float]]) -> Column:
    """Index of the nearest of the given centers, the lowest one on a tie.

    The centers are constants of the plan, so assignment is a projection: no join, no shuffle,
    no vectors. With more than ``FEW_CENTERS`` of them a point is compared only with those that can win in its
    cell of a grid over the centers; points far outside the grid are compared with all.
    """
    xs = [F.col(f"`{c}`") for c in columns]
    values = [[float(v) for v in center] for center in centers]
    every = constant(values, "array<array<double>>")

    def nearest(listed: Column, center) -> Column:
        distances = F.transform(
            listed,
            lambda item, i: F.struct(
                reduce(add, [(x - center(item)[j]) * (x - center(item)[j]) for j, x in enumerate(xs)]).alias(
                    "distance"
                ),
                (item if listed is not every else i).alias("index"),
            ),
        )
        return F.array_min(distances)["index"]

    found = nearest(every, lambda center: center)
    if len(values) > FEW_CENTERS:
        grid = CenterGrid(values)
        listed = nearest(grid.candidates(xs), lambda index: F.get(every, index))
        found = F.when(grid.within_reach(xs), listed).otherwise(found)
    known = reduce(and_, [x.isNotNull() for x in xs])
    return F.when(known, found).cast("int")


def assign_nearest_center(
    df: DataFrame,
    columns: Sequence[str],
    centers: Sequence[Sequence[float]],
    prediction: str = "prediction",
) -> DataFrame:
    return df.withColumn(prediction, nearest_center(columns, centers))

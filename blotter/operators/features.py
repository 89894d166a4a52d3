"""Feature vectors from coordinates, their scaling, and repeated points."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.schema import COORDINATES

FEATURES = "features"
STANDARDIZED = "standardized"
WEIGHT = "weight"


def assemble_features(df: DataFrame, columns: Sequence[str] = COORDINATES) -> DataFrame:
    """Add the vector column. Nulls raise, so drop them first."""
    return VectorAssembler(inputCols=list(columns), outputCol=FEATURES).transform(df)


def fit_scaler(df: DataFrame) -> StandardScalerModel:
    """Learn each feature's sample standard deviation; the mean is not removed."""
    return StandardScaler(inputCol=FEATURES, outputCol=STANDARDIZED).fit(df)


def standardize_features(df: DataFrame, scaler: StandardScalerModel) -> DataFrame:
    return scaler.transform(df)


@dataclass(frozen=True)
class Scale:
    """Mean and sample standard deviation per column, and how many rows gave them."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    stddev: tuple[float, ...]
    rows: int
    points: int

    def scaled(self) -> list[Column]:
        """Value over standard deviation; a constant column becomes zero."""
        return [
            F.col(c) / F.lit(s) if s else F.lit(0.0)
            for c, s in zip(self.columns, self.stddev)
        ]

    def centred(self) -> list[Column]:
        """As ``scaled`` but around the mean, which keeps squared sums small."""
        return [
            (F.col(c) - F.lit(m)) / F.lit(s) if s else F.lit(0.0)
            for c, m, s in zip(self.columns, self.mean, self.stddev)
        ]

    def unscaled(self, vector) -> list[float]:
        """A point of the scaled space back in the original units."""
        return [
            float(v) * s if s else m
            for v, m, s in zip(vector, self.mean, self.stddev)
        ]


def collapse_points(df: DataFrame, columns: Sequence[str] = COORDINATES) -> DataFrame:
    """One row per distinct point with the number of rows there as ``weight``.

    Incidents repeat the same coordinates heavily. Clustering passes over its
    input dozens of times; a weighted point stands exactly for its copies, so
    each pass touches distinct points instead of incidents. Local counting comes
    before the shuffle, so a point that holds much of the data is no hot spot.
    """
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(WEIGHT))


def column_moments(
    df: DataFrame, columns: Sequence[str] = COORDINATES, weight: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Per group of ``by`` the number of rows and distinct rows, and each column's mean and summed squared deviations.

    One pass. Spark's own average and variance keep a centre and join partial results around
    it, so nothing cancels for columns that are large against their spread. Rows of one weight are alike in that, so
    they are taken together per weight, and the groups are then joined pairwise. As weights of n rows add up to
    n, there are at most the square root of 2 n of them.
    """
    w = F.col(f"`{weight}`") if weight else F.lit(1)
    points = F.count(F.lit(1))
    alike = (
        df.withColumn("_w", w.cast("double"))
        .groupBy(*by, "_w")
        .agg(
            points.alias("points"),
            *[F.avg(f"`{c}`").alias(f"mean_{c}") for c in columns],
            *[F.var_pop(f"`{c}`").alias(f"var_{c}") for c in columns],
        )
    )
    rows = F.col("_w") * F.col("points")
    per_weight = alike.select(
        *by,
        rows.alias("rows"),
        "points",
        *[F.col(f"mean_{c}") for c in columns],
        *[(rows * F.col(f"var_{c}")).alias(f"squares_{c}") for c in columns],
    )
    return merge_moments(per_weight, columns, by)


def merge_moments(
    moments: DataFrame, columns: Sequence[str] = COORDINATES, by: Sequence[str] = ()
) -> DataFrame:
    """Moments of several groups, tables or files as those of all their rows, joined pairwise.

    So the moments of files added later are merged with those kept, and no row is read again.
    """
    parts = F.struct("rows", "points", *[f"mean_{c}" for c in columns], *[f"squares_{c}" for c in columns])

    def joined(a, b):
        rows = a["rows"] + b["rows"]
        share = F.coalesce(F.try_divide(b["rows"], rows), F.lit(0.0))
        means, squares = [], []
        for c in columns:
            step = b[f"mean_{c}"] - a[f"mean_{c}"]
            means.append((a[f"mean_{c}"] + step * share).alias(f"mean_{c}"))
            apart = step * step * a["rows"] * share
            squares.append((a[f"squares_{c}"] + b[f"squares_{c}"] + apart).alias(f"squares_{c}"))
        return F.struct(rows.alias("rows"), (a["points"] + b["points"]).alias("points"), *means, *squares)

    zero = [F.lit(0.0).alias("rows"), F.lit(0).cast("long").alias("points")]
    zero += [F.lit(0.0).alias(f"{name}_{c}") for name in ("mean", "squares") for c in columns]
    ordered = F.array_sort(F.collect_list(parts))  # the same order whatever tasks came first
    merged = F.aggregate(ordered, F.struct(*zero), joined).alias("m")
    return moments.filter("rows > 0").groupBy(*by).agg(merged).select(*by, "m.*")


def moments_stddev(moments: DataFrame, columns: Sequence[str] = COORDINATES) -> list[Column]:
    """Sample standard deviations of merged moments; null for fewer than two rows."""
    spare = F.when(F.col("rows") > 1, F.col("rows") - 1)
    return [F.sqrt(F.col(f"squares_{c}") / spare).alias(c) for c in columns]


def measure_scale(points: DataFrame, columns: Sequence[str] = COORDINATES) -> Scale:
    """Scale of weighted points, equal to that of the rows they stand for, in one pass."""
    moments = column_moments(points, columns, WEIGHT)
    row = moments.select(
        "rows", "points", *[f"mean_{c}" for c in columns], *moments_stddev(moments, columns)
    ).first()
    if row["points"] < 2:
        raise ValueError(f"clustering needs at least 2 distinct points, got {row['points']}")
    return Scale(
        tuple(columns),
        tuple(row[f"mean_{c}"] for c in columns),
        tuple(row[c] for c in columns),
        int(row["rows"]),
        row["points"],
    )


def standardize_columns(df: DataFrame, scale: Scale) -> DataFrame:
    """Add the scaled vector straight from the columns of a known scale."""
    return df.withColumn(STANDARDIZED, array_to_vector(F.array(*scale.scaled())))

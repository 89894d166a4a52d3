"""Silhouette with squared Euclidean distance, as aggregations.

The mean squared distance from a point to all members of a cluster is the squared distance
to the cluster's mean plus the cluster's spread. So the score needs one pass for sizes, means and
spreads, and one pass for the points, and never pairs points.

Nor does a point meet all clusters: a grid over the points says which few can be the nearest
other cluster in each cell (``cells``). Up to ``CONSTANT`` clusters these lists are constants of the plan, and scoring
is a projection. More clusters stay tables, and points meet the list of their cell by an equi-join.
Neither plan nor generated code grows with the number of clusters.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.operators.cells import CenterGrid, cell_lists, constant, step_of, steps_for

# Clusters, all labellings together, that may be constants of a plan.
CONSTANT = 2048
# Clusters of a labelling up to which comparing with all is quicker than finding a cell.
FEW = 12

_TERM = "struct<cost:double,center:array<double>>"


def cluster_sums(
    df: DataFrame, coords: Sequence[str], labels: Sequence[str], weight: str | None = None
) -> DataFrame:
    """Size, coordinate sums, squared-norm sum and bounds per labelling (by position) and label."""
    xs = [F.col(f"x{i}") for i in range(len(coords))]
    return (
        _labelled(df, coords, labels, weight)
        .groupBy("labelling", "label")
        .agg(
            F.sum("w").alias("n"),
            *[F.sum(F.col("w") * x).alias(f"sum_{i}") for i, x in enumerate(xs)],
            F.sum(F.col("w") * reduce(add, [x * x for x in xs])).alias("squares"),
            *[F.min(x).alias(f"low{i}") for i, x in enumerate(xs)],
            *[F.max(x).alias(f"high{i}") for i, x in enumerate(xs)],
        )
    )


def silhouette_scores(
    df: DataFrame,
    coords: Sequence[str],
    labels: Sequence[str],
    weight: str | None = None,
    most_constant: int = CONSTANT,
) -> DataFrame:
    """``(labelling, clusters, silhouette)``, one row per label column, null ones too.

    All labellings share the passes. A labelling of fewer than two clusters has no
    silhouette and gives null. With ``weight`` a row counts as that many equal rows,
    each of which still has its copies as neighbours.
    """
    axes = range(len(coords))
    sums = cluster_sums(df, coords, labels, weight).persist()
    per_labelling = sums.groupBy("labelling").agg(
        F.count(F.lit(1)).cast("int").alias("clusters"),
        *[F.min(f"low{i}").alias(f"low{i}") for i in axes],
        *[F.max(f"high{i}").alias(f"high{i}") for i in axes],
    )
    known = {row["labelling"]: row for row in per_labelling.collect()}
    spread = reduce(add, [F.col(f"center{i}") * F.col(f"center{i}") for i in axes])
    mean_square = F.col("squares") / F.col("n")
    clusters = sums.select(
        "labelling", "label", "n", "squares", *[(F.col(f"sum_{i}") / F.col("n")).alias(f"center{i}") for i in axes]
    ).select(
        "labelling",
        "label",
        F.greatest(mean_square - spread, F.lit(0.0)).alias("cost"),
        (mean_square * F.lit(1e-9)).alias("slack"),
        (F.col("n") / F.nullif(F.col("n") - 1, F.lit(0))).alias("others"),
        *[f"center{i}" for i in axes],
    )
    if sum(row["clusters"] for row in known.values()) <= most_constant:
        held = clusters.collect()
        sums.unpersist()
        means = _with_constants(df, coords, labels, weight, known, held)
    else:
        means = _with_tables(df, coords, labels, weight, known, clusters)
    counted = [known[i]["clusters"] if i in known else 0 for i in range(len(labels))]
    names = constant(
        [{"p": i, "n": name, "c": c} for i, (name, c) in enumerate(zip(labels, counted))],
        "array<struct<p:int,n:string,c:int>>",
    )
    return (
        df.sparkSession.range(1)
        .select(F.inline(names))
        .join(means, F.col("p") == F.col("labelling"), "left")
        .select(
            F.col("n").alias("labelling"),
            F.col("c").alias("clusters"),
            F.when(F.col("c") > 1, F.col("silhouette")).alias("silhouette"),
        )
    )


def _with_constants(df, coords, labels, weight, known, held) -> DataFrame:
    """``(labelling, silhouette)`` with a labelling's clusters as an array, in one projection for all."""
    axes, spark = range(len(coords)), df.sparkSession
    xs = [F.col(f"x{i}") for i in axes]
    points = df.filter(_known(coords, labels)).select(
        *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(coords)],
        *[F.col(f"`{name}`").cast("int").alias(f"label{j}") for j, name in enumerate(labels)],
        (F.col(f"`{weight}`") if weight else F.lit(1)).alias("w"),
    )
    for j in sorted(known):
        own = [row for row in held if row["labelling"] == j]
        terms = [{"cost": r["cost"], "center": [r[f"center{i}"] for i in axes]} for r in own]
        # A point's own cluster comes by its label, with its number: sparse labels cost nothing.
        mine = spark.createDataFrame(
            [(r["label"], p, r["others"], (t["cost"], t["center"])) for p, (r, t) in enumerate(zip(own, terms))],
            f"label{j} int, own int, others double, mine {_TERM}",
        )
        if len(own) <= FEW:
            near = _nearest_of_few(F.col("own"), terms, xs)
        else:
            bounds = [[known[j][f"{side}{i}"] for i in axes] for side in ("low", "high")]
            grid = CenterGrid([t["center"] for t in terms], [t["cost"] for t in terms], 2, *bounds)
            listed = constant(terms, f"array<{_TERM}>")
            near = _nearest_other(grid.candidates(xs), F.col("own"), lambda p, listed=listed: F.get(listed, p), xs)
        points = points.join(F.broadcast(mine), f"label{j}").select(
            *[c for c in points.columns if c != f"label{j}"],
            _score(_cost(F.col("mine"), xs) * F.col("others"), near).alias(f"score{j}"),
        )
    summed = points.agg(
        F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(f"score{j}")).alias(f"score{j}") for j in known]
    )
    rows = [
        F.struct(F.lit(j).alias("labelling"), (F.col(f"score{j}") / F.col("w")).alias("silhouette"))
        for j in known
    ]
    empty = spark.createDataFrame([], "labelling int, silhouette double")
    return summed.select(F.inline(F.array(*rows))) if rows else empty


def _cost(term, xs: Sequence[Column]) -> Column:
    """Mean squared distance from a point to a cluster's members."""
    squares = [(x - term["center"][i]) * (x - term["center"][i]) for i, x in enumerate(xs)]
    return reduce(add, squares, term["cost"])


def _nearest_other(listed: Column, own: Column, term, xs: Sequence[Column]) -> Column:
    """The least cost among the clusters listed by number, without the point's own."""
    return F.aggregate(
        listed,
        F.lit(None).cast("double"),
        lambda least, p: F.when(p == own, least).otherwise(F.least(least, _cost(term(p), xs))),
    )


def _nearest_of_few(own: Column, terms: list[dict], xs: Sequence[Column]) -> Column:
    """The same written out, which compiles; a few clusters stay within one method."""
    costs = [
        F.when(own != p, _cost({"cost": F.lit(t["cost"]), "center": [F.lit(x) for x in t["center"]]}, xs))
        for p, t in enumerate(terms)
    ]
    return F.least(*costs) if len(costs) > 1 else F.lit(None).cast("double")


def _with_tables(df, coords, labels, weight, known, clusters) -> DataFrame:
    """The same with clusters as a table: no array is longer than the list of a cell."""
    axes = range(len(coords))
    xs = [F.col(f"x{i}") for i in axes]
    center = F.array(*[f"center{i}" for i in axes]).alias("center")
    low = [min(row[f"low{i}"] for row in known.values()) for i in axes]
    high = [max(row[f"high{i}"] for row in known.values()) for i in axes]
    steps = steps_for(max(row["clusters"] for row in known.values()), len(coords))
    placed = _labelled(df, coords, labels, weight).select(
        "*", *[step_of(F.col(f"x{i}"), low[i], high[i], steps).alias(f"s{i}") for i in axes]
    )
    numbers = [f"s{i}" for i in axes]
    boxes = (
        placed.filter("labelling = 0")
        .groupBy(*numbers)
        .agg(
            *[F.min(f"x{i}").alias(f"low{i}") for i in axes],
            *[F.max(f"x{i}").alias(f"high{i}") for i in axes],
        )
        .persist()
    )
    near_ones = (
        cell_lists(boxes, clusters.drop("others"), len(coords), steps)
        .groupBy("labelling", *numbers)
        .agg(F.collect_list(F.struct("label", "cost", center)).alias("clusters"))
    )
    mine = clusters.select(
        "labelling",
        "label",
        "others",
        F.struct("cost", center).alias("mine"),
    )
    near = F.aggregate(
        "clusters",
        F.lit(None).cast("double"),
        lambda least, c: F.when(c["label"] == F.col("label"), least).otherwise(F.least(least, _cost(c, xs))),
    )
    scored = placed.join(mine, ["labelling", "label"]).join(near_ones, ["labelling", *numbers])
    own = _cost(F.col("mine"), xs) * F.col("others")
    return scored.groupBy("labelling").agg(
        (F.sum(F.col("w") * _score(own, near)) / F.sum("w")).alias("silhouette")
    )


def _score(own: Column, near: Column) -> Column:
    return F.coalesce(F.try_divide(near - own, F.greatest(own, near)), F.lit(0.0))


def best_k(scores: DataFrame) -> DataFrame:
    """The k with the highest silhouette, the lowest such k on a tie, and that score.

    Without any score there is no best k: both are null.
    """
    rank = F.when(F.col("silhouette").isNotNull(), F.struct("silhouette", -F.col("k")))
    return scores.agg(F.max_by("k", rank).alias("k"), F.max("silhouette").alias("silhouette"))


def _known(coords, labels) -> Column:
    return reduce(and_, [F.col(f"`{c}`").isNotNull() for c in (*coords, *labels)])


def _labelled(df: DataFrame, coords, labels, weight: str | None) -> DataFrame:
    """A row for each row and labelling, where coordinates and labels are all known."""
    tagged = [
        F.struct(F.lit(i).alias("labelling"), F.col(f"`{name}`").cast("int").alias("label"))
        for i, name in enumerate(labels)
    ]
    return df.filter(_known(coords, labels)).select(
        *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(coords)],
        (F.col(f"`{weight}`") if weight else F.lit(1)).alias("w"),
        F.inline(F.array(*tagged)),
    )

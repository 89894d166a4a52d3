"""A grid of cells over points, each with the few centers that can win in it.

A center costs a point its squared distance plus a constant of the center's own: zero for
nearest centers, the cluster's spread for silhouettes. Where one center surely costs less than another
throughout a box, the other need not be looked at there. So every cell keeps a short list, cut out of
the list of the wider cell around it, and the work per point follows that list and not the number
of centers.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from operator import add, and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cells for each center, cells along an axis at most, and into how many a round of refinement
# cuts each axis of a cell.
PER_CENTER, MOST_STEPS, CUT = 4, 1 << 20, 4
# Cells whose lists may travel with a plan.
MOST_CONSTANT = 1 << 13
# Points farther from the grid than this many times its extent are beyond the bounds on rounding.
REACH = 10


def steps_for(centers: int, dimensions: int, most_cells: int = 1 << 60) -> int:
    """Cells along each axis: a power of two, some ``PER_CENTER`` cells for each center."""
    cells, steps = min(most_cells, max(1, centers * PER_CENTER)), 1
    while (2 * steps) ** dimensions <= cells and steps < MOST_STEPS:
        steps *= 2
    return steps


def step_of(x: Column, low: float, high: float, steps: int) -> Column:
    """Number of the axis step that holds a value; those outside belong to the outermost."""
    if not high > low:
        return F.lit(0).cast("long")
    place = (x - F.lit(low)) * F.lit(steps / (high - low))
    return F.floor(F.least(F.greatest(place, F.lit(0.0)), F.lit(steps - 0.5))).cast("long")


def constant(value, kind: str) -> Column:
    """A nested value as one constant of the plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


class CenterGrid:
    """Short lists of constant centers, found on the driver. Nothing here depends on how many points there are.

    Every cell lists the centers that can be among the best ``spare`` somewhere in it. The
    outermost cells reach to infinity, so every point has a cell.
    """

    def __init__(
        self,
        centers: Sequence[Sequence[float]],
        costs: Sequence[float] | None = None,
        spare: int = 1,
        low: Sequence[float] | None = None,
        high: Sequence[float] | None = None,
    ):
        self.centers = np.array(centers, dtype=float)
        self.costs = np.zeros(len(self.centers)) if costs is None else np.array(costs, dtype=float)
        self.spare, dimensions = spare, self.centers.shape[1]
        self.low = self.centers.min(axis=0) if low is None else np.array(low, dtype=float)
        self.high = self.centers.max(axis=0) if high is None else np.array(high, dtype=float)
        self.steps = steps_for(len(self.centers), dimensions, MOST_CONSTANT)
        self.extent = float((self.high - self.low).max())
        # More than rounding can change a cost by, within reach of the grid.
        self.slack = 1e-10 * (self.extent + float(np.abs(self.centers).max())) * self.extent
        self.lists = self._refined(dimensions)

    def _refined(self, dimensions: int) -> list[list[int]]:
        lists, steps = {(0,) * dimensions: np.arange(len(self.centers))}, 1
        while steps < self.steps:
            steps *= 2
            finer = {}
            for cell, held in lists.items():
                for offset in np.ndindex(*(2,) * dimensions):
                    inner = tuple(2 * s + o for s, o in zip(cell, offset))
                    finer[inner] = self._winners(np.array(inner), steps, held)
            lists = finer
        return [lists[cell].tolist() for cell in np.ndindex(*(self.steps,) * dimensions)]

    def _winners(self, cell: np.ndarray, steps: int, held: np.ndarray) -> np.ndarray:
        """Of the centers held those that fewer than ``spare`` others beat everywhere in the cell."""
        width, edge = (self.high - self.low) / steps, 1e-9 * self.extent
        low, high = self.low + cell * width, self.low + (cell + 1) * width
        points, costs = self.centers[held], self.costs[held]
        near = np.argsort(((points - (low + high) / 2) ** 2).sum(axis=1) + costs, kind="stable")
        low = np.where(cell == 0, -np.inf, low - edge)
        high = np.where(cell == steps - 1, np.inf, high + edge)
        beaten = np.zeros(len(held), dtype=int)
        norms = (points**2).sum(axis=1) + costs
        for other in near[: 2 ** len(cell) + self.spare]:
            # How much more the other costs is linear in the point, so it is most at a corner.
            slope = 2 * (points - points[other])
            with np.errstate(invalid="ignore"):
                most = np.where(slope == 0, 0.0, np.maximum(slope * low, slope * high)).sum(axis=1)
            beaten += norms[other] - norms + most < -self.slack
        return held[beaten < self.spare]

    def candidates(self, xs: Sequence[Column]) -> Column:
        """The positions of the centers that a point needs to be compared with."""
        if self.steps == 1:
            return constant(self.lists[0], "array<int>")
        number = F.lit(0).cast("long")
        for x, low, high in zip(xs, self.low.tolist(), self.high.tolist()):
            number = number * self.steps + step_of(x, low, high, self.steps)
        return F.get(constant(self.lists, "array<array<int>>"), number.cast("int"))

    def within_reach(self, xs: Sequence[Column]) -> Column:
        """Whether a point is near enough for its list; never so if it is not a number."""
        far = REACH * self.extent
        return reduce(
            and_,
            [x.between(F.lit(a - far), F.lit(b + far)) for x, a, b in zip(xs, self.low.tolist(), self.high.tolist())],
        )


def cell_lists(boxes: DataFrame, clusters: DataFrame, dimensions: int, steps: int) -> DataFrame:
    """``(s0, .., labelling, label, cost, center0, ..)``: the clusters that can be best, or best but one, in each cell.

    ``boxes`` has a row ``(s0, .., low0, high0, ..)`` for each finest cell that holds points, the box around
    them; ``clusters`` a row ``(labelling, label, cost, slack, center0, ..)`` each. The cluster best but one by its
    upper bound in a box bounds what any point there need look at, its own cluster left out.
    Everything stays a table, whatever the number of clusters.
    """
    axes = range(dimensions)
    numbers = [f"s{i}" for i in axes]
    sides = [f"{side}{i}" for i in axes for side in ("low", "high")]
    sizes = [steps]
    while sizes[-1] > 1:
        sizes.append(max(1, sizes[-1] // CUT))
    # The widest cell is one row, and all clusters start in it.
    kept, before = clusters.select(*[F.lit(0).cast("long").alias(f"s{i}") for i in axes], "*"), 1
    for size in sizes[::-1]:
        cells = (
            boxes.select(*[F.floor(F.col(s) / (steps // size)).alias(s) for s in numbers], *sides)
            .groupBy(*numbers)
            .agg(*[(F.min if side.startswith("low") else F.max)(side).alias(side) for side in sides])
        )
        within = [F.floor(F.col(f"a.s{i}") / (size // before)) == F.col(f"b.s{i}") for i in axes]
        pairs = cells.alias("a").join(kept.alias("b"), within).select("a.*", "b.*").drop(
            *[F.col(f"b.s{i}") for i in axes]
        )
        near, far = [], []
        for i in axes:
            x, low, high = (F.col(f"{name}{i}") for name in ("center", "low", "high"))
            outside = F.greatest(low - x, x - high, F.lit(0.0))
            near.append(outside * outside)
            widest = F.greatest(F.abs(x - low), F.abs(x - high))
            far.append(widest * widest)
        per_cell = (
            Window.partitionBy("labelling", *numbers)
            .orderBy("upper")
            .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        )
        lower = F.col("cost") + reduce(add, near) - F.col("slack")
        kept = (
            pairs.withColumn("lower", lower)
            .withColumn("upper", F.col("cost") + reduce(add, far) + F.col("slack"))
            .withColumn("bound", F.nth_value("upper", 2).over(per_cell))
            .filter(F.col("bound").isNull() | (F.col("lower") <= F.col("bound")))
            .drop("lower", "upper", "bound", *sides)
        )
        before = size
    return kept.drop("slack")

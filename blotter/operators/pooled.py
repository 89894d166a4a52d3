"""k-means for several k at once, from one pool of candidate centers.

Starting centers are found once: some rounds draw points with a chance that grows with their cost
(k-means||), more of them than the largest k, and each is weighted by the points nearest to it. This pool is
small and no longer depends on how many points there are, so it is reduced to a start for every k on the driver.
Then Lloyd's steps run over the weighted points as expressions. Each pass labels the points for all k that still move
and sums up per cluster, so what comes to the driver is one row a center.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.operators.clustering import KMEANS_MAX_ITER, KMEANS_TOL, SEED, nearest_center

# Rounds of drawing, and points to expect from each as a multiple of the largest k.
ROUNDS, OVERSAMPLE = 4, 2.0
# Starts tried on the pool for each k, and Lloyd's steps there.
POOL_STARTS, POOL_STEPS = 8, 30


@dataclass(frozen=True)
class PooledModel:
    """Centers of one k, the weighted cost of all points, and the steps it took."""

    centers: list[list[float]]
    cost: float
    steps: int


def fit_pooled(
    points: DataFrame,
    columns: Sequence[str],
    weight: str,
    ks: Sequence[int],
    seed: int = SEED,
    max_iter: int = KMEANS_MAX_ITER,
    tol: float = KMEANS_TOL,
) -> dict[int, PooledModel]:
    """A model for every k. Fewer distinct points than k give fewer centers."""
    centers, weights = candidate_pool(points, columns, weight, max(ks), seed)
    starts = {k: reduced(centers, weights, k, seed) for k in ks}
    return lloyd(points, columns, weight, starts, max_iter, tol)


def candidate_pool(
    points: DataFrame, columns: Sequence[str], weight: str, k: int, seed: int = SEED
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct points spread over the data, and the weight nearest to each. The draw depends on the
    points and the seed alone."""
    first = points.agg(F.min_by(F.array(*columns), F.xxhash64(F.lit(seed), *columns))).first()[0]
    pool = [first]
    for step in range(ROUNDS):
        cost = F.col(weight) * _cost(columns, pool)
        total = points.agg(F.sum(cost)).first()[0]
        if not total:
            break
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed + step + 1), *columns), 11)
        chance = F.lit(OVERSAMPLE * k / total) * cost
        drawn = points.filter(bits * F.lit(2.0**-53) < chance).select(*columns).collect()
        known = set(map(tuple, pool))
        pool += sorted(list(row) for row in drawn if tuple(row) not in known)
    held = (
        points.groupBy(nearest_center(columns, pool).alias("own")).agg(F.sum(weight).alias("w")).collect()
    )
    weights = np.zeros(len(pool))
    for row in held:
        weights[row["own"]] = row["w"]
    return np.array(pool, dtype=float), weights


def reduced(centers: np.ndarray, weights: np.ndarray, k: int, seed: int = SEED) -> np.ndarray:
    """The best of some weighted k-means++ starts on the pool, each improved by Lloyd's steps there."""
    rng, best, least = np.random.default_rng([seed, k]), None, np.inf
    for _ in range(POOL_STARTS):
        found = centers[[rng.choice(len(centers), p=weights / weights.sum())]]
        while len(found) < k:
            chance = weights * _squares(centers, found).min(axis=1)
            if not chance.sum():
                break
            found = np.vstack([found, centers[rng.choice(len(centers), p=chance / chance.sum())]])
        for _ in range(POOL_STEPS):
            own = _squares(centers, found).argmin(axis=1)
            mass = np.bincount(own, weights, len(found))
            sums = np.stack([np.bincount(own, weights * x, len(found)) for x in centers.T], axis=1)
            moved = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], found)
            if np.allclose(moved, found, rtol=0, atol=1e-12):
                break
            found = moved
        cost = float((weights * _squares(centers, found).min(axis=1)).sum())
        if cost < least:
            best, least = found, cost
    return best


def lloyd(
    points: DataFrame,
    columns: Sequence[str],
    weight: str,
    starts: dict[int, np.ndarray],
    max_iter: int = KMEANS_MAX_ITER,
    tol: float = KMEANS_TOL,
) -> dict[int, PooledModel]:
    """Lloyd's steps from the starts until no center of a k moves by more than ``tol``. A center without points stays."""
    now, done, steps = dict(starts), {}, 0
    while True:
        sums = _cluster_sums(points, columns, weight, now)
        for k, centers in list(now.items()):
            mass, total, cost = sums[k]
            moved = np.where(mass[:, None] > 0, total / np.maximum(mass, 1e-300)[:, None], centers)
            still = steps >= max_iter or np.sqrt(((moved - centers) ** 2).sum(axis=1)).max() <= tol
            if still:
                done[k] = PooledModel(centers.tolist(), cost, steps)
                del now[k]
            else:
                now[k] = moved
        if not now:
            return {k: done[k] for k in starts}
        steps += 1


def _cluster_sums(points, columns, weight, centers: dict[int, np.ndarray]) -> dict:
    """Per k and center its weight and weighted coordinate sums, and per k the cost; one pass for all."""
    labelled = points.select(
        *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(columns)],
        F.col(f"`{weight}`").alias("w"),
        *[nearest_center(columns, c.tolist()).alias(f"own{k}") for k, c in centers.items()],
    )
    xs = [F.col(f"x{i}") for i in range(len(columns))]
    tagged = [F.struct(F.lit(k).alias("k"), F.col(f"own{k}").alias("own")) for k in centers]
    rows = (
        labelled.select(*xs, "w", F.inline(F.array(*tagged)))
        .groupBy("k", "own")
        .agg(
            F.sum("w").alias("w"),
            *[F.sum(F.col("w") * x).alias(f"sum{i}") for i, x in enumerate(xs)],
            F.sum(F.col("w") * reduce(add, [x * x for x in xs])).alias("squares"),
        )
        .collect()
    )
    out = {}
    for k, held in centers.items():
        mass, total, cost = np.zeros(len(held)), np.zeros(held.shape), 0.0
        for row in (r for r in rows if r["k"] == k):
            own, sums = row["own"], np.array([row[f"sum{i}"] for i in range(len(xs))])
            mass[own], total[own] = row["w"], sums
            center = held[own]
            cost += row["squares"] - 2 * float(center @ sums) + row["w"] * float(center @ center)
        out[k] = (mass, total, max(cost, 0.0))
    return out


def _cost(columns: Sequence[str], centers: Sequence[Sequence[float]]) -> Column:
    """Squared distance to the nearest of the centers."""
    own = F.get(
        F.array(*[F.array(*map(F.lit, map(float, c))) for c in centers]), nearest_center(columns, centers)
    )
    return reduce(add, [(F.col(f"`{c}`") - own[i]) * (F.col(f"`{c}`") - own[i]) for i, c in enumerate(columns)])


def _squares(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((points[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)

"""Nearest neighbours by collision counting over single-projection sorted arrays.

Each vector is projected on random directions (orthonormal in sets; half as many again as the
dimension, at least ``PROJECTIONS``), and each direction keeps its projections sorted. A query is projected too and looks, in every array, at a
window centred on itself. A vector in the window collides with the query in that direction. Windows
widen by the same factor everywhere (virtual rehashing: nothing is hashed again, the same arrays serve every width).
Vectors that collide often enough, and no others, are verified by their exact distance.

There are two widths. In the first pass, a narrow window (``FIRST``) ranks the vectors of a block by
collisions; the first ones are verified, and their ``k``-th best distance bounds that of the answer. The least such bound
over all blocks goes back to every block, with the window in which its ``k`` vectors collide often enough. In the second pass,
each query opens that window, or if it is wider the one in which a vector at the bound
collides in at least ``THRESHOLD`` of all directions with probability ``CERTAIN``. All that do are verified. So there is no widening step by step, and blocks far from a
query verify little.

The index is dealt by the hash of identifiers into blocks whose arrays fit a task; a query set is
dealt into blocks too, and each pair of blocks is one task. A block returns what lies within the bound, ``k`` at most; these
few rows are ranked per query.

Directions depend on the dimension and a seed alone, so nothing is fitted on data; how many vectors are
verified follows from the data. The README states recall and that share for several dimensions.

Defined cases: vectors that are null, empty, zero, or hold a null or a non-finite component take no
part, nor do vectors without identifier. Vectors are compared with those of their own dimension
only. Components whose squares leave the range of doubles (beyond 1e150, or all below 1e-150) make a task compare all its
pairs; a distance too large for a double is infinity. If an identifier is repeated, its least vector in order counts, once. Ties go to the smaller
identifier. With fewer than ``k`` candidates all are returned. Empty tables give empty results. Other columns are
never read.
"""

from __future__ import annotations

from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blotter.llm.common import staged

PROJECTIONS, PER_DIMENSION, THRESHOLD, SEED = 96, 1.5, 0.85, 20
# Half the width of the first window in standard deviations of the block's projections, the share of
# directions it looks in, and how many of the vectors that collide most are verified there, as a multiple of k.
FIRST, RANKING, VERIFIED = 0.3, 2, 8
# Probability that a vector at the bound is verified; nearer ones are with a higher one.
CERTAIN = 0.8
# Components in a block of vectors and in a block of queries, and vectors in a block at most.
COMPONENTS, VECTORS, QUERIES = 1 << 22, 8_192, 16_384

_BOUND = "query_id long, bound double, reach double"
_FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (
        vector.isNotNull()
        & F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False)))
        & F.exists(vector, lambda x: x != 0)
    )


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_column: str = "vec_id",
    vector: str = "embedding",
    block: int = VECTORS,
    query_block: int = QUERIES,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``; ``is_query`` marks the rows that are queries too."""
    ready = staged(
        vectors.select(
            F.col(id_column).cast("long").alias("vec_id"),
            F.col(vector).cast("array<double>").alias("vector"),
            is_query.alias("asks"),
        )
        .filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
        .withColumn("size", F.size("vector")),
        "vectors",
    )
    rows, asking, size = ready.agg(F.count("*"), F.count_if("asks"), F.max("size")).first()
    fits = max(64, COMPONENTS // max(1, size or 1))
    blocks = max(1, -(-rows // min(block, fits)))
    query_blocks = max(1, -(-asking // min(query_block, fits)))
    part = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = ready.select(
        "size", part(blocks, 0).alias("block"), every(query_blocks).alias("query_block"), "vec_id", "vector"
    )
    asked = ready.filter("asks").select(
        "size", every(blocks).alias("block"), part(query_blocks, 1).alias("query_block"), "vec_id", "vector"
    )
    keys = ("size", "block", "query_block")

    def together(queries: DataFrame, task, schema: str) -> DataFrame:
        return queries.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(task, schema)

    bounds = staged(
        together(asked, lambda asks, has: _bounds(asks, has, k), _BOUND)
        .groupBy("query_id")
        .agg(F.min(F.struct("bound", "reach")).alias("least"))
        .select("query_id", "least.*"),
        "bounds",
    )
    columns = (*keys, "vec_id", "vector", "bound", "reach")
    bounded = asked.join(bounds.withColumnRenamed("query_id", "vec_id"), "vec_id").select(*columns)
    bounded = bounded.toDF(*columns)  # columns of its own, as the other side comes from the same table
    found = together(bounded, lambda asks, has: _search(asks, has, k), _FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _bounds(asks: pa.Table, has: pa.Table, k: int) -> pa.Table:
    """A distance within which each query has ``k`` vectors of the block, and the window in which these
    collide often enough; infinity if it has not so many."""
    ids, points, _ = _matrix(has)
    queries, places, _ = _matrix(asks)
    bound, reach = np.full((2, len(queries)), np.inf)
    if len(ids) > k and len(queries):
        index = SortedProjections(points)
        likely = index.likely(places, VERIFIED * k + 1)
        for row, (place, own, near) in enumerate(zip(places, index.owners(queries, ids), likely)):
            near = near[near != own]
            distance = distances(points[near], place)
            if len(distance) >= k:
                best = np.argpartition(distance, k - 1)[:k]
                bound[row] = distance[best].max()
                reach[row] = index.needed(points[near[best]], place)
    return pa.table({"query_id": queries, "bound": bound, "reach": reach})


def _search(asks: pa.Table, has: pa.Table, k: int) -> pa.Table:
    """The best vectors of the block within each query's bound."""
    ids, points, _ = _matrix(has)
    queries, places, (bounds, reach) = _matrix(asks)
    out = ([], [], [])
    if len(ids) and len(queries):
        index = SortedProjections(points)
        found = index.within(places, np.maximum(bounds * index.bound, reach))
        for row, (place, own, near) in enumerate(zip(places, index.owners(queries, ids), found)):
            score = distances(points[near], place)
            wanted = (near != own) & (score <= bounds[row])
            near, score = near[wanted], score[wanted]
            best = np.lexsort((ids[near], score))[:k]
            out[0].append(np.full(len(best), queries[row]))
            out[1].append(ids[near][best])
            out[2].append(score[best])
    types = (np.int64, np.int64, np.float64)
    columns = [np.concatenate([np.zeros(0, t), *o]) for o, t in zip(out, types)]
    return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))


def distances(points: np.ndarray, place: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", under="ignore"):
        difference = points - place
        return np.sqrt((difference * difference).sum(axis=1))


class SortedProjections:
    """Per direction the projections of a block's vectors in order, and whose they are."""

    def __init__(self, points: np.ndarray):
        most = float(np.abs(points).max())
        self.plain = 1e-150 < most < 1e150  # squares neither overflow nor vanish
        self.size, self.dimension = points.shape
        self.axes = directions(self.dimension)
        self.least = int(np.ceil(THRESHOLD * self.axes.shape[1]))
        self.unit = self.bound = 1.0
        if self.plain:
            projected = points @ self.axes
            owner = np.argsort(projected, axis=0, kind="stable")
            self.sorted = np.take_along_axis(projected, owner, axis=0).T.copy()
            self.owner = owner.T.copy()
            self.unit = float(projected.std(axis=0).mean())
            self.slack = 1e-9 * float(np.abs(projected).max())
            self.bound = reach_of_unit_distance(self.dimension, self.axes.shape[1])

    def owners(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Each query's own place in the block, or -1."""
        own = np.minimum(np.searchsorted(ids, queries), len(ids) - 1)
        return np.where(ids[own] == queries, own, -1)

    def collisions(self, places: np.ndarray, reach: np.ndarray, directions: int | None = None):
        """Per query in how many of the first directions each vector lies within the window around it;
        nothing where numbers are too large or small to project, or the window has no end."""
        usual = (np.abs(places).max(axis=1) < 1e150) & np.isfinite(reach) & self.plain
        if not usual.any():
            yield from [None] * len(places)
            return
        centres = np.where(usual[:, None], places, 0.0) @ self.axes[:, :directions]
        reach = np.where(usual, reach, 0.0) + self.slack
        lows, highs = np.empty(centres.shape, dtype=np.int64), np.empty(centres.shape, dtype=np.int64)
        for j, row in enumerate(self.sorted[:directions]):
            lows[:, j] = np.searchsorted(row, centres[:, j] - reach)
            highs[:, j] = np.searchsorted(row, centres[:, j] + reach, side="right")
        for ok, low, high in zip(usual.tolist(), lows.tolist(), highs.tolist()):
            yield self._count(low, high) if ok else None

    def _count(self, low: list[int], high: list[int]) -> np.ndarray:
        """What a window leaves out is counted instead where that is less."""
        inside, outside, wide = [], [], 0
        for owner, a, b in zip(self.owner, low, high):
            if 2 * (b - a) < self.size:
                inside.append(owner[a:b])
            else:
                wide += 1
                outside += owner[:a], owner[b:]
        counts = np.full(self.size, wide)
        if inside:
            counts += np.bincount(np.concatenate(inside), minlength=self.size)
        if outside:
            counts -= np.bincount(np.concatenate(outside), minlength=self.size)
        return counts

    def likely(self, places: np.ndarray, wanted: int):
        """Per query the vectors that collide most in the first window, or all."""
        ranking = max(1, self.axes.shape[1] // RANKING)
        reach = np.full(len(places), FIRST * self.unit)
        for counts in self.collisions(places, reach, ranking):
            if counts is None or wanted >= self.size:
                yield np.arange(self.size)
            else:
                yield np.argpartition(-counts, wanted)[:wanted]

    def needed(self, points: np.ndarray, place: np.ndarray) -> float:
        """The window around a query in which all of these vectors collide often enough."""
        if not self.plain:
            return np.inf
        apart = np.abs((points - place) @ self.axes)
        return float(np.partition(apart, self.least - 1, axis=1)[:, self.least - 1].max())

    def within(self, places: np.ndarray, reach: np.ndarray):
        """Per query the vectors that collide often enough in its window, or all."""
        for counts in self.collisions(places, reach):
            yield np.arange(self.size) if counts is None else np.flatnonzero(counts >= self.least)


def reach_of_unit_distance(dimension: int, projections: int) -> float:
    """The window in which a vector at distance 1 collides often enough with probability ``CERTAIN``.

    Its distance along a random direction is close to normal with variance 1 / dimension. The chance
    of one collision must be so far above ``THRESHOLD`` that the count of all hardly falls below it.
    """
    z = NormalDist().inv_cdf(CERTAIN)
    t, spare = THRESHOLD, z * z / projections
    chance = (t + spare / 2 + (spare * (t * (1 - t) + spare / 4)) ** 0.5) / (1 + spare)
    return NormalDist().inv_cdf((1 + chance) / 2) / dimension**0.5


@lru_cache(maxsize=8)
def directions(dimension: int) -> np.ndarray:
    """Random unit directions, a column each; as many as fit are orthogonal to one another."""
    rng = np.random.default_rng([SEED, dimension])
    count = max(PROJECTIONS, int(np.ceil(PER_DIMENSION * dimension)))
    sets = []
    while sum(s.shape[1] for s in sets) < count:
        sets.append(np.linalg.qr(rng.standard_normal((dimension, dimension)))[0])
    return np.concatenate(sets, axis=1)[:, :count]


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Identifiers in ascending order, each once, their vectors, and their bounds if there are any."""
    ids = table.column("vec_id").to_numpy()
    bounds = [table.column(c).to_numpy() for c in ("bound", "reach") if c in table.column_names]
    lists = table.column("vector").combine_chunks()
    if not len(ids):
        return ids, np.zeros((0, 1)), bounds
    points = lists.flatten().to_numpy().reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    if (np.diff(ids[order]) == 0).any():
        order = np.lexsort((*points.T[::-1], ids))
        order = order[np.append(True, np.diff(ids[order]) != 0)]
    return ids[order], points[order], [b[order] for b in bounds]

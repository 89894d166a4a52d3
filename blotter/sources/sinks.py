"""Sinks. Results leave through executors; nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.schema import COORDINATES


def write_counts(counts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Key and count as tab-separated lines."""
    counts.write.mode(mode).option("sep", "\t").csv(path)


def write_cluster_map(clustered: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Everything a map of the clusters needs: one (lon, lat, cluster) row per incident."""
    cluster_map(clustered).write.mode(mode).parquet(path)


def cluster_map(clustered: DataFrame, coords: Sequence[str] = COORDINATES) -> DataFrame:
    """What a map needs: longitude, latitude and cluster of each incident together."""
    latitude, longitude = coords
    return clustered.select(longitude, latitude, "prediction")


# Zoom at which a tile is some 600 m wide.
DEEPEST_ZOOM = 16


def cluster_tiles(
    clustered: DataFrame,
    deepest: int = DEEPEST_ZOOM,
    coords: Sequence[str] = COORDINATES,
    cluster: str = "prediction",
) -> DataFrame:
    """``(zoom, x, y, cluster, count)``: incidents per tile and cluster, for every zoom to the deepest.

    A zoom has 2^zoom tiles along each axis, from west to east and from north to south, and a tile
    holds four of the next zoom. Incidents are counted once, in the finest tiles, and the counts are added up, so a map of any
    number of incidents reads a few tiles. Incidents without place or cluster have no tile.
    """
    latitude, longitude = coords
    across = 1 << deepest

    def step(share):
        return F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * across).cast("long")

    known = [F.col(f"`{c}`").isNotNull() for c in (latitude, longitude, cluster)]
    inner = F.lit(across - 1).cast("long")
    finest = (
        clustered.filter(known[0] & known[1] & known[2])
        .select(
            F.least(step((F.col(f"`{longitude}`") + 180) / 360), inner).alias("x"),
            F.least(step((90 - F.col(f"`{latitude}`")) / 180), inner).alias("y"),
            F.col(f"`{cluster}`").alias("cluster"),
        )
        .groupBy("x", "y", "cluster")
        .agg(F.count(F.lit(1)).alias("held"))
    )
    zooms = F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("zoom")
    shift = F.lit(deepest) - F.col("zoom")
    return (
        finest.select("*", zooms)
        .groupBy(
            "zoom",
            F.call_function("shiftright", "x", shift).alias("x"),
            F.call_function("shiftright", "y", shift).alias("y"),
            "cluster",
        )
        .agg(F.sum("held").alias("count"))
    )


def write_cluster_tiles(tiles: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder for each zoom, in the order of tiles, so a part of a map reads few row groups."""
    (
        tiles.repartitionByRange("zoom", "x", "y", "cluster")
        .sortWithinPartitions("zoom", "x", "y")
        .write.mode(mode)
        .partitionBy("zoom")
        .parquet(path)
    )


def write_scores(scores: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The score-by-k series."""
    scores.write.mode(mode).parquet(path)

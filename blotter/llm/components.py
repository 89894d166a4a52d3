"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import released, staged


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``(a, b)`` edges; the component is its
    smallest node.

    Alternates the large-star and small-star steps (Kiveris et al., "Connected components
    in MapReduce and beyond"), which shorten every path to the smallest node in about
    log-squared rounds and never make a node's edges more than they were in sum. Each round is
    written to the shared folder, and ends the loop when it changed nothing. Both steps
    take a minimum per node, which Spark combines before the shuffle.
    """
    edges = staged(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    before, now = None, _state(edges)
    while now != before:
        older, edges = edges, staged(_small_star(_large_star(edges)), "edges")
        released(older)
        before, now = now, _state(edges)
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)


def _state(edges: DataFrame):
    digest = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return edges.agg(F.count("*").alias("edges"), digest.alias("digest")).first()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        both.join(smallest, "a")
        .filter("b > a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = edges.filter("a > b")
    smallest = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = (
        down.join(smallest, "a")
        .filter("b <> m")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
    )
    return moved.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct()

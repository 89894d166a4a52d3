"""Whole studies: which incidents, and where they cluster."""

from blotter.plans.hotspots import (
    PointSet,
    assign_gmm,
    assign_kmeans,
    prepare_points,
    score_models,
    sweep,
    sweep_from_pool,
)
from blotter.plans.studies import (
    STUDIES,
    Study,
    domestic_in_homes,
    street_at_night,
    street_by_day,
)
from blotter.sources.sinks import cluster_map

__all__ = [
    "STUDIES",
    "PointSet",
    "Study",
    "assign_gmm",
    "assign_kmeans",
    "cluster_map",
    "domestic_in_homes",
    "prepare_points",
    "score_models",
    "street_at_night",
    "street_by_day",
    "sweep",
    "sweep_from_pool",
]

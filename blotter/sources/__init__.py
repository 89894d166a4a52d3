"""Reading and writing: typed CSV, raw text lines, Parquet staging, sinks."""

from blotter.sources.incidents import (
    count_rejects,
    quarantine_incidents,
    read_incidents,
    read_quarantined,
    read_staged,
    stage_incidents,
)
from blotter.sources.lines import header_line, read_lines
from blotter.sources.shared import fresh_folder, remove_folder, shared_root
from blotter.sources.sinks import (
    cluster_map,
    cluster_tiles,
    write_cluster_map,
    write_cluster_tiles,
    write_counts,
    write_scores,
)

__all__ = [
    "cluster_map",
    "cluster_tiles",
    "count_rejects",
    "fresh_folder",
    "header_line",
    "quarantine_incidents",
    "read_incidents",
    "read_lines",
    "read_quarantined",
    "read_staged",
    "remove_folder",
    "shared_root",
    "stage_incidents",
    "write_cluster_map",
    "write_cluster_tiles",
    "write_counts",
    "write_scores",
]

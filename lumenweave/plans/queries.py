"""All query and SQL pairs of the raster and catalog operators."""

from __future__ import annotations

from lumenweave.plans import q_catalog, q_combine, q_files, q_flow, q_graph, q_polar, q_scalars, q_series, q_sources, q_stats, q_streams  # noqa: F401
from lumenweave.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

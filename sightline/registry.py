"""Every query of the library outside the training-data package, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sightline.plans import camera_queries, candidate_queries, composite_queries, coverage_queries, graph_queries, mesh_queries, path_queries, pixel_queries, planning_queries, space_queries, table_queries, tracing_queries, volume_queries

_MODULES = (coverage_queries, space_queries, path_queries, graph_queries, table_queries, mesh_queries, camera_queries, volume_queries, pixel_queries, planning_queries, candidate_queries, composite_queries, tracing_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}

"""All registered queries of the reference's operators and their SQL twins."""

from __future__ import annotations

from skyframe.plans import archive_queries, field_queries, grid_queries, radar_queries, satellite_queries, scalar_queries, series_queries, shape_queries, stream_queries  # noqa: F401
from skyframe.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

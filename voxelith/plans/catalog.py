"""All queries over the carrier tables by name, and the SQL that gives the same rows."""

from __future__ import annotations

from voxelith.plans import cloud_queries, corpus_queries, scene_queries, stream_queries, voxel_queries  # noqa: F401
from voxelith.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

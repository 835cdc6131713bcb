"""All registered queries."""

from voxelarium.plans import cohort, intensity, learning, regions, timelines, voxels  # noqa: F401
from voxelarium.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

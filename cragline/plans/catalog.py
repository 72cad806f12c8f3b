"""All registered queries of the terrain operators."""

from cragline.plans import evaluation, experiments, graphs, listings, networks, projections, rasters, streams, summaries  # noqa: F401
from cragline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

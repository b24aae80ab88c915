"""Imports every query module, so that the registry is complete."""

from pairwright.plans import (  # noqa: F401
    blocking_queries,
    evaluation_queries,
    forest_queries,
    inference_queries,
    matcher_queries,
    similarity_queries,
    source_queries,
)
from pairwright.plans.registry import ORACLES, QUERIES  # noqa: F401

"""All registered queries; importing this module registers them."""

from taleweave.plans import (  # noqa: F401
    metric_queries,
    model_queries,
    shaping_queries,
    source_queries,
    text_queries,
)
from taleweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

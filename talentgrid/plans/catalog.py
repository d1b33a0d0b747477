"""Imports every query module so that the registry is complete."""

from talentgrid.plans import (  # noqa: F401
    eval_queries,
    market_queries,
    profile_queries,
    scalar_queries,
    source_queries,
    span_queries,
    text_queries,
    vector_queries,
)
from talentgrid.plans.registry import QUERIES, SQL  # noqa: F401

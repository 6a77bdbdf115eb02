"""All registered queries; importing a module registers what it defines."""

from flowloom.catalog import (  # noqa: F401
    q_enrich,
    q_features,
    q_models,
    q_sampling,
    q_sources,
    q_tables,
)
from flowloom.catalog.registry import QUERIES, oracles

__all__ = ["QUERIES", "oracles"]

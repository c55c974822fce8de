"""All queries and their oracles; importing this module registers them."""

from __future__ import annotations

from .queries import columns, documents, hazards, models, more, overlays, profile2, relational, relations, shapes, spatial, streams  # noqa: F401
from .registry import ORACLE, QUERIES

FLAGSHIP = "slice1_masked_graph_summary"
__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]

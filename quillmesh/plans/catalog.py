"""All queries of the core with their SQL; importing the modules registers them."""

from __future__ import annotations

from quillmesh.plans import deeper, dml, measures, relational, retrieval, streams, textual, wider  # noqa: F401
from quillmesh.plans.registry import ORACLE, QUERIES

FLAGSHIP = "ret03_hybrid_search"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]

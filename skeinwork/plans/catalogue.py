"""All queries of the library by name, and the SQL that each can be held against."""

from __future__ import annotations

from . import evidence, graphs, maintenance, retrieval

_MODULES = (retrieval, graphs, evidence, maintenance)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}

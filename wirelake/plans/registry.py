"""All queries of the engine's core and their SQL counterparts."""

from __future__ import annotations

from wirelake.plans import captures, core_problems, functions, live, relational, roundtrip

_MODULES = (core_problems, functions, relational, captures, live, roundtrip)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}

"""All queries of the core, with their SQL."""

from __future__ import annotations

from quarrymill.plans import catalog_graph, catalog_io, catalog_mining, catalog_p6, catalog_points

_modules = [catalog_mining, catalog_graph, catalog_points, catalog_io, catalog_p6]
QUERIES = {name: q for m in _modules for name, q in m.QUERIES.items()}
ORACLES = {name: q for m in _modules for name, q in m.ORACLES.items()}

"""All registered queries of the core and their SQL."""

from __future__ import annotations

from threadloom.plans import archive, dealt, retrieval, upkeep

_MODULES = (dealt, archive, retrieval, upkeep)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
FLAGSHIP = QUERIES["p5_current"]

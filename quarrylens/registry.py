"""All registered queries of the inspection engine with their oracle SQL, gathered from the plan modules."""

from __future__ import annotations

from quarrylens.plans import corpus, engine, lifecycle, quality, sources
from quarrylens.plans.base import Query

_MODULES = (corpus, engine, lifecycle, quality, sources)
QUERIES: dict[str, Query] = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}

"""All registered queries of the hierarchy engine with their oracle SQL."""

from __future__ import annotations

from .plans import entities, further, hierarchy, served, timeline

QUERIES: dict = hierarchy.QUERIES | entities.QUERIES | timeline.QUERIES | further.QUERIES | served.QUERIES
ORACLES: dict[str, str] = hierarchy.ORACLES | entities.ORACLES | timeline.ORACLES | further.ORACLES | served.ORACLES

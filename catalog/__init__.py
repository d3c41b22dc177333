"""Named queries over the test tables, each with the SQL that states its result."""

from catalog import models, origins, regimes, scoring, selection, sources, statistics, transforms, views
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "models", "origins", "regimes", "scoring", "selection", "sources", "statistics", "transforms", "views"]

"""All registered queries with their checks."""

from wattloom.catalog import aggregates, economics, grids, joins, models, planning, rows, scalars, sources, streams, windows  # noqa: F401
from wattloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

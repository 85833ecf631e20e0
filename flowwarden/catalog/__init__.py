"""The registered queries over the driver's tables and their SQL twins."""

from flowwarden.catalog import behavior, lines, models, rows, state, streams  # noqa: F401
from flowwarden.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

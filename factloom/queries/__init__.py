"""Named queries over the given tables, each next to its plain SQL."""

from factloom.queries import catalog, comparison, items, pages, spend, stored, texts  # noqa: F401  (they register)
from factloom.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

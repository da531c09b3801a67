"""All planning queries and their SQL: importing the modules registers them."""

from terrafold.plans import chain, contracts, routes, shapes, trips  # noqa: F401
from terrafold.plans.registry import ORACLE_SQL, QUERIES, flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]

"""All registered queries."""

from roamframe.plans import algorithm_queries, traversal_queries  # noqa: F401  they register themselves
from roamframe.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

"""Registered queries and their oracle SQL (see ``sendero.plans.registered``)."""

from sendero.plans import registered  # noqa: F401  (fills the registry)
from sendero.plans.registry import ORACLE, QUERIES, register

__all__ = ["ORACLE", "QUERIES", "register"]

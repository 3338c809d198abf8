"""Registered queries. Importing the family modules fills the registry."""

from paperloom.plans.registry import ORACLES, QUERIES
from paperloom.plans import aggregates, evaluation, filters, ordering, projections, stores, tools  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]

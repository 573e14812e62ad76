"""Registered queries by family."""

from tallylane.plans import aggregates, encoders, evaluation, feeds, ordered, relations, samples, scoring  # noqa: F401
from tallylane.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

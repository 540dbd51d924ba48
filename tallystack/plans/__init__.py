"""Queries that bind the operators to the driver tables (one per operator
key of the survey), each paired where possible with an independent DuckDB
formulation used as the correctness oracle."""

from tallystack.plans.registry import REGISTRY, load_all

__all__ = ["REGISTRY", "load_all"]

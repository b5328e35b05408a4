"""Queries over the driver's tables, by name, each with its SQL equivalent where there is one."""

from tarnwell.plans import aggregates, composites, contracts, evaluation, interpretation, inventory, joins, profiles, requests, temporal, text
from tarnwell.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "composites", "contracts", "evaluation", "interpretation", "inventory", "joins", "profiles", "requests", "temporal", "text"]

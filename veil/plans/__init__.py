"""Registered queries by concern. Importing this package fills the registry."""

from veil.plans import clean_features, crosstabs, evaluation, modeling, mondrian_queries, privacy_queries, risk_queries, scan_profile  # noqa: F401
from veil.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

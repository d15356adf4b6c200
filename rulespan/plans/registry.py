"""All registered queries; importing the query modules fills the registry."""

from rulespan.plans import q_checks, q_features, q_metrics, q_profile, q_rules, q_splits, q_streaming, q_tables  # noqa: F401
from rulespan.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

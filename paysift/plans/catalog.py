"""Import every query module so the registry is complete."""

from paysift.plans import q_aggregates, q_clean, q_io, q_joins, q_ml, q_rules, q_windows  # noqa: F401
from paysift.plans.registry import ORACLE, QUERIES  # noqa: F401

"""All reference queries: importing the modules registers them."""

from holdfast.plans import q_keys, q_more, q_rows, q_splits, q_stats  # noqa: F401
from holdfast.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

"""All checkable queries. Importing the modules registers them."""

from lacuna.plans import pair_queries, read_queries, text_queries  # noqa: F401
from lacuna.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

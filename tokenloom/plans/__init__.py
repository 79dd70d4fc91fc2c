"""Query plans over the driver tables. Importing this package registers every query."""

from tokenloom.plans import analytics, chat, corpus, files, masks, router, training  # noqa: F401
from tokenloom.plans.registry import ORACLE, QUERIES, table

__all__ = ["QUERIES", "ORACLE", "table"]

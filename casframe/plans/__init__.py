"""The operators as queries over the standard tables, with equivalent SQL."""

from casframe.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]

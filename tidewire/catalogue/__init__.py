"""Every operator bound to the given tables, with the SQL that must agree with it."""

from .oracle import oracle_sql
from .queries import queries

__all__ = ["oracle_sql", "queries"]

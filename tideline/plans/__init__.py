"""The registered queries over the test tables, each with the SQL it must equal."""

from .catalog import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]

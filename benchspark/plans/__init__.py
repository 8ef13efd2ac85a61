"""Named queries over the given tables, each with the SQL that must give the same rows."""

from benchspark.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]

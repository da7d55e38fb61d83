"""Operators for preparing training corpora.  Nothing else in strataline imports this package."""

from strataline.llm.queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]

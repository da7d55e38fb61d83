"""Named queries over the driver's tables, each with its SQL where SQL can state it."""

from strataline.plans import aggregates, cohorts, desk, gate, incremental, joins, listing, scalars, service, sources, streams  # noqa: F401
from strataline.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

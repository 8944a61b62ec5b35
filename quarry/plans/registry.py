"""All queries of the library outside the training-data package, with their SQL."""

from __future__ import annotations

from quarry.plans import queries_code, queries_dataflow, queries_index, queries_logs, queries_versions  # noqa: F401
from quarry.plans.registered import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

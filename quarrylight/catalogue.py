"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from quarrylight import queries, queries_state, queries_tools  # noqa: F401  the latter two add theirs
from quarrylight.queries import QUERIES, SQL, flagship, kernel_topk

__all__ = ["QUERIES", "SQL", "flagship", "kernel_topk"]

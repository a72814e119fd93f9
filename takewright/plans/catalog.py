"""Registered queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from . import captures, compositions, evidence, finals, further, kernels, packages, recordings, records, relational, samples, scalar  # noqa: F401  (they register their queries)
from .base import ORACLE_SQL, QUERIES

FLAGSHIP = "m11_duplicate_readiness"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

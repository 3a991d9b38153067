"""All registered queries."""

from __future__ import annotations

from . import atoms, kernels, samples  # noqa: F401 - they register themselves
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

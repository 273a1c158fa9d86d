"""All queries: importing a module registers what it holds."""

from __future__ import annotations

from trajframe.plans import alignment, basics, conversions, edits, evaluation, frames, progress, sampling, sequences, statistics, streams, values  # noqa: F401
from trajframe.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

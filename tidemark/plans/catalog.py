"""All registered queries of the reference's operators."""

from __future__ import annotations

from . import checks, files, market, matching, pages, payloads, reports, stages, state, streams, upkeep, values  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

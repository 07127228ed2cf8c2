"""All registered queries."""

from __future__ import annotations

from . import actions, compliance, documents, equipment, feed, inventory, recalls, retrieval, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]

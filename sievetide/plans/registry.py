"""All queries by name, and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from . import base, decisions, more, texts, work
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "base", "decisions", "more", "texts", "work"]

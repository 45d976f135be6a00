"""Registered queries: each applies library operators to whole tables; most have an independent DuckDB oracle."""

from __future__ import annotations

from . import answers, content, entity, facts, files, inventory, judgements, pages, relational, scoring, site, stateful, texts  # noqa: F401 - they register their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

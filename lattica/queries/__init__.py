"""All queries of the engine over the given tables, by name, with the SQL that says the same."""

from __future__ import annotations

from . import facts, landed, recovery, relational, semantic, stateful, textual
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "facts", "landed", "recovery", "relational", "semantic", "stateful", "textual"]

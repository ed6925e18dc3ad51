"""Registered queries: one per operator, with the SQL a second engine can check it by."""

from __future__ import annotations

import importlib

FAMILIES = (
    "profiling", "cleaning", "encoding", "splitting", "sequences", "classification", "regression",
    "drift", "semantics", "tokens", "vectors", "survival", "models", "inputs", "streams", "stages",
)


def load():
    """All registered queries and their SQL, in family order."""
    from gridwright.queries.base import QUERIES, SQL

    for name in FAMILIES:
        importlib.import_module(f"gridwright.queries.{name}")
    return dict(QUERIES), dict(SQL)

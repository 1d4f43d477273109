"""Registered queries over the given tables, each with its independent SQL twin."""

from __future__ import annotations

import importlib

FAMILIES = [
    "search", "terms", "structure", "rules", "rerank", "quality", "graph", "mapping", "evaluation", "telemetry", "streams", "io", "jobs",
]


def load():
    """Import every family; returns (queries, sql)."""
    from clausemill.catalog import base

    for family in FAMILIES:
        importlib.import_module(f"clausemill.catalog.{family}")
    return base.QUERIES, base.SQL

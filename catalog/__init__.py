"""Registered queries over the given tables, each next to the SQL that must agree with it."""

from __future__ import annotations

import importlib

_MODULES = ["report_queries", "decision_queries", "model_queries", "usage_queries", "service_queries"]


def load():
    """(queries, oracles), after importing every module that registers some."""
    for name in _MODULES:
        importlib.import_module(f"{__name__}.{name}")
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES

"""Registered queries: a Spark plan and, where SQL can say the same, its oracle."""

from __future__ import annotations

import importlib

from asofia.plans.registry import QUERIES, Query

MODULES = ("market", "research", "evaluation", "trading", "intake", "events", "filings", "learning")


def catalog() -> dict[str, Query]:
    for name in MODULES:
        importlib.import_module(f"asofia.plans.{name}")
    return dict(QUERIES)

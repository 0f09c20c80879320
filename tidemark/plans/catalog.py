"""All registered queries and their oracle SQL."""

from __future__ import annotations

import importlib

from tidemark.plans.registry import ORACLES, QUERIES

MODULES = ("bars", "windows", "signals", "edge", "perf", "portfolio", "overfit", "grid", "scalars", "stream")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"tidemark.plans.q_{m}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(ORACLES)

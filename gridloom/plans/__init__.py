"""Registered queries. Importing the modules below fills the registry."""

from __future__ import annotations

import importlib

from gridloom.plans.registry import REGISTRY, Query

MODULES = ["arrays", "texts", "tables", "metrics", "vision", "models", "streams", "files"]


def all_queries() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"gridloom.plans.{module}")
    return dict(REGISTRY)

"""Plans over the engine's tables; importing a module of this package registers its queries."""

from __future__ import annotations

import importlib

MODULES = ("scores", "forms", "joins", "values", "brackets", "streams", "models", "flagship", "features", "ladders", "captures", "reports", "frames")


def all_queries():
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    from .registry import QUERIES

    return QUERIES

"""Registered queries over the driver tables, each with its SQL oracle where SQL can say it."""
from __future__ import annotations

import importlib
import pkgutil

from narralytics.catalog.registry import REGISTRY, Entry


def load_all() -> dict[str, Entry]:
    """Import every ``*_queries`` module and return the registry."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
    return REGISTRY

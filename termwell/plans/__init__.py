"""Queries over the provided tables, composed of the library's operators."""

from __future__ import annotations

import importlib
import pkgutil

from termwell.plans.registry import REGISTRY, Query


def load_queries() -> dict[str, Query]:
    """All registered queries by name."""
    for module in sorted(info.name for info in pkgutil.iter_modules(__path__)):
        if module.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module}")
    return REGISTRY

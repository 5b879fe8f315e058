"""The queries that show every operator on the driver's tables."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every query module once and return the registry."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    from landgrid.registry.base import QUERIES

    return QUERIES

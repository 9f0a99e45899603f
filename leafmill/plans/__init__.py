"""Registered queries and their SQL, by subject."""

from __future__ import annotations

import importlib
import pkgutil
from types import ModuleType


def modules() -> list[ModuleType]:
    """The modules of this package that register queries."""
    found = [importlib.import_module(f"{__name__}.{m.name}") for m in pkgutil.iter_modules(__path__)]
    return [m for m in found if hasattr(m, "QUERIES")]

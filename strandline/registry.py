"""All queries of the engine, by name; each module under ``plans`` adds its own."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from strandline import plans


def _modules():
    for info in sorted(pkgutil.iter_modules(plans.__path__), key=lambda m: m.name):
        yield importlib.import_module(f"strandline.plans.{info.name}")


def queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for module in _modules():
        out |= getattr(module, "QUERIES", {})
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _modules():
        out |= getattr(module, "ORACLES", {})
    return out

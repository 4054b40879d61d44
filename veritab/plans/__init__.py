"""Bindings of operators to the benchmark tables, and the operator registry."""

import importlib
import pkgutil

from veritab.plans.registry import QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
    importlib.import_module(f"{__name__}.{_module}")

__all__ = ["QUERIES"]

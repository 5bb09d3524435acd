"""Registered queries, grouped like the operator modules."""

import importlib
import pkgutil


def load_all() -> None:
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")

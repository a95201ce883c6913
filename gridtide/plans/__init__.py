"""Registered queries. `load()` imports every module that registers some."""

import importlib
import pkgutil


def load():
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module not in ("common", "registry"):
            importlib.import_module(f"{__name__}.{module}")
    return importlib.import_module(f"{__name__}.registry")

"""Sends the package's functions by value, so that Python workers need no copy of it installed."""

from __future__ import annotations

import importlib

from pyspark import cloudpickle


def ship() -> None:
    package = importlib.import_module(__package__)
    if __package__ not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(package)

"""Functions that run in Python workers."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def travel_by_value(module: str) -> None:
    """Send a module's functions to tasks whole: workers need not find this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])

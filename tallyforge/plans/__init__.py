"""Queries over the driver tables, one per operator or job."""

from . import analytics, catalog_io, checks, file_io, generation, joins_sets, logs, nested_data, row_rules, text_dates  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

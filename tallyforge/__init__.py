"""Spark-native ETL, data-quality and reconciliation toolkit.

Every operator is a plain function ``DataFrame -> DataFrame`` or ``-> Column``;
nothing here plans, schedules or stores data on its own.
"""

__version__ = "0.1.0"

"""Tapewright: a PySpark-native analytics engine for quantitative time series."""

__version__ = "0.1.0"

"""Gridloom: a PySpark-native engine for n-dimensional array analytics."""

__version__ = "0.1.0"

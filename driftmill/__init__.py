"""A PySpark-native engine for monitoring measured signals and preparing corpora."""

__version__ = "0.1.0"

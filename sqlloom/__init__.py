"""Spark-native engine for building and checking question / SQL corpora."""

__version__ = "0.1.0"

"""Spark-native profiling, privacy, synthesis and evaluation of tables."""

__version__ = "0.1.0"

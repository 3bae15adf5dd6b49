"""Spark-native document retrieval, ranking and text-pipeline engine."""

__version__ = "0.1.0"

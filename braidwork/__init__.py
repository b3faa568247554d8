"""Spark-first analytics for language-model training and evaluation data."""

__version__ = "0.1.0"

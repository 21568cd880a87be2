"""Spark-first engine for preparing, scoring and measuring text-quality datasets."""

__version__ = "0.3.0"

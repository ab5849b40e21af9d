"""Earning patterns and declarative frame mappings as PySpark DataFrame jobs."""

__version__ = "0.1.0"

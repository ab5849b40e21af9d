"""Whole jobs put together from operators: mapping documents and pattern results."""

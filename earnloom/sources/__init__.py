"""Readers, writers, tables and the catalogue."""
